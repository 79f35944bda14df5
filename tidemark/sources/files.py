"""Text and Parquet sources and sinks, and corpora: a folder of tables with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import log, models
from tidemark.operators import annotations as A

SCHEMA_VERSION = "1.0"
#: Suffixes of the built-in formats.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet"}
BUILT_IN = ("csv", "tsv", "jsonl", "parquet")
_SUFFIXES = frozenset(FORMATS)
_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}


def detect_format(path: str) -> str:
    for suffix, kind in FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"unknown format: {path}")


def register_suffixes(kind: str, *suffixes: str) -> None:
    if any(s in _SUFFIXES or not s.startswith(".") for s in suffixes):
        raise ValueError("built-in suffixes can't be replaced, and a suffix begins with a point")
    FORMATS.update(dict.fromkeys(suffixes, kind))


def unregister_suffixes(*suffixes: str) -> None:
    for s in set(suffixes) - _SUFFIXES:
        FORMATS.pop(s, None)


def register_reader(kind: str, read: Callable[[SparkSession, str], DataFrame], *suffixes: str, replace: bool = False) -> None:
    """Add a source format: a function of a session and a path that gives a DataFrame; built-in ones stay."""
    if kind in BUILT_IN or (kind in _READERS and not replace) or not callable(read):
        raise ValueError("built-in formats can't be replaced, and a reader is a function")
    register_suffixes(kind, *suffixes)
    _READERS[kind] = read


def unregister_reader(kind: str) -> None:
    _READERS.pop(kind, None)
    unregister_suffixes(*(s for s, k in list(FORMATS.items()) if k == kind))


def register_writer(kind: str, write: Callable[[DataFrame, str], None]) -> None:
    if kind in BUILT_IN or not callable(write):
        raise ValueError("built-in formats can't be replaced, and a writer is a function")
    _WRITERS[kind] = write


def available_readers() -> list[str]:
    return sorted({*BUILT_IN, *_READERS})


def resolve_source(spark: SparkSession, path: str) -> str:
    """The path, if there is something to read, by whatever file system it names."""
    if not models.exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    return path


def _head(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """The first line of the files, which must agree, and whether some line has an odd number of quotes (a cell with line ends)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    by_file = lines.groupBy("file").agg(F.min_by("value", "at").alias("first"), F.max(odd).alias("odd"))
    found = by_file.agg(F.collect_set("first").alias("heads"), F.max("odd").alias("odd")).first()
    if len(heads := {h.lstrip("\ufeff").rstrip("\r") for h in found["heads"]}) > 1:
        raise ValueError("files of one source have different headers")
    return sorted(heads), bool(found["odd"])


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as strings; short rows get nulls, rows with surplus cells and repeated headers are errors.

    Files are split unless a quoted cell holds a line end.
    """
    heads, odd = _head(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": odd, "encoding": "UTF-8"}
    first = (spark.read.options(header=False, **options).csv(path) if odd else spark.read.options(header=False, **options).csv(spark.sparkContext.parallelize(heads))).first() if heads else None
    names = [(c or "").lstrip("\ufeff") for c in (first or [])]
    if not names or len(set(names)) != len(names) or not all(names):
        raise ValueError("the header is missing, repeats a name or has an empty one")
    bad = "__bad"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(bad, T.StringType())])
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=True, **options).csv(path)
    unquoted = F.regexp_replace(bad, '"(?:[^"]|"")*"', "q")
    cells = F.size(F.split(unquoted, "\\Q" + sep + "\\E", -1))
    checked = F.when(F.col(bad).isNotNull() & (cells > len(names)), F.raise_error(F.lit("a row has more cells than the header")).cast("string"))
    return rows.select(*(F.nullif(F.coalesce(checked, F.col(f"`{n}`")), F.lit("")).alias(n) for n in names))


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """All keys as strings, nested values as JSON; blank lines are skipped, a line that is no object is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cells = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    checked = F.when(F.trim("value").startswith("{") & cells.isNotNull(), cells).otherwise(F.raise_error(F.lit("a line is no JSON object")).cast("map<string,string>"))
    parsed = lines.select(checked.alias("cells"), F.col("_metadata"))
    names = parsed.select(F.explode(F.map_keys("cells")).alias("k")).distinct()
    known = sorted(r["k"] for r in names.collect())  # one row for each key
    return lines.select(*(F.try_element_at(checked, F.lit(k)).alias(k) for k in known))


def read_source(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or detect_format(path)
    resolve_source(spark, path)
    if kind in _READERS:
        made = _READERS[kind](spark, path)
        if not isinstance(made, DataFrame):
            raise TypeError(f"the reader of {kind} gave no DataFrame")
        return made
    if kind in ("csv", "tsv"):
        return _delimited(spark, path, "," if kind == "csv" else "\t")
    if kind not in BUILT_IN:
        raise ValueError(f"unknown format: {kind}")
    return _json_lines(spark, path) if kind == "jsonl" else spark.read.parquet(path)


def _sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def _text_ready(df: DataFrame, nested: bool = False) -> DataFrame:
    """Times as ISO text in UTC, maps and arrays as JSON (or, ``nested``, as they are) with sorted keys."""
    made = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif isinstance(f.dataType, T.MapType):
            c = _sorted_map(c) if nested else F.to_json(_sorted_map(c))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)) and not nested:
            c = F.to_json(c)
        made.append(c.alias(f.name))
    return df.select(*made)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    if kind in _WRITERS:
        _WRITERS[kind](df, path)
    elif kind == "parquet":
        df.write.parquet(path)
    elif kind == "jsonl":
        _text_ready(df.select(*(f"`{c}`" for c in sorted(df.columns))), nested=True).write.json(path)
    elif kind in ("csv", "tsv"):
        _text_ready(df).write.options(header=True, sep="," if kind == "csv" else "\t", escape='"', emptyValue="").csv(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def decode(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the types of ``schema``; blank is null, and what can't be read is an error."""
    made = []
    for f in schema:
        if f.name not in df.columns:
            made.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.nullif(F.col(f"`{f.name}`"), F.lit("")) if dict(df.dtypes)[f.name] == "string" else F.col(f"`{f.name}`")
        if dict(df.dtypes)[f.name] == "string" and isinstance(f.dataType, (T.MapType, T.ArrayType)):
            c = F.from_json(c, f.dataType, {"mode": "FAILFAST"})
        made.append(c.cast(f.dataType).alias(f.name))
    return df.select(*made)


_KINDS = {"session_id": T.StringType(), "learner_id": T.StringType(), "start_time": T.TimestampType(), "end_time": T.TimestampType(), "n_events": T.LongType(), "duration_s": T.DoubleType(), "event_sequence": T.ArrayType(T.StringType()), "course_id": T.StringType()}
SESSIONS = T.StructType([T.StructField(k, v) for k, v in _KINDS.items()])
_TABLES = {"events": log.EVENTS, "sessions": SESSIONS}


def _digest(df: DataFrame) -> list[int]:
    return [int(x) for x in log.fingerprint(df).first()]


def write_corpus(events: DataFrame, path: str, sessions: DataFrame | None = None, metadata: dict | None = None, *, kind: str = "parquet", report: dict | None = None, mapping: dict | None = None, annotations: DataFrame | None = None, force: bool = False) -> None:
    """A folder with events, sessions, annotations, the quality report and the mapping used; it appears whole or not at all.

    A failed quality report is refused.  The manifest has the tables' fingerprints.
    """
    if report is not None and report["status"] != "ready":
        raise ValueError(f"a corpus with a failed report is not written: {report['errors']}")
    spark = events.sparkSession
    with models.Staged(spark, path, force=force) as aside:
        manifest: dict[str, Any] = {"schema_version": SCHEMA_VERSION, "format": kind, "metadata": metadata or {}, "tables": {}}
        for name, df in (("events", events), ("sessions", sessions)):
            if df is not None:
                write_table(df.select(*(f.name for f in _TABLES[name] if f.name in df.columns)), f"{aside}/{name}", kind)
                manifest["tables"][name] = _digest(_table(spark, f"{aside}/{name}", kind, name))
        if annotations is not None:
            A.checked(annotations).select(*A.COLUMNS).orderBy(*A.KEY).write.options(header=True, escape='"', emptyValue="").csv(f"{aside}/annotations.csv")
            manifest["annotations"] = _digest(_annotations(spark, f"{aside}/annotations.csv"))
        for name, data in (("quality_report.json", report), ("mapping.used.json", mapping)):
            if data is not None:
                models.write_json(spark, f"{aside}/{name}", data)
        models.write_json(spark, f"{aside}/{models.MANIFEST}", manifest)


def _table(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.schema(_TABLES[name]).option("mode", "FAILFAST").json(path)
    return decode(read_source(spark, path, kind), _TABLES[name])


def _annotations(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, ",").select(*A.COLUMNS)


def read_manifest(spark: SparkSession, path: str) -> dict:
    manifest = json.loads(models.read_text(spark, f"{path}/{models.MANIFEST}"))
    if manifest["schema_version"].split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"schema version {manifest['schema_version']} can't be read")
    return manifest


def read_corpus(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame | None, dict]:
    manifest = read_manifest(spark, path)
    tables = {n: _table(spark, f"{path}/{n}", manifest.get("format", "parquet"), n) for n in manifest["tables"]}
    if verify:
        for n, df in tables.items():
            if _digest(df) != manifest["tables"][n]:
                raise ValueError(f"the fingerprint of {n} differs")
    return tables["events"], tables.get("sessions"), manifest["metadata"]


def read_annotations(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The annotations of a corpus."""
    manifest = read_manifest(spark, path)
    if "annotations" not in manifest:
        raise ValueError(f"{path} has no annotations")
    made = _annotations(spark, f"{path}/annotations.csv")
    if verify and _digest(made) != manifest["annotations"]:
        raise ValueError("the fingerprint of annotations differs")
    return A.checked(made)


def _columns(spark: SparkSession, path: str, *needed: str) -> DataFrame:
    rows = _delimited(spark, resolve_source(spark, path), ",")
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(learner_id, label) of a file ``learner_id,group``."""
    return _columns(spark, path, "learner_id", "group").select("learner_id", F.col("group").alias("label"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(learner_id, profile) of a file; rows that lack either are skipped, a learner with two profiles is an error."""
    rows = _columns(spark, path, "learner_id", "profile").select("learner_id", "profile").dropna().distinct()
    if rows.groupBy("learner_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a learner is assigned to two profiles")
    return rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, score), or ids alone: of a file ``id`` with ``score``, with ``flag`` (true ones are kept) or bare."""
    rows = _columns(spark, path, "id")
    if "score" in rows.columns:
        return rows.select("id", F.col("score").cast("double").alias("score"))
    if "flag" in rows.columns:
        rows = rows.filter(F.lower(F.trim("flag")).isin("1", "true", "yes", "y", "t"))
    return rows.select("id")


def chunked(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, a partition at a time on the driver."""
    if size < 1:
        raise ValueError("size must be positive")
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def daily_dominant(clicks: DataFrame, *by: str, kind: str, weight: str) -> DataFrame:
    """One row for each group (a learner's day): the kind with most weight, the first in the alphabet on ties, and all weight."""
    sums = clicks.groupBy(*by, kind).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*by).agg(F.min_by(kind, F.struct(-F.col("w"), F.col(kind))).alias(kind), F.sum("w").alias(weight))


def sample_learners(events: DataFrame, n: int, seed: int) -> DataFrame:
    """The events of ``n`` learners, drawn by a hash of the seed."""
    from tidemark.functions.randomness import uniform

    chosen = events.select("learner_id").distinct().orderBy(uniform(seed, "learners", F.col("learner_id")), "learner_id").limit(n)
    return events.join(chosen, "learner_id", "left_semi")
