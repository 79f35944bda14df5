"""Mapping of raw columns to the canonical log, with reasons for every row that is dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import read_file
from tidemark.functions.randomness import uniform
from tidemark.functions.ranking import seeded_rank
from tidemark.operators.profile import resolve_zone

#: Words read as true and false, required fields and the kind of each.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
REQUIRED = ("learner_id", "timestamp", "activity_id", "event_type")
KINDS = {"event_id": "string", "learner_id": "string", "timestamp": "timestamp", "session_id": "string", "activity_id": "string", "event_type": "string", "course_id": "string", "score": "double", "success": "boolean", "duration_ms": "bigint"}
_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%z": "XX", "%p": "a", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD"}


@dataclass(frozen=True)
class Spec:
    """Where a field comes from and how it is read."""

    source: str | None = None
    default: str | None = None
    format: str = "iso"
    timezone: str | None = None
    hash_salt: str | None = None


def _spec(name: str, raw: object) -> Spec:
    if isinstance(raw, str):
        return Spec(raw)
    if not isinstance(raw, dict) or set(raw) - {"source", "default", "format", "timezone", "hash"} or not isinstance(raw.get("source"), str):
        raise ValueError(f"{name} is a column, or a table with source, default, format, timezone and hash")
    salt = raw.get("hash")
    if salt is not None and (not isinstance(salt, dict) or set(salt) != {"salt"} or not salt["salt"] or KINDS.get(name) != "string"):
        raise ValueError(f"{name}: a hash has a salt, and is for text alone")
    if name != "timestamp" and ("format" in raw or "timezone" in raw):
        raise ValueError(f"{name}: only times have a format and a zone")
    default = raw.get("default")
    return Spec(raw["source"], None if default is None else str(default), raw.get("format", "iso"), raw.get("timezone"), salt and str(salt["salt"]))


@dataclass(frozen=True)
class Mapping:
    """Fields by canonical name, columns kept as metadata, columns that may go, and the zone of times without one."""

    fields: dict[str, Spec]
    metadata: tuple[str, ...] = ()
    drop: tuple[str, ...] = field(default=())
    timezone: str | None = None

    def __post_init__(self) -> None:
        if unknown := sorted(set(self.fields) - set(KINDS)):
            raise ValueError(f"no such fields: {', '.join(unknown)}")
        if twice := sorted(set(self.drop) & ({s.source for s in self.fields.values()} | set(self.metadata))):
            raise ValueError(f"columns are both used and dropped: {', '.join(twice)}")
        for zone in (self.timezone, *(s.timezone for s in self.fields.values())):
            if zone is not None:
                resolve_zone(zone)

    @classmethod
    def from_dict(cls, data: dict) -> Mapping:
        if not isinstance(data, dict) or set(data) - {"fields", "metadata", "drop", "timezone"} or not isinstance(data.get("fields"), dict) or not data["fields"]:
            raise ValueError("a mapping has fields, and may have metadata, drop and timezone")
        return cls({str(k): _spec(str(k), v) for k, v in data["fields"].items()}, tuple(data.get("metadata", ())), tuple(data.get("drop", ())), data.get("timezone"))

    @classmethod
    def from_file(cls, path: str) -> Mapping:
        return cls.from_dict(read_file(path))

    @classmethod
    def identity(cls) -> Mapping:
        """For sources that have the canonical names."""
        return cls({name: Spec(name) for name in KINDS})

    def to_dict(self) -> dict:
        """For provenance; salts are left out."""

        def plain(s: Spec) -> dict:
            given = {"source": s.source, "default": s.default, "format": None if s.format == "iso" else s.format, "timezone": s.timezone, "hash": s.hash_salt and {"salt": "<redacted>"}}
            return {k: v for k, v in given.items() if v is not None}

        return {"fields": {k: plain(s) for k, s in self.fields.items()}, "metadata": list(self.metadata), "drop": list(self.drop), "timezone": self.timezone}

    def known_columns(self) -> set[str]:
        return {s.source for s in self.fields.values() if s.source} | set(self.metadata) | set(self.drop)

    def missing_columns(self, columns: list[str]) -> list[str]:
        """Columns of required fields without a default that a source lacks."""
        return sorted(s.source for k, s in self.fields.items() if k in REQUIRED and s.source and s.default is None and s.source not in columns)


def java_pattern(text: str) -> str:
    """A strptime format as a Java pattern."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "%":
            if text[i : i + 2] not in _STRPTIME:
                raise ValueError(f"unsupported directive {text[i : i + 2]}")
            out += _STRPTIME[text[i : i + 2]]
            i += 2
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out


def pseudonymize(value: Column, salt: str) -> Column:
    """'h_' and 32 hex digits of HMAC-SHA256, in JVM functions; the pads are computed once."""
    import hashlib

    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ p for k in key)) for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.concat(F.lit("h_"), F.substring(F.sha2(F.concat(outer, first), 256), 1, 32))


def _text(column: str, kind: str | None) -> Column:
    """Trimmed text of a source column, null where it is blank; whole numbers lose their point."""
    c = F.col(f"`{column}`")
    plain = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else c.cast("string")
    return F.nullif(F.trim(plain), F.lit(""))


def _time(raw: Column, spec: Spec, zone: str | None) -> tuple[Column, Column, Column]:
    """Value, whether it has a zone of its own, and reason; the session's zone plays no part."""
    bad = F.lit("invalid_timestamp")
    if spec.format in ("epoch_s", "epoch_ms"):
        value = F.timestamp_micros((raw.try_cast("double") * (1_000_000 if spec.format == "epoch_s" else 1000)).cast("bigint"))
        return value, F.lit(True), F.when(raw.isNotNull() & value.isNull(), bad)
    zoned = raw.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") if spec.format == "iso" or "%z" in spec.format else F.lit(False)
    own = F.try_to_timestamp(raw) if spec.format == "iso" else F.try_to_timestamp(raw, F.lit(java_pattern(spec.format)))
    if spec.format == "iso":
        plain = F.try_to_timestamp(F.concat(raw, F.when(raw.contains(":"), "Z").otherwise("T00:00:00Z")))
    else:
        plain = F.try_to_timestamp(F.concat(raw, F.lit("Z")), F.lit(java_pattern(spec.format) + "XX"))
    value = F.when(zoned, own).otherwise(F.to_utc_timestamp(plain, zone) if zone else plain)
    reason = F.when(raw.isNotNull() & value.isNull(), bad)
    return value, zoned, reason if zone else reason.when(raw.isNotNull() & ~zoned, F.lit("naive_timestamp"))


def _read(name: str, spec: Spec, zone: str | None, dtype: str | None) -> tuple[Column, Column, Column]:
    """Value, reason of a failure (null if none), and whether a zone was assumed."""
    raw = _text(spec.source, dtype) if spec.source else F.lit(None).cast("string")
    kind, bad, zoned = KINDS[name], F.lit("invalid_" + KINDS[name]), F.lit(True)
    if kind != "string":
        raw = F.when(F.lower(raw) == "nan", F.lit(None)).otherwise(raw)
    raw = F.coalesce(raw, F.lit(spec.default)) if spec.default is not None else raw
    wrong = F.lit(dtype == "boolean" and kind in ("string", "double", "bigint"))  # a truth value is no text and no number
    if kind == "string":
        value, reason = (pseudonymize(raw, spec.hash_salt) if spec.hash_salt else raw), F.lit(None).cast("string")
    elif kind == "double":
        value = F.when(raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), raw.try_cast("double"))
        value = F.when(F.abs(value) < float("inf"), value)
        infinite = F.lower(raw).rlike("^[+-]?inf(inity)?$")
        reason = F.when(infinite, F.lit("not_finite")).when(raw.isNotNull() & value.isNull(), bad)
    elif kind == "bigint":
        wide = raw.try_cast("double")
        value = F.coalesce(raw.try_cast("bigint"), F.when((wide == F.floor(wide)) & (F.abs(wide) < float(2**63)), wide.try_cast("bigint")))
        reason = F.when(raw.isNotNull() & value.isNull(), bad).when(F.lit(name == "duration_ms") & (value < 0), F.lit("negative"))
    elif kind == "boolean":
        value = F.when(F.lower(raw).isin(*TRUE), True).when(F.lower(raw).isin(*FALSE), False)
        reason = F.when(raw.isNotNull() & value.isNull(), bad)
    else:
        value, zoned, reason = _time(raw, spec, spec.timezone or zone)
    reason = F.when(wrong & raw.isNotNull(), bad).otherwise(reason)
    if name in REQUIRED:
        reason = F.coalesce(reason, F.when(value.isNull(), F.lit("missing_required")))
    return value, reason, ~zoned


def apply(raw: DataFrame, mapping: Mapping, row: str = "__row") -> DataFrame:
    """Canonical columns, ``issues`` as field:reason strings and ``assumed`` (a zone was); ``row`` is the source row number."""
    made, issues, types, assumed = [], [], dict(raw.dtypes), F.lit(False)
    for name in KINDS:
        spec = mapping.fields.get(name, Spec())
        if spec.source is not None and spec.source not in types:
            spec = Spec(None, spec.default, spec.format, spec.timezone, spec.hash_salt)
        value, reason, naive = _read(name, spec, mapping.timezone, types.get(spec.source))
        if name == "event_id":
            value = F.coalesce(value, F.concat(F.lit("row-"), F.col(row).cast("string")))
        if name == "timestamp":
            assumed = naive
        made.append(value.alias(name))
        issues.append(F.when(reason.isNotNull(), F.concat(F.lit(name + ":"), reason)))
    kept = [c for c in mapping.metadata if c in types]
    bag = F.map_filter(F.create_map(*(x for c in kept for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda k, v: v.isNotNull()) if kept else F.create_map().cast("map<string,string>")
    return raw.select(row, *made, bag.alias("metadata"), F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"), assumed.alias("assumed"))


def judged(raw: DataFrame, mapping: Mapping, row: str = "__row") -> DataFrame:
    """Mapped rows with ``kept`` (no issue, first of its id), ``again`` (a later one) and ``late`` (before an earlier row of the learner)."""
    good = F.size("issues") == 0
    same = Window.partitionBy("event_id", good).orderBy(row)
    marked = apply(raw, mapping, row).withColumn("__nth", F.row_number().over(same))
    marked = marked.withColumn("kept", good & (F.col("__nth") == 1)).withColumn("again", good & (F.col("__nth") > 1)).drop("__nth")
    before = Window.partitionBy("learner_id", "kept").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("late", F.col("kept") & F.coalesce(F.col("timestamp") < F.max("timestamp").over(before), F.lit(False)))


def ingest(raw: DataFrame, mapping: Mapping, row: str = "__row", *, on_duplicate: str = "keep_first") -> tuple[DataFrame, DataFrame]:
    """Accepted events (first of each id) and the quality report (reason, n), each one pass over the source.

    A source without a required column is an error at once; with
    ``on_duplicate='error'`` reading the events fails at a repeated id.
    """
    if missing := mapping.missing_columns(raw.columns):
        raise ValueError(f"the source lacks {', '.join(missing)}")
    marked = judged(raw, mapping, row)
    n = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    kept = F.col("kept")
    reasons = F.concat("issues", F.array(F.lit("rows_read")), n(kept, "rows_kept"), n(F.col("again"), "duplicate_event_id"), n(F.col("late"), "out_of_order"), n(kept & F.col("assumed"), "naive_timezone"))
    report = marked.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    if on_duplicate == "error":
        stop = F.when(F.col("again"), F.raise_error(F.lit("a row repeats an earlier event_id"))).otherwise(kept)
        marked = marked.withColumn("kept", stop.cast("boolean"))
    return marked.filter("kept").drop(row, "issues", "assumed", "kept", "again", "late"), report


#: Rows with issues that a report shows.
SAMPLES = 100


def quality_report(raw: DataFrame, mapping: Mapping, source: str = "", row: str = "__row") -> dict:
    """Counts, coverage of fields, samples of issues (never values), warnings and errors, for a file beside the corpus."""
    marked = judged(raw, mapping, row)
    names = sorted({*mapping.fields, "event_id"})
    some = marked.agg(F.count("*").alias("read"), F.sum(F.col("kept").cast("bigint")).alias("kept"), *(F.avg(F.when(F.col("kept"), F.col(c).isNotNull().cast("double"))).alias(f"c_{c}") for c in names)).first()
    counts = {r["reason"]: r["n"] for r in ingest(raw, mapping, row)[1].collect()}
    listed = marked.select(row, F.explode("issues").alias("issue")).orderBy(row, "issue").limit(SAMPLES).collect()
    own = ("rows_read", "rows_kept", "duplicate_event_id", "out_of_order", "naive_timezone")
    by_code: dict[str, int] = {}
    for reason, n in counts.items():
        if reason not in own:
            code = reason.partition(":")[2]
            by_code[code] = by_code.get(code, 0) + n
    read, kept = some["read"], int(some["kept"] or 0)
    twice, naive, late = (counts.get(x, 0) for x in ("duplicate_event_id", "naive_timezone", "out_of_order"))
    unmapped = sorted(set(raw.columns) - mapping.known_columns() - {row})
    warnings = [text for n, text in ((read - kept, f"{read - kept} of {read} rows were dropped"), (twice, f"{twice} rows repeated an earlier event_id"), (naive, f"{naive} times without a zone were given the mapping's"), (len(unmapped), f"{len(unmapped)} source columns were not mapped")) if n]
    errors = ["the source has no rows"] if read == 0 else ["no row gave a valid event"] if kept == 0 else []
    return {
        "status": "failed" if errors else "ready", "source": source, "summary": {"rows_read": read, "rows_kept": kept, "rows_dropped": read - kept},
        "field_coverage": {c: float(some[f"c_{c}"] or 0.0) for c in names}, "timestamp_issues": {"naive_timezone_assumed": naive, "out_of_order": late}, "duplicate_events": {"dropped": twice},
        "row_issues": {"counts": dict(sorted(by_code.items())), "samples": [dict(zip(("row", "field", "code"), (r[row], *r["issue"].split(":")), strict=True)) for r in listed]},
        "unmapped_columns": unmapped, "warnings": warnings, "errors": errors,
    }


def numbered(rows: DataFrame, name: str = "__row", first: int = 1) -> DataFrame:
    """Rows of a scan of files with their number, in order of files and of lines, whatever the partitions.

    Only the table of the files' splits, one row each, is ordered in one task.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    inside = Window.partitionBy("__file", "__block").orderBy("__at")
    sizes = placed.groupBy("__file", "__block").agg(F.count("*").alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__file", "__block", below.alias("__below"))
    return placed.withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(offsets), ["__file", "__block"]).select(*rows.columns, (F.col("__below") + F.col("__nth") + (first - 1)).alias(name))


def normalize_types(events: DataFrame, known: tuple[str, ...], unknown: str = "preserve") -> DataFrame:
    """Unknown event types are kept, become 'other' (also called map_to_other), or make the row go."""
    unknown = "other" if unknown == "map_to_other" else unknown
    fits = F.col("event_type").isin(*known)
    if unknown == "reject":
        return events.filter(fits)
    return events.withColumn("event_type", F.when(fits, F.col("event_type")).otherwise("other")) if unknown == "other" else events


def strip_metadata(events: DataFrame, *keys: str) -> DataFrame:
    return events.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.isin(*keys)))


def remap_ids(events: DataFrame, seed: int) -> DataFrame:
    """(learner_id, new_id): shuffled L-numbers."""
    learners = events.select("learner_id").distinct()
    ranked = seeded_rank(learners, uniform(seed, "remap", F.col("learner_id")), "learner_id")
    return ranked.select("learner_id", F.format_string("L%06d", "rank").alias("new_id"))
