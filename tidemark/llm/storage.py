"""Shared scratch tables, the only way lineage is cut here.

A table is written below ``spark.checkpoint.dir`` so that every executor can
read it again after another one is lost.  Only where that setting is absent and
the session runs in one process (unit tests) a local folder is taken.  Tables
that a result still reads stay; ``clean`` deletes all of an application.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ESTIMATE = 1 << 60
_LOCAL: dict[str, str] = {}
_RECORDS = threading.local()


def shared_root(spark: SparkSession) -> str:
    """Folder for scratch tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{_own(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_RECORDS, "open", []):
        paths.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are given out meanwhile in this thread."""
    _RECORDS.open = [*getattr(_RECORDS, "open", []), []]
    try:
        yield _RECORDS.open[-1]
    finally:
        _RECORDS.open = _RECORDS.open[:-1]


def discard(paths: list[str], kept: DataFrame) -> None:
    """Delete scratch tables, but for those that ``kept`` reads."""
    if paths:
        plain = lambda x: x.split(":", 1)[-1].lstrip("/")
        read = {plain(f).rsplit("/", 1)[0] for f in kept.inputFiles()}
        for path in paths:
            if plain(path) not in read:
                remove(kept.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them can't be read any more."""
    remove(spark, _own(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the scratch files below a stored table that no one reads any more."""
    spark = df.sparkSession
    own = _own(spark)
    mark = own.split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{mark}/" in folder:
            remove(spark, f"{own}/{folder.split(f'{mark}/', 1)[1]}")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a table (file bytes for a scan); where it has none, the bytes of the strings are summed."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < NO_ESTIMATE:
        return size
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.agg(F.sum(sum(texts, F.lit(8)).cast("bigint"))).first()[0] or 0)


def parts_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """A number of parts in proportion to the input, so that each stays of one size."""
    return max(least, math.ceil(input_bytes(df) / bytes_each))
