"""Tables that several later steps read, stored once where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; a folder of this machine only where that is unset and the session is one process."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or _LOCAL.setdefault(app, 'file://' + tempfile.mkdtemp(prefix='tidemark-'))).rstrip('/')}/tables-{app}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df``, read from a file; what is later filtered by a value of ``by`` reads only the rows that have it."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
