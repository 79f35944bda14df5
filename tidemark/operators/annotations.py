"""Ground truth about learners, sessions and events, as a table of strings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the table in files, and what they may hold.
COLUMNS = ("level", "id", "annotation", "type", "category", "value", "parameters")
LEVELS = ("learner", "session", "event")
KINDS = ("anomaly", "profile", "outcome")
CATEGORIES = ("invalid_workflow", "unusual_valid")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
KEY = ["level", "id", "annotation", "type"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(ids: DataFrame, level: str, annotation: str, kind: str | Column, *, category: str | Column | None = None, value: Column | None = None, parameters: Column | None = None) -> DataFrame:
    """An annotation of every ``id`` of a table; value and parameters are written as JSON."""
    column = lambda c: c if isinstance(c, Column) else F.lit(c).cast("string")
    return ids.select(F.lit(level).alias("level"), F.col("id").cast("string").alias("id"), F.lit(annotation).alias("annotation"), column(kind).alias("type"), column(category).alias("category"), (F.lit("1") if value is None else value).alias("value"), (F.lit("{}") if parameters is None else parameters).alias("parameters"))


def faults(table: DataFrame) -> dict[str, int]:
    """How many rows break which rule; one aggregate, and one for repeated facts."""
    n = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("int")), F.lit(0)).alias(name)
    anomaly = F.col("annotation") == "anomaly"
    broken = table.agg(
        n(~F.col("level").isin(*LEVELS), "level"), n(~F.col("annotation").isin(*KINDS), "annotation"), n(F.coalesce("id", F.lit("")) == "", "id"), n(F.coalesce("type", F.lit("")) == "", "type"),
        n(F.when(anomaly, ~F.coalesce("category", F.lit("")).isin(*CATEGORIES)).otherwise(F.col("category").isNotNull()), "category"),
        n(F.try_parse_json("value").isNull(), "value"), n(F.try_parse_json("parameters").isNull(), "parameters"),
    ).first().asDict()
    twice = table.groupBy(*KEY).count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("int")), F.lit(0)).alias("n")).first()["n"]
    return {k: int(v) for k, v in (broken | {"duplicate": twice}).items() if v}


def checked(table: DataFrame) -> DataFrame:
    if found := faults(table):
        raise ValueError(f"annotations with faults: {found}")
    return table


def together(*tables: DataFrame) -> DataFrame:
    """All rows; a fact that two tables have is an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return checked(out)


def anomalies(table: DataFrame, level: str | None = None, *, kind: str | None = None, category: str | None = None) -> DataFrame:
    """Anomaly rows of a level, type and category, where given."""
    out = table.filter("annotation = 'anomaly'")
    for column, wanted in (("level", level), ("type", kind), ("category", category)):
        out = out if wanted is None else out.filter(F.col(column) == wanted)
    return out


def anomalous_ids(table: DataFrame, level: str, **options) -> DataFrame:
    return anomalies(table, level, **options).select("id").distinct()


def remap(table: DataFrame, mappings: Mapping[str, DataFrame]) -> DataFrame:
    """Ids by the tables (old, new) of each level; reading the result fails where an id has none."""
    known = None
    for level, m in mappings.items():
        one = m.select(F.lit(level).alias("level"), F.col("old").cast("string").alias("id"), F.col("new").cast("string").alias("__new"))
        known = one if known is None else known.unionByName(one)
    missing = F.raise_error(F.lit("an annotation's id has no new one")).cast("string")
    return table.join(known, ["level", "id"], "left").withColumn("id", F.coalesce("__new", missing)).select(*COLUMNS)


def unknown(table: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose id the log does not have."""
    ids = [events.select(F.lit(level).alias("level"), F.col(f"{level}_id").alias("id")).filter("id is not null").distinct() for level in LEVELS]
    return table.join(ids[0].unionByName(ids[1]).unionByName(ids[2]), ["level", "id"], "left_anti")


def check_against(table: DataFrame, events: DataFrame) -> None:
    n = unknown(table, events).count()
    if n:
        raise ValueError(f"{n} annotations name ids that the log does not have")


def summary(table: DataFrame) -> DataFrame:
    """(level, type, category, n) of the anomalies."""
    return anomalies(table).groupBy("level", "type", "category").agg(F.count("*").alias("n"))
