"""Where two logs differ, component by component; one frame with ``side`` ('a' real, 'b' synthetic) goes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import quantiles
from tidemark.operators.validation import METRICS, in_session

#: Metrics that are taken group by group.
GROUP_METRICS = ("event_type_tvd", "session_length_ks", "interevent_time_ks", "bigram_tvd")
LONG = 30
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _shares(rows: DataFrame, every: Column | None = None) -> DataFrame:
    """(key, share_a, share_b, gap) of rows (side, key); keys of ``every`` that neither side has are 0."""
    n = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = rows.groupBy("key").agg(n("a").alias("na"), n("b").alias("nb"))
    if every is not None:
        counts = rows.sparkSession.range(1).select(F.explode(every).alias("key")).join(counts, "key", "left")
    part = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.sum(c).over(Window.partitionBy())), F.lit(0.0))
    both = counts.select("key", part("na").alias("a"), part("nb").alias("b"))
    return both.select("key", F.round("a", 6).alias("share_a"), F.round("b", 6).alias("share_b"), F.round(F.col("b") - F.col("a"), 6).alias("gap"), F.abs(F.round(F.col("b") - F.col("a"), 12)).alias("__far"))


def tokens(seq: DataFrame) -> DataFrame:
    """Share of each token, and the median time after it."""
    gap = (F.lead(F.unix_micros("timestamp")).over(in_session()) - F.unix_micros("timestamp")) / 1e6
    dwell = quantiles(seq.select("side", "token", gap.alias("x")), F.col("x"), {"m": 0.5}, ("side", "token"))
    dwell = dwell.groupBy(F.col("token").alias("key")).agg(*(F.round(F.max(F.when(F.col("side") == s, F.col("m"))), 4).alias(f"dwell_{s}") for s in ("a", "b")))
    return _shares(seq.select("side", F.col("token").alias("key"))).drop("__far").join(dwell, "key", "left")


def transitions(seq: DataFrame, top: int = 10) -> DataFrame:
    """The pairs of tokens whose shares differ most."""
    pairs = seq.select("side", F.col("token").alias("t"), F.lead("token").over(in_session()).alias("u")).filter("u is not null")
    return _shares(pairs.select("side", F.concat_ws(" > ", "t", "u").alias("key"))).orderBy(F.desc("__far"), "key").limit(top).drop("__far")


def _sessions(seq: DataFrame) -> DataFrame:
    return seq.groupBy("side", "learner_id", "session_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("start_time"))


def lengths(seq: DataFrame) -> DataFrame:
    """Shares of session lengths, long ones together."""
    return _shares(_sessions(seq).select("side", F.when(F.col("n") >= LONG, f"{LONG}+").otherwise(F.col("n").cast("string")).alias("key"))).drop("__far")


def hours(seq: DataFrame, zone: str = "UTC") -> DataFrame:
    local = F.from_utc_timestamp(F.col("start_time"), zone)
    return _shares(_sessions(seq).select("side", F.hour(local).cast("string").alias("key")), F.array(*(F.lit(str(h)) for h in range(24)))).drop("__far")


def weekdays(seq: DataFrame, zone: str = "UTC") -> DataFrame:
    local = F.from_utc_timestamp(F.col("start_time"), zone)
    return _shares(_sessions(seq).select("side", F.date_format(local, "EEE").alias("key")), F.array(*(F.lit(d) for d in DAYS))).drop("__far")


def groups(seq: DataFrame) -> DataFrame:
    """(label, sessions_a, sessions_b, metrics) of events with ``label``; a label that one side lacks has no metrics.

    Every metric runs over one label at a time; labels are few, and listed on the driver.
    """
    n = lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("session_id"))).alias(f"sessions_{s}")
    sizes = seq.groupBy("label").agg(n("a"), n("b"))
    out = None
    for r in sizes.orderBy("label").collect():
        own = seq.filter(F.col("label") == r["label"])
        row = own.sparkSession.createDataFrame([(r["label"], r["sessions_a"], r["sessions_b"])], "label string, sessions_a bigint, sessions_b bigint")
        for name in GROUP_METRICS:
            value = METRICS[name](own, own).select(F.col("value").cast("double").alias(name)) if r["sessions_a"] and r["sessions_b"] else own.sparkSession.createDataFrame([(None,)], f"{name} double")
            row = row.join(value, F.lit(True), "left")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else sizes


def compare(seq: DataFrame, *, by: bool = False, zone: str = "UTC", top: int = 10) -> dict[str, DataFrame]:
    """All tables; ``by`` takes groups of the column ``label``."""
    made = {"tokens": tokens(seq), "transitions": transitions(seq, top), "lengths": lengths(seq), "hours": hours(seq, zone), "weekdays": weekdays(seq, zone)}
    return made | ({"groups": groups(seq)} if by else {})
