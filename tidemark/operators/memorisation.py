"""How much of one log a second one repeats: sessions, whole trajectories, and detector recall by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_exposure(train: DataFrame, target: DataFrame, least: int = 3) -> DataFrame:
    """One row: target sessions of ``least`` events or more, the share with a sequence of the training log, and with one that it has once.

    Both are tables of sessions.  Sequences are counted on either side before they meet.
    """
    seen = train.groupBy("event_sequence").agg(F.count("*").alias("known"))
    asked = target.filter(F.size("event_sequence") >= least).groupBy("event_sequence").agg(F.count("*").alias("n"))
    hit = lambda c: F.round(F.try_divide(F.sum(F.when(c, F.col("n")).otherwise(0)), F.sum("n")), 6)
    return asked.join(seen, "event_sequence", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_sessions"), hit(F.col("known") >= 1).alias("match_rate"), hit(F.col("known") == 1).alias("unique_match_rate"))


def _trajectories(sessions: DataFrame) -> DataFrame:
    """A digest of each learner's ordered sessions: only digests of sequences are collected."""
    one = F.struct("start_time", "session_id", F.sha2(F.to_json("event_sequence"), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["digest"])
    return sessions.groupBy("learner_id").agg(ordered.alias("path"), F.count("*").alias("n"))


def trajectory_match(train: DataFrame, target: DataFrame) -> DataFrame:
    """One row: target learners of two sessions or more, and the share whose sessions in order are those of a training learner."""
    asked = _trajectories(target).filter("n >= 2").select("path")
    known = _trajectories(train).filter("n >= 2").select("path").distinct().withColumn("known", F.lit(1))
    return asked.join(known, "path", "left").agg(F.count("*").alias("n_learners"), F.round(F.avg(F.coalesce("known", F.lit(0)).cast("double")), 6).alias("match_rate"))


def shared_histogram(values: DataFrame, column: str, by: str, bins: int = 30) -> DataFrame:
    """(by, bin, n): counts in equal bins between the smallest and the largest value of all groups; one bin if they are equal."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins))
    return values.filter(F.col(column).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recall_by(truth: DataFrame, flagged: DataFrame, key: str, kind: str) -> DataFrame:
    """(kind, n, recall): the share of the true items of each kind that are flagged; items with two rows of a kind count once."""
    marks = flagged.select(key).distinct().withColumn("hit", F.lit(1.0))
    return truth.select(key, kind).distinct().join(marks, key, "left").groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def unknown_ids(predicted: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Predicted ids that the log does not have."""
    return predicted.select(key).distinct().join(universe.select(key), key, "left_anti")


def closest(features: DataFrame, others: DataFrame, key: str, most: int | None = None, block: int = 2_000) -> DataFrame:
    """(key, distance): from each row to the nearest of all reference rows, or an error if there are more than ``most``.

    Reference rows are compared in blocks of about ``block``: the nearest of each block, then of all.
    """
    names = [c for c in features.columns if c != key]
    if most is not None and others.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} reference rows; sample them")
    point = F.array(*(F.col(c).cast("double") for c in names))
    points = others.select(point.alias("__row")).distinct()
    place = F.pmod(F.xxhash64("__row"), F.lit(others.count() // block + 1))
    nobody = others.sparkSession.range(1).select(F.array().cast("array<array<double>>").alias("__rows"))
    table = points.groupBy(place.alias("__block")).agg(F.collect_list("__row").alias("__rows")).select("__rows").unionByName(nobody)
    apart = lambda r: F.aggregate(F.zip_with(F.col("__point"), r, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    near = features.select(key, point.alias("__point")).crossJoin(table).select(key, F.array_min(F.transform("__rows", apart)).alias("__d"))
    return near.groupBy(key).agg(F.round(F.sqrt(F.min("__d")), 5).alias("distance"))


def rarest(sessions: DataFrame) -> DataFrame:
    """Sessions whose sequence no other session has."""
    alone = F.count("*").over(Window.partitionBy("event_sequence")) == 1
    return sessions.withColumn("__alone", alone).filter("__alone").drop("__alone")
