"""Sessions and counts over unbounded logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(stream: DataFrame, idle_timeout_s: int = 1800, late_s: int = 3600) -> DataFrame:
    """Events of each learner's session, final once the watermark passes its end (append mode)."""
    marked = stream.withWatermark("timestamp", f"{late_s} seconds")
    window = F.session_window("timestamp", f"{idle_timeout_s} seconds")
    return marked.groupBy(window.alias("w"), "learner_id").agg(F.count("*").alias("n_events"), F.max("timestamp").alias("end_time")).select("learner_id", F.col("w.start").alias("start_time"), "end_time", "n_events")


def type_counts(stream: DataFrame, every: str = "1 hour", late_s: int = 3600) -> DataFrame:
    """Events of each type in tumbling windows."""
    return stream.withWatermark("timestamp", f"{late_s} seconds").groupBy(F.window("timestamp", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
