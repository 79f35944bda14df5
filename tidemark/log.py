"""The canonical event log and its binding to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("learner_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("activity_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("course_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
KNOWN_TYPES = ("view", "attempt", "submit", "navigate", "forum_post", "video_play", "other")


def seconds(ts):
    """Exact seconds of a timestamp, as double of microseconds / 1e6."""
    return F.unix_micros(ts) / F.lit(1e6)


def from_events(table: DataFrame) -> DataFrame:
    """The clickstream table as a canonical log; course and success are derived from user and type."""
    return table.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("learner_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("activity_id"),
        "event_type",
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(4))).alias("course_id"),
        F.col("value").alias("score"),
        (F.col("event_type") != "error").alias("success"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def check(events: DataFrame, sessions: DataFrame | None = None) -> dict[str, int]:
    """Broken integrity rules and how often, by one aggregate for each table (and one join for membership)."""
    found = events.groupBy("event_id").count().agg(F.sum((F.col("count") > 1).cast("int")).alias("duplicate_event_id")).first().asDict()
    if sessions is not None:
        n = sessions.groupBy("session_id").count().agg(F.sum((F.col("count") > 1).cast("int")).alias("duplicate_session_id")).first()
        own = sessions.agg(
            F.sum((F.col("end_time") < F.col("start_time")).cast("int")).alias("negative_duration"),
            F.sum((F.abs(F.col("duration_s") - (seconds("end_time") - seconds("start_time"))) > 1e-6).cast("int")).alias("wrong_duration"),
            F.sum((F.size("event_sequence") == 0).cast("int")).alias("empty_sequence"),
        ).first()
        members = events.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("m"), F.min("learner_id").alias("lo"), F.max("learner_id").alias("hi"))
        both = members.join(sessions.select("session_id", "learner_id", "n_events"), "session_id", "full_outer").agg(
            F.sum(F.col("n_events").isNull().cast("int")).alias("unknown_session"),
            F.sum((F.coalesce("m", F.lit(0)) != F.col("n_events")).cast("int")).alias("wrong_n_events"),
            F.sum(((F.col("lo") != F.col("learner_id")) | (F.col("hi") != F.col("learner_id"))).cast("int")).alias("wrong_learner"),
        ).first()
        found |= n.asDict() | own.asDict() | both.asDict()
    return {k: int(v or 0) for k, v in found.items()}


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-independent digest of a table: count, sum and xor of row hashes of its columns in order of name; a map counts as its sorted entries.

    The sum is a 64-bit one that wraps (modulo 2 ** 64, signed), as 65,536 hashes may
    exceed it; below that it is the plain sum.
    """
    plain = lambda f: F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
    row = F.sha2(F.to_json(F.struct(*(plain(f) for f in sorted(df.schema, key=lambda f: f.name)))), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("bigint")
    low = F.lit((1 << 24) - 1)
    made = df.select(part.alias("h")).agg(F.count("*").alias("n_rows"), *(F.coalesce(x, F.lit(0).cast("bigint")).alias(n) for x, n in ((F.sum(F.shiftright("h", 24)), "high"), (F.sum(F.col("h").bitwiseAND(low)), "low"), (F.bit_xor("h"), "hash_xor"))))
    wrapped = F.shiftleft(F.col("high") + F.shiftright("low", 24), 24).bitwiseOR(F.col("low").bitwiseAND(low))
    return made.select("n_rows", wrapped.alias("hash_sum"), "hash_xor")
