"""Sessions from explicit ids, idle gaps, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("timestamp", "event_id")


def sessionize(events: DataFrame, *, strategy: str = "composite", idle_timeout_s: float = 1800, strict: bool | None = None) -> DataFrame:
    """``events`` with session ids.

    A gap greater than the timeout starts a new session ``<learner>:s<k>``.
    ``explicit`` takes the ids there are, and reading the result fails where one
    is missing; ``composite`` keeps them for learners all of whose events have
    one and derives them for the others.  One exchange by learner serves the
    composite decision, the gaps and the running count.  A session that holds two
    learners, by an id that is given twice or equal to a derived one, is an error
    with ``strict``, which takes an exchange by session.
    """
    if idle_timeout_s <= 0:
        raise ValueError("idle_timeout_s must be positive")
    if strategy == "explicit":
        made = F.coalesce(F.col("session_id"), F.raise_error(F.lit("explicit sessions need an id on every event")).cast("string"))
        named = events.withColumn("session_id", made)
        return named if strict is False else _of_one_learner(named)
    if strategy not in ("composite", "idle_timeout"):
        raise ValueError(f"unknown strategy {strategy!r}")
    learner = Window.partitionBy("learner_id")
    ordered = learner.orderBy(*ORDER)
    gap = F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(ordered)
    marked = events.withColumn("__new", (gap.isNull() | (gap > round(idle_timeout_s * 1_000_000))).cast("int"))
    numbered = marked.withColumn("__k", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    made = F.concat_ws("", F.col("learner_id"), F.lit(":s"), F.col("__k").cast("string"))
    if strategy == "composite":
        whole = F.min(F.col("session_id").isNotNull()).over(learner)
        made = F.when(whole, F.col("session_id")).otherwise(made)
    cut = numbered.withColumn("session_id", made).drop("__new", "__k")
    return _of_one_learner(cut) if strict else cut


def _of_one_learner(events: DataFrame) -> DataFrame:
    """``events``; reading them fails where a session holds two learners."""
    session = Window.partitionBy("session_id")
    mixed = F.min("learner_id").over(session) != F.max("learner_id").over(session)
    return events.withColumn("session_id", F.when(mixed, F.raise_error(F.lit("a session holds two learners")).cast("string")).otherwise(F.col("session_id")))


def conflicts(events: DataFrame) -> DataFrame:
    """Sessions that hold more than one learner."""
    return events.filter("session_id is not null").groupBy("session_id").agg(F.count_distinct("learner_id").alias("n_learners")).filter("n_learners > 1")


def sessions(events: DataFrame, token: str = "event_type") -> DataFrame:
    """One row for each session; the dominant course is the commonest one, the first seen on ties."""
    own = events.filter("session_id is not null")
    item = F.struct(F.col("timestamp"), F.col("event_id"), F.col(token).alias("token"), F.col("course_id").alias("course"))
    made = own.groupBy("session_id", "learner_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    courses = F.filter(F.transform("items", lambda x: x["course"]), lambda c: c.isNotNull())
    scored = F.transform(F.array_distinct("courses"), lambda c: F.struct(F.size(F.filter("courses", lambda x: x == c)).alias("n"), (-F.array_position("courses", c)).alias("first"), c.alias("course")))
    shaped = made.select("session_id", "learner_id", "items", courses.alias("courses"))
    return shaped.select(
        "session_id",
        "learner_id",
        F.element_at("items", 1)["timestamp"].alias("start_time"),
        F.element_at("items", -1)["timestamp"].alias("end_time"),
        F.size("items").cast("bigint").alias("n_events"),
        ((F.unix_micros(F.element_at("items", -1)["timestamp"]) - F.unix_micros(F.element_at("items", 1)["timestamp"])) / 1e6).alias("duration_s"),
        F.transform("items", lambda x: x["token"]).alias("event_sequence"),
        F.get(F.array_sort(scored, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise((b["first"] - a["first"]).cast("int"))), F.lit(0))["course"].alias("course_id"),
    )


def participants(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(learner_id, course_ids) over events and, where given, sessions."""
    own = events.select("learner_id", "course_id")
    every = own if sessions is None else own.unionByName(sessions.select("learner_id", "course_id"))
    return every.groupBy("learner_id").agg(F.array_sort(F.collect_set("course_id")).alias("course_ids"))
