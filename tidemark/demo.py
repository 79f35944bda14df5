"""A made-up course: learners of three kinds, whose events are drawn row by row from hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.randomness import pick, uniform
from tidemark.log import EVENTS

#: Kinds of learners (share, sessions from and to, steps, pace, chance to pass), steps of a visit with median seconds.
LEARNERS = (("steady", 0.5, 4, 8, 9, 1.0, 0.7), ("skimmer", 0.3, 2, 5, 5, 0.5, 0.5), ("struggler", 0.2, 5, 10, 12, 1.4, 0.3))
STEPS = (("home", "view", 15.0), ("reading", "view", 240.0), ("video", "video_play", 480.0), ("quiz", "attempt", 90.0), ("quiz", "submit", 20.0), ("forum", "forum_post", 300.0))
COURSE, START, SIGMA = "intro-stats", "2026-02-02", 0.5


def demo_log(spark: SparkSession, n_learners: int = 60, seed: int = 0) -> DataFrame:
    """Canonical events without sessions; visits are a day or more apart."""
    if isinstance(n_learners, bool) or not isinstance(n_learners, int) or n_learners < 1:
        raise ValueError("n_learners must be a positive whole number")
    u = lambda label, *parts: uniform(seed, label, *parts)
    run, shares = 0.0, []
    for row in LEARNERS:
        run += row[1]
        shares.append(F.struct(F.lit(run).alias("cum"), F.struct(*(F.lit(v).alias(k) for k, v in zip(("kind", "share", "least", "most", "steps", "pace", "passes"), row, strict=True))).alias("token")))
    who = F.col("id")
    people = spark.range(1, n_learners + 1).select(F.format_string("learner-%03d", who).alias("learner_id"), pick(F.array(*shares), u("kind", who)).alias("k"), (F.floor(u("first", who) * 7)).alias("day0"), F.when(u("device", who) < 2 / 3, "desktop").otherwise("mobile").alias("device"))
    between = lambda a, b, x: (F.col(a) + F.floor(x * (F.col(b) - F.col(a) + 1))).cast("int")
    visits = people.select("*", F.explode(F.sequence(F.lit(1), between("k.least", "k.most", u("visits", F.col("learner_id"))))).alias("visit"))
    day = F.col("day0") + (F.col("visit") - 1) * 3 + F.floor(u("gap", F.col("learner_id"), F.col("visit")) * 2)
    begun = visits.withColumn("start", F.unix_seconds(F.lit(START).cast("timestamp")) + day * 86_400 + F.floor((8 + 12 * u("hour", F.col("learner_id"), F.col("visit"))) * 3600))
    steps = begun.select("*", F.explode(F.sequence(F.lit(1), F.lit(2) + F.floor(u("length", F.col("learner_id"), F.col("visit")) * F.col("k.steps")).cast("int"))).alias("nth"))
    key = [F.col("learner_id"), F.col("visit"), F.col("nth")]
    place = F.when(F.col("nth") == 1, 0).otherwise(1 + F.floor(u("step", *key) * (len(STEPS) - 1))).cast("int")
    table = F.array(*(F.struct(F.lit(a).alias("activity"), F.lit(t).alias("type"), F.lit(s).alias("seconds")) for a, t, s in STEPS))
    made = steps.withColumn("step", F.get(table, place))
    normal: Column = F.sqrt(-2 * F.log(1 - u("radius", *key))) * F.cos(2 * math.pi * u("angle", *key))
    made = made.withColumn("took", F.greatest(F.lit(1.0), F.least(F.lit(1500.0), F.col("step.seconds") * F.col("k.pace") * F.exp(SIGMA * normal))))
    from pyspark.sql import Window

    before = Window.partitionBy("learner_id", "visit").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.timestamp_micros(((F.col("start") + F.coalesce(F.sum("took").over(before), F.lit(0.0))) * 1e6).cast("bigint"))
    submit = F.col("step.type") == "submit"
    score = F.when(submit, F.round(F.least(F.lit(1.0), u("score", *key) * 0.6 + F.col("k.passes") * 0.6), 2))
    columns = {
        "event_id": F.format_string("%s-%02d-%02d", "learner_id", "visit", "nth"), "learner_id": F.col("learner_id"), "timestamp": at, "session_id": F.lit(None).cast("string"), "activity_id": F.concat_ws("-", F.col("step.activity"), (F.col("visit") % 4 + 1).cast("string")),
        "event_type": F.col("step.type"), "course_id": F.lit(COURSE), "score": score, "success": F.when(submit, score >= 0.5), "duration_ms": F.round(F.col("took") * 1000).cast("bigint"), "metadata": F.create_map(F.lit("device"), F.col("device")),
    }
    return made.select(*(columns[f.name].alias(f.name) for f in EVENTS))
