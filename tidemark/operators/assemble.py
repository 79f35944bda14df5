"""Sampled sessions dealt to learners and laid out in time."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.randomness import derive_seed, pick, uniform
from tidemark.functions.ranking import seeded_rank
from tidemark.functions.scratch import stored
from tidemark.operators import controls, injection, manipulation
from tidemark.operators import generate as G
from tidemark.operators.calendar import Timetable, from_counts
from tidemark.operators.generate import _cumulative

#: Microseconds that a learner's sessions lie apart at least, and learners that are summed up together.
APART, BLOCK = 60_000_000, 65_536


def sessions_per_learner(seq: DataFrame) -> DataFrame:
    """(sessions, n): how many learners have so many sessions."""
    own = seq.groupBy("learner_id").agg(F.count_distinct("session_id").alias("sessions"))
    return own.groupBy("sessions").agg(F.count("*").alias("n"))


def _slots(histogram: DataFrame, n_sessions: int, seed: int) -> DataFrame:
    """(slot, learner): learners in turn take as many slots as drawn, until all slots from 1 to ``n_sessions`` are taken."""
    shares = _cumulative(histogram.withColumn("k", F.lit(0)), "k", "sessions").select("cumulative")
    drawn = histogram.sparkSession.range(n_sessions).join(F.broadcast(shares), F.lit(True)).select("id", F.floor(F.col("id") / BLOCK).alias("block"), pick(F.col("cumulative"), uniform(seed, "sessions", F.col("id"))).cast("bigint").alias("own"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy("block").agg(F.sum("own").alias("total"))
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before.orderBy("block")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("own").over(before.partitionBy("block").orderBy("id")), F.lit(0))
    placed = drawn.withColumn("first", inside).join(offsets, "block").withColumn("first", F.col("first") + F.col("offset") + 1)
    return placed.filter(F.col("first") <= n_sessions).select(F.col("id").alias("learner"), F.explode(F.sequence("first", F.least(F.col("first") + F.col("own") - 1, F.lit(n_sessions)))).alias("slot"))


def assemble(sample: DataFrame, n_sessions: int, histogram: DataFrame, calendar: Timetable, seed: int = 0) -> DataFrame:
    """(event_id, learner_id, session_id, timestamp, token) of a sample (session_id, pos, token, at_s) of ``n_sessions`` sessions.

    Starts are drawn from the calendar.  A session that would begin less than a
    minute after the end of the learner's one before begins a minute after it:
    with C the sum of lengths and minutes before, that is C + max(start - C) over
    the sessions so far, so two windows do what a loop over sessions would.
    """
    spans = sample.groupBy("session_id").agg(F.max((F.col("at_s") * 1e6).cast("bigint")).alias("span"))
    dealt = seeded_rank(spans, uniform(seed, "deal", F.col("session_id")), "session_id", "slot").join(_slots(histogram, n_sessions, seed), "slot")
    begun = calendar.draw(dealt, seed, "session_id", name="at").select("session_id", "learner", "span", F.unix_micros("at").alias("start"))
    in_turn = Window.partitionBy("learner").orderBy("start", "session_id")
    taken = begun.withColumn("taken", F.coalesce(F.sum(F.col("span") + APART).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    latest = F.max(F.col("start") - F.col("taken")).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = taken.select("session_id", F.format_string("L%06d", F.col("learner") + 1).alias("learner_id"), (F.col("taken") + latest).alias("begin"))
    at = F.timestamp_micros((F.col("begin") + (F.col("at_s") * 1e6).cast("bigint")).cast("bigint"))
    return sample.join(laid, "session_id").select(F.format_string("%s-%06d", "session_id", F.col("pos").cast("bigint")).alias("event_id"), "learner_id", "session_id", at.alias("timestamp"), "token")


def log_of(model: G.Model, n_sessions: int, seed: int = 0, *, calendar: Timetable | None = None, new_ids: bool = True) -> DataFrame:
    """A canonical log of ``n_sessions`` sessions, with tokens, of a model from fit_named().

    Starts follow ``calendar``, or the days and hours of the training log.  Each
    event gets a companion seen with its token, each learner a course by its
    share.  ``new_ids`` numbers everything anew.
    """
    plan = calendar or from_counts(model["starts"])
    rows = assemble(G.sample(model, n_sessions, seed), n_sessions, model["per_learner"], plan, seed)
    field = model.settings.get("tokenization", "event_type")
    other = "activity_id" if field == "event_type" else "event_type"
    pairs = _cumulative(model["companions"], "token", "other").withColumnRenamed("cumulative", "__others")
    courses = _cumulative(model["courses"].withColumn("k", F.lit(0)), "k", "course_id").select(F.col("cumulative").alias("__courses"))
    with_both = rows.join(pairs, "token", "left").join(F.broadcast(courses), F.lit(True), "left")
    none = lambda kind: F.lit(None).cast(kind)
    made = {
        "event_id": F.col("event_id"), "learner_id": F.col("learner_id"), "timestamp": F.col("timestamp"), "session_id": F.col("session_id"),
        field: F.col("token"), other: F.coalesce(pick(F.col("__others"), uniform(seed, "companion", F.col("event_id"))), F.col("token")),
        "course_id": F.when(F.col("__courses").isNotNull(), pick(F.col("__courses"), uniform(seed, "course", F.col("learner_id")))),
        "score": none("double"), "success": none("boolean"), "duration_ms": none("bigint"), "metadata": F.create_map().cast("map<string,string>"),
    }
    events = stored(with_both.select(*(made[c].alias(c) for c in injection.CANONICAL), "token"))
    return injection.remap_ids(events, derive_seed(seed, "ids"))[0] if new_ids else events


def experiment(model: G.Model, spec: Mapping[str, Any], n_sessions: int, seed: int = 0, *, calendar: Timetable | None = None) -> dict[str, Any]:
    """A log under ``controls`` and with ``anomalies``, its annotations, and the check against a baseline of the same seed.

    The check is taken before anomalies are put in.
    """
    if set(spec) - {"controls", "anomalies"} or not (spec.get("controls") or spec.get("anomalies") or calendar):
        raise ValueError("an experiment has controls, a calendar or anomalies, and nothing else")
    wanted = controls.controls(spec.get("controls"))
    changed = controls.apply(model, wanted)
    log = stored(log_of(changed, n_sessions, seed, calendar=calendar))
    checks = []
    if wanted:
        baseline = stored(log_of(model, n_sessions, seed, calendar=calendar))
        scale = wanted.get(controls.LENGTH, {}).get("scale")
        if wanted.get(controls.WEIGHTS) or wanted.get(controls.DWELL) or scale:
            checks.append(manipulation.check_controls(baseline, log, wanted.get(controls.WEIGHTS), wanted.get(controls.DWELL), scale))
        checks.append(controls.check_sizes(baseline, log, wanted))
    if calendar:
        spans = log.groupBy("session_id").agg(F.min("timestamp").alias("start_time"))
        found = calendar.check(spans)
        checks.append(found.select("control", "target", F.lit(None).cast("double").alias("before"), F.col("measured").alias("after"), "status"))
    out: dict[str, Any] = {"events": log, "model": changed, "check": reduce(DataFrame.unionByName, checks) if checks else None, "annotations": None, "report": None}
    if spec.get("anomalies"):
        out["events"], out["annotations"], out["report"] = injection.inject(log, spec["anomalies"], seed=derive_seed(seed, "anomalies"))
    return out
