"""Requested changes to a model, as a checked specification; experiments that apply and measure them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import at_least, number, table, whole
from tidemark.operators import generate as G

#: The parts of a specification, and the forms of the last two.
WEIGHTS, DWELL, LENGTH, VISITS = "event_weights", "dwell_scale", "session_length", "sessions_per_learner"
_FORMS = {LENGTH: {"scale": at_least(0, number, strict=True), "fixed": at_least(1, whole)}, VISITS: {"mean": at_least(0, number, strict=True), "fixed": at_least(1, whole)}}


def controls(spec: Mapping[str, Any] | None) -> dict[str, dict[str, Any]]:
    """A checked specification without its empty parts."""
    out: dict[str, dict[str, Any]] = {}
    for part, value in (spec or {}).items():
        try:
            if part in (WEIGHTS, DWELL):
                made = table(at_least(0, number, strict=part == DWELL))(value or {})
            elif part in _FORMS:
                made = {k: _FORMS[part][k](v) for k, v in (value or {}).items()}
                if len(made) > 1:
                    raise ValueError(f"one of {', '.join(_FORMS[part])}")
            else:
                raise ValueError("no such control")
        except (TypeError, ValueError, KeyError, AttributeError) as e:
            raise ValueError(f"controls.{part}: {e}") from None
        if made:
            out[part] = made
    return out


def _scaled(counts: DataFrame, key: str, factor: float) -> DataFrame:
    """Counts of sizes times a factor, rounded half to even, one at least."""
    return counts.groupBy(F.greatest(F.lit(1), F.bround(F.col(key) * factor)).cast("bigint").alias(key)).agg(F.sum("n").alias("n"))


def _one(like: DataFrame, key: str, size: int) -> DataFrame:
    return like.sparkSession.range(1).select(F.lit(size).cast("bigint").alias(key), F.lit(1).cast("bigint").alias("n"))


def apply(model: G.Model, spec: Mapping[str, Any]) -> G.Model:
    """A model with the controls applied, which it records.

    A token of weight or dwell that the model does not know, and weights that
    leave no token, are errors.
    """
    wanted = controls(spec)
    named = {t for part in (WEIGHTS, DWELL) for t in wanted.get(part, {})} - {"*"}
    if named or "*" in wanted.get(WEIGHTS, {}):
        known = {r["token"] for r in model["tokens"].filter(F.col("token").isin(*named)).select("token").collect()} if named else set()
        if missing := sorted((named | ({"*"} & set(wanted.get(WEIGHTS, {})))) - known):
            raise ValueError(f"the model does not know {', '.join(missing)}")
    out = model.with_settings(controls=[*model.settings.get("controls", []), wanted]) if wanted else model
    if wanted.get(WEIGHTS) and model.settings.get("generator") == "gru":
        raise ValueError("a gru model takes no weights of tokens")
    if WEIGHTS in wanted:
        out = G.reweight(out, wanted[WEIGHTS])
        if out["tokens"].limit(1).count() == 0:
            raise ValueError("the weights leave no token")
    if DWELL in wanted:
        old = out.settings.get("dwell_scale", {})
        out = out.with_settings(dwell_scale=old | {t: old.get(t, 1.0) * x for t, x in wanted[DWELL].items()})
    for mode, value in wanted.get(LENGTH, {}).items():
        lengths = _one(out["lengths"], "len", value) if mode == "fixed" else _scaled(out["lengths"], "len", value)
        if mode == "scale" and out.settings.get("length_model") == "poisson":
            mean = out["lengths"].agg(F.sum(F.col("len") * F.col("n")) / F.sum("n")).first()[0]
            lengths = G.poisson_lengths(out["lengths"].sparkSession, max(1.0, mean * value) - 1)
        out = out.with_tables(lengths=lengths)
    for mode, value in wanted.get(VISITS, {}).items():
        visits = out["per_learner"]
        mean = visits.agg(F.sum(F.col("sessions") * F.col("n")) / F.sum("n")).first()[0] or 1.0
        out = out.with_tables(per_learner=_one(visits, "sessions", value) if mode == "fixed" else _scaled(visits, "sessions", value / mean))
    return out


def check_sizes(baseline: DataFrame, controlled: DataFrame, spec: Mapping[str, Any], tolerance: float = 0.2) -> DataFrame:
    """(control, target, before, after, status) of fixed lengths and of sessions per learner; the rest is check_controls()."""
    wanted = controls(spec)
    items = []
    sizes = lambda log: log.groupBy("learner_id", "session_id").agg(F.count("*").alias("n"))
    own = {"before": sizes(baseline), "after": sizes(controlled)}
    mean = {k: v.agg(F.avg("n").alias(k)) for k, v in own.items()}
    visits = {k: v.groupBy("learner_id").agg(F.count("*").alias("n")) for k, v in own.items()}
    for mode, value in wanted.get(LENGTH, {}).items():
        if mode == "fixed":
            off = own["after"].agg(F.coalesce(F.sum((F.col("n") != value).cast("int")), F.lit(0)).alias("off"), F.count("*").alias("all"))
            status = F.when(F.col("all") == 0, "not_measurable").when(F.col("off") == 0, "ok").otherwise("failed")
            items.append(mean["before"].join(mean["after"]).join(off).select(F.lit(LENGTH).alias("control"), F.lit("fixed").alias("target"), "before", "after", status.alias("status")))
    for mode, value in wanted.get(VISITS, {}).items():
        both = visits["before"].agg(F.avg("n").alias("before")).join(visits["after"].agg(F.avg("n").alias("after"), F.sum((F.col("n") != value).cast("int")).alias("off"), F.max("n").alias("most"), F.count("*").alias("all")))
        # the last learner may have fewer sessions, as their number is given
        right = (F.col("off") <= 1) & (F.col("most") <= value) if mode == "fixed" else F.abs(F.col("after") / value - 1) <= tolerance
        items.append(both.select(F.lit(VISITS).alias("control"), F.lit(mode).alias("target"), "before", "after", F.when(F.col("all") == 0, "not_measurable").when(right, "ok").otherwise("failed").alias("status")))
    if not items:
        return baseline.sparkSession.createDataFrame([], "control string, target string, before double, after double, status string")
    out = items[0]
    for i in items[1:]:
        out = out.unionByName(i)
    return out.withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6))
