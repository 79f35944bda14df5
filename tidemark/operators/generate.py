"""Seeded sequence generators, controls and anomalies.

Every draw is a hash of seed, label and entity, so a sample is the same on any
number of partitions.  Models are small tables, sent to executors after a check
of their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import at_least, number, one_of, optional, whole

from tidemark.functions.randomness import SEPARATOR, pick, uniform
from tidemark.functions.ranking import order_statistics, quantiles, seeded_rank
from tidemark.functions.scratch import stored
from tidemark.operators import neural
from tidemark.operators.sequences import START, in_session, probabilities, transitions

#: Rows that a model table may have to be sent to every executor.
MOST_MODEL_ROWS = 1_000_000
#: Order statistics kept of observed gaps; draws of a gamma variate, of which one fails in twenty at most.
SKETCH, TRIES = 1000, 12


def _cumulative(counts: DataFrame, key: str, value: str = "token") -> DataFrame:
    """One row for each key: its values with cumulative shares, in order of the value."""
    w = Window.partitionBy(key)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.select(key, value, (F.sum("n").over(up) / F.sum("n").over(w)).alias("cum"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cum", F.col(value).alias("token")))).alias("cumulative"))


def supported_order(seq: DataFrame, order: int, backoff: bool = False) -> int:
    """The order if some session is longer than it; else an error or, with ``backoff``, one less than the longest, one at least."""
    longest = seq.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > order:
        return order
    if not backoff:
        raise ValueError(f"order {order} needs sessions longer than {order} events; the longest has {longest}")
    return max(longest - 1, 1)


class Model(dict[str, DataFrame]):
    """Tables of a fitted generator by name, with the settings they were fitted under."""

    def __init__(self, tables: Mapping[str, DataFrame], settings: Mapping[str, Any]):
        super().__init__(tables)
        self.settings = dict(settings)

    def with_tables(self, **tables: DataFrame) -> Model:
        return Model(self | tables, self.settings)

    def with_settings(self, **settings: Any) -> Model:
        return Model(self, self.settings | settings)


FAMILIES = ("empirical", "lognormal", "gamma", "exponential", "constant")
_TIMES = one_of(*FAMILIES)
_CHAIN = {"order": (at_least(1, whole), 1), "smoothing_alpha": (at_least(0, number), 0.0), "on_insufficient_data": (one_of("fail", "backoff"), "fail")}


def _share(value: Any) -> float:
    made = at_least(0, number)(value)
    if made >= 1:
        raise ValueError("less than 1")
    return made


_EVERY = {"length_model": (one_of("empirical", "poisson", "fixed"), "empirical"), "fixed_length": (optional(at_least(1, whole)), None)}
#: The settings of each generator and their defaults.
HYPERPARAMETERS: dict[str, dict[str, tuple[Callable[[Any], Any], Any]]] = {
    "independent": _EVERY,
    "markov": _EVERY | _CHAIN,
    "semi_markov": _EVERY | _CHAIN | {"timing_family": (_TIMES, "empirical"), "min_samples": (at_least(1, whole), 5)},
    "gru": _EVERY
    | {"embedding_dim": (at_least(1, whole), 32), "hidden_dim": (at_least(1, whole), 64), "timing": (one_of("binned", "mixture"), "binned"), "n_bins": (at_least(1, whole), 32), "n_mixtures": (at_least(1, whole), 3)}
    | {"epochs": (at_least(1, whole), 30), "batch_size": (at_least(1, whole), 64), "learning_rate": (at_least(1e-9, number), 0.003), "max_length": (at_least(1, whole), 256)}
    | {"validation_fraction": (_share, 0.1), "patience": (at_least(1, whole), 3), "seed": (at_least(0, whole), 0), "threads": (at_least(1, whole), 1)},
}


def hyperparameters(name: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """All settings of a generator; unknown ones and wrong values are errors."""
    known = HYPERPARAMETERS[name]
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{name} has no {', '.join(unknown)}")
    out = {}
    for key, (check, default) in known.items():
        try:
            out[key] = check(given[key]) if key in given else default
        except (TypeError, ValueError) as e:
            raise ValueError(f"{name}: {key} takes {e}") from None
    if out["length_model"] == "fixed" and out["fixed_length"] is None:
        raise ValueError("length_model 'fixed' needs fixed_length")
    return out


def fit_lengths(seq: DataFrame, model: str = "empirical", fixed: int | None = None) -> DataFrame:
    """(len, n): as observed, one fixed length, or the weights of 1 + Poisson(mean - 1)."""
    own = seq.groupBy("session_id").agg(F.count("*").alias("len"))
    if model == "empirical":
        return own.groupBy("len").agg(F.count("*").alias("n"))
    if model == "fixed":
        return seq.sparkSession.range(1).select(F.lit(fixed).cast("bigint").alias("len"), F.lit(1).cast("bigint").alias("n"))
    rate = max(0.0, float(own.agg(F.avg("len")).first()[0] or 1.0) - 1.0)
    return poisson_lengths(seq.sparkSession, rate)


def poisson_lengths(spark: SparkSession, rate: float) -> DataFrame:
    """Weights of 1 + Poisson(rate), up to where nothing is left of them."""
    most = int(rate + 12 * math.sqrt(rate) + 20)
    weights = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0) for k in range(most + 1)]
    return spark.createDataFrame([(k + 1, w) for k, w in enumerate(weights) if w > 0], "len bigint, n double")


def fit_gaps(seq: DataFrame, family: str = "empirical", least: int = 1) -> DataFrame:
    """(token, n, family, a, b, points): seconds to the next event after each token with ``least`` gaps, and after any (null).

    a and b are mu and sigma, shape and scale, the mean, or the median.  What a
    family can't be fitted to, such as gaps that are all 0, becomes constant.
    """
    gap = (F.lead(F.unix_micros("timestamp")).over(in_session(seq)) - F.unix_micros("timestamp")) / 1e6
    own = seq.select("token", gap.alias("x")).filter("x >= 0")
    both = own.unionByName(own.withColumn("token", F.lit(None).cast("string")))
    x, logs = F.col("x"), F.when(F.col("x") > 0, F.log("x"))
    sums = both.groupBy("token").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("spread"), F.avg(logs).alias("mu"), F.stddev_pop(logs).alias("sigma"))
    middle = quantiles(both, x, {"median": 0.5}, ("token",)) if family == "constant" else None
    points = order_statistics(both, x, SKETCH, ("token",)) if family == "empirical" else None
    made = sums.filter(F.col("token").isNull() | (F.col("n") >= least))
    for more in (middle, points):
        if more is not None:
            named = more.drop("n").withColumnRenamed("token", "__token")
            made = made.join(named, F.col("token").eqNullSafe(F.col("__token"))).drop("__token")
    none = F.lit(None).cast("double")
    able = {"empirical": F.lit(True), "constant": F.lit(False), "exponential": F.col("mean") > 0, "lognormal": F.col("mu").isNotNull(), "gamma": (F.col("mean") > 0) & (F.col("spread") > 0)}[family]
    still = {"constant": F.col("median") if middle is not None else none, "lognormal": F.lit(0.0), "exponential": F.lit(0.0)}.get(family, F.col("mean"))
    a = {"exponential": F.col("mean"), "lognormal": F.col("mu"), "gamma": F.col("mean") * F.col("mean") / F.col("spread")}.get(family, none)
    b = {"lognormal": F.col("sigma"), "gamma": F.col("spread") / F.col("mean")}.get(family, none)
    return made.select("token", "n", F.when(able, F.lit(family)).otherwise("constant").alias("family"), F.when(able, a).otherwise(still).alias("a"), F.when(able, b).alias("b"), (F.col("points") if points is not None else F.lit(None).cast("array<double>")).alias("points"))


_READ = ("learner_id", "session_id", "event_id", "timestamp", "token", "event_type", "activity_id", "course_id")


def read_of(seq: DataFrame) -> DataFrame:
    """What fitting reads of a log."""
    return seq.select(*(c for c in _READ if c in seq.columns))


def _kept(seq: DataFrame) -> DataFrame:
    """read_of(), stored, as each table of a model reads it again."""
    return stored(read_of(seq))


def _tables(seq: DataFrame, order: int, alpha: float, length: str, fixed: int | None, timing: str, least: int) -> Model:
    every = [transitions(seq, k, SEPARATOR) for k in range(1, order + 1)]
    tables = {"tokens": seq.groupBy("token").agg(F.count("*").alias("n")), "lengths": fit_lengths(seq, length, fixed), "transitions": reduce(DataFrame.unionByName, every), "gaps": fit_gaps(seq, timing, least)}
    return Model(tables, {"order": order, "smoothing_alpha": alpha, "timing_family": timing, "min_samples": least, "length_model": length})


def fit(seq: DataFrame, order: int = 1, *, alpha: float = 0.0, length: str = "empirical", fixed: int | None = None, timing: str = "empirical", least: int = 1, kept: bool = False) -> Model:
    """Token, length and gap tables, and the transitions of all orders up to ``order``; a log that is ``kept`` is not stored again."""
    return _tables(seq if kept else _kept(seq), order, alpha, length, fixed, timing, least)


def with_network(model: Model, seq: DataFrame, h: Mapping[str, Any]) -> Model:
    """A model with the recurrent network that gru() samples from."""
    tables, told = neural.fit(seq, h)
    return model.with_tables(**tables).with_settings(**told)


def fit_named(name: str, seq: DataFrame, given: Mapping[str, Any] | None = None) -> Model:
    """A generator by name and settings, with what assembling takes: companions, courses, sessions of a learner, starts.

    The tables are stored once, so that samples don't read the log again.
    """
    h = hyperparameters(name, given or {})
    seq = _kept(seq)
    order = supported_order(seq, h["order"], h["on_insufficient_data"] == "backoff") if "order" in h else 1
    made = _tables(seq, order, h.get("smoothing_alpha", 0.0), h["length_model"], h["fixed_length"], h.get("timing_family", "constant"), h.get("min_samples", 1))
    if name == "gru":  # the tasks decide on threads
        made = with_network(made, seq, h)
    other = F.when(F.col("token") == F.col("event_type"), F.col("activity_id")).otherwise(F.col("event_type"))
    spans = seq.groupBy("learner_id", "session_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    population = {
        "companions": seq.groupBy("token", other.alias("other")).agg(F.count("*").alias("n")),
        "courses": seq.filter("course_id is not null").groupBy("course_id").agg(F.count("*").alias("n")),
        "per_learner": spans.groupBy("learner_id").agg(F.count("*").alias("sessions")).groupBy("sessions").agg(F.count("*").alias("n")),
        "starts": spans.groupBy(F.to_date("start_time").alias("day"), F.hour("start_time").alias("hour")).agg(F.count("*").alias("n")),
    }
    every = made.with_tables(**population)
    return every.with_tables(**{k: stored(v) for k, v in every.items()}).with_settings(generator=name, **(h | ({"order": order} if "order" in h else {})))


def _skeleton(model: dict[str, DataFrame], n_sessions: int, seed: int) -> DataFrame:
    """Sessions with a drawn length."""
    lengths = _cumulative(model["lengths"].withColumn("k", F.lit(0)), "k", "len").select("cumulative")
    ids = model["lengths"].sparkSession.range(n_sessions).withColumnRenamed("id", "i")
    return ids.join(F.broadcast(lengths), F.lit(True)).select("i", pick(F.col("cumulative"), uniform(seed, "length", F.col("i"))).cast("int").alias("len"))


def independent(model: dict[str, DataFrame], n_sessions: int, seed: int = 0) -> DataFrame:
    """(session_id, pos, token): tokens drawn without memory."""
    tokens = _cumulative(model["tokens"].withColumn("k", F.lit(0)), "k").select("cumulative")
    rows = _skeleton(model, n_sessions, seed).select("i", F.explode(F.sequence(F.lit(1), "len")).alias("pos"))
    return rows.join(F.broadcast(tokens), F.lit(True)).select(F.format_string("S%06d", "i").alias("session_id"), "pos", pick(F.col("cumulative"), uniform(seed, "token", F.col("i"), F.col("pos"))).alias("token"))


def markov(model: dict[str, DataFrame], n_sessions: int, seed: int = 0, order: int = 1) -> DataFrame:
    """(session_id, pos, token): a chain from start marks; the longest known context decides, and without any all tokens are drawn from."""
    counts, alpha = model["transitions"], getattr(model, "settings", {}).get("smoothing_alpha", 0.0)
    table = _cumulative(probabilities(counts, alpha).withColumnRenamed("p", "n") if alpha else counts, "context")
    size = table.count()
    if size > MOST_MODEL_ROWS:
        raise ValueError(f"a transition table of {size} contexts is too large to be sent to executors")
    chain = table.agg(F.map_from_entries(F.collect_list(F.struct("context", "cumulative"))).alias("table"))
    marginal = _cumulative(model["tokens"].withColumn("k", F.lit(0)), "k").select(F.col("cumulative").alias("any"))
    base = _skeleton(model, n_sessions, seed).join(F.broadcast(chain), F.lit(True)).join(F.broadcast(marginal), F.lit(True))
    known = lambda path: [F.try_element_at("table", F.array_join(F.slice(path, -k, k), SEPARATOR)) for k in range(order, 0, -1)]
    step = lambda path, pos: F.concat(path, F.array(pick(F.coalesce(*known(path), F.col("any")), uniform(seed, "token", F.col("i"), pos))))
    starts = F.array(*(F.lit(START) for _ in range(order)))
    walked = base.select(F.format_string("S%06d", "i").alias("session_id"), F.aggregate(F.sequence(F.lit(1), "len"), starts, step).alias("path"))
    return walked.select("session_id", F.posexplode("path").alias("pos", "token")).filter(F.col("pos") >= order).withColumn("pos", F.col("pos") - (order - 1))


def _draw(u: Callable[..., Column], families: Sequence[str]) -> Column:
    """Seconds from a row of the gap table; ``u`` gives uniforms by label and number."""
    kind, drawn = F.col("family"), F.col("a")
    normal = lambda k: F.sqrt(-2 * F.log(1 - u("radius", k))) * F.cos(2 * math.pi * u("angle", k))
    if "empirical" in families:
        drawn = F.when(kind == "empirical", F.get("points", F.floor(u("point") * F.size("points")).cast("int"))).otherwise(drawn)
    if "exponential" in families:
        drawn = F.when(kind == "exponential", -F.col("a") * F.log(1 - u("point"))).otherwise(drawn)
    if "lognormal" in families:
        drawn = F.when(kind == "lognormal", F.exp(F.col("a") + F.col("b") * normal(F.lit(0)))).otherwise(drawn)
    if "gamma" in families:  # squeezed cubes of normals, of which the first that passes its test is taken
        d = F.when(F.col("a") < 1, F.col("a") + 1).otherwise(F.col("a")) - 1 / 3

        def tried(k: Column) -> Column:
            x = normal(k)
            v = F.pow(1 + x / F.sqrt(9 * d), F.lit(3))
            return F.when((v > 0) & (F.log(1 - u("test", k)) < x * x / 2 + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300)))), d * v)

        passed = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), tried), lambda x: x.isNotNull()), F.lit(0))
        boost = F.when(F.col("a") < 1, F.pow(1 - u("boost"), 1 / F.col("a"))).otherwise(F.lit(1.0))
        drawn = F.when(kind == "gamma", F.coalesce(passed, d) * boost * F.col("b")).otherwise(drawn)
    return drawn


def timed(path: DataFrame, gaps: DataFrame, seed: int, scale: Mapping[str, float] | None = None, families: Sequence[str] = FAMILIES) -> DataFrame:
    """(session_id, pos, token, at_s): seconds since the start; a gap follows the token before, or all tokens' where that has none of its own."""
    u = lambda label, *k: uniform(seed, "gap", label, *k, F.col("session_id"), F.col("pos"))
    columns = ["family", "a", "b", "points"]
    pooled = gaps.filter("token is null").select(F.struct(*columns).alias("__any"))
    own = gaps.filter("token is not null").select("token", F.struct(*columns).alias("__own"))
    known = path.join(own, "token", "left").join(F.broadcast(pooled), F.lit(True), "left").select("session_id", "pos", "token", F.coalesce("__own", "__any").alias("__gap")).select("session_id", "pos", "token", "__gap.*")
    factor = F.lit(1.0)
    for token, x in (scale or {}).items():
        factor = factor * (F.lit(x) if token == "*" else F.when(F.col("token") == token, F.lit(x)).otherwise(F.lit(1.0)))
    drawn = known.withColumn("gap_s", F.greatest(F.lit(0.001), F.coalesce(_draw(u, families) * factor, F.lit(60.0))))
    before = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.select("session_id", "pos", "token", F.round(F.coalesce(F.sum("gap_s").over(before), F.lit(0.0)), 3).alias("at_s"))


def semi_markov(model: dict[str, DataFrame], n_sessions: int, seed: int = 0, order: int = 1) -> DataFrame:
    """As markov(), with seconds since the start; the gap table, which timing reads twice, is stored."""
    return timed(markov(model, n_sessions, seed, order), stored(model["gaps"]), seed, families=_families(model))


def gru(model: Model, n_sessions: int, seed: int = 0) -> DataFrame:
    """(session_id, pos, token, at_s): tokens and gaps by the recurrent network of fit_named("gru")."""
    if "weights" not in model:
        raise ValueError("this model has no network; fit it by fit_named('gru')")
    return neural.walk(model, _skeleton(model, n_sessions, seed), tuple(model.settings["log_gap_range"]), seed, model.settings.get("dwell_scale"))


def sample(model: Model, n_sessions: int, seed: int = 0) -> DataFrame:
    """(session_id, pos, token, at_s) by the generator that the model was fitted for, under its settings."""
    name = model.settings["generator"]
    path = GENERATORS[name](model, n_sessions, seed, **({"order": model.settings["order"]} if "order" in HYPERPARAMETERS.get(name, {}) else {}))
    return path if "at_s" in path.columns and (name == "gru" or not model.settings.get("dwell_scale")) else timed(path.select("session_id", "pos", "token"), model["gaps"], seed, model.settings.get("dwell_scale"), _families(model))


def _families(model: Mapping[str, DataFrame]) -> Sequence[str]:
    known = getattr(model, "settings", {}).get("timing_family")
    return (known,) if known else FAMILIES


GENERATORS = {"independent": independent, "markov": markov, "semi_markov": semi_markov, "gru": gru}


def reweight(model: dict[str, DataFrame], weights: dict[str, float]) -> dict[str, DataFrame]:
    """A model whose counts of some tokens are multiplied; weight 0 removes a token."""
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col("token")), F.lit(1.0)) if weights else F.lit(1.0)
    scale = lambda t: t.withColumn("n", F.col("n") * factor).filter("n > 0")
    return Model(model | {"tokens": scale(model["tokens"]), "transitions": scale(model["transitions"])}, getattr(model, "settings", {}))


def scale_lengths(lengths: DataFrame, factor: float) -> DataFrame:
    """Lengths times a factor, rounded half to even, one at least."""
    return lengths.groupBy(F.greatest(F.lit(1), F.bround(F.col("len") * factor).cast("int")).alias("len")).agg(F.sum("n").alias("n"))


def anomaly_quota(seq: DataFrame, rate: float, seed: int, least: int = 2) -> DataFrame:
    """A seeded choice of round-half-even(rate * sessions) sessions of at least ``least`` events."""
    own = seq.groupBy("session_id").agg(F.count("*").alias("n_events"))
    total = own.agg(F.bround(F.count("*") * rate).cast("int").alias("quota"))
    ranked = seeded_rank(own.filter(F.col("n_events") >= least), uniform(seed, "anomaly", F.col("session_id")), "session_id")
    return ranked.join(F.broadcast(total), F.col("rank") <= F.col("quota")).select("session_id", "n_events")


def abnormal_timing(seq: DataFrame, chosen: DataFrame, factor: float) -> DataFrame:
    """Gaps of the chosen sessions times a factor, a millisecond at least."""
    hit = seq.join(chosen.select("session_id"), "session_id", "left_semi")
    w, us = in_session(hit), F.unix_micros("timestamp")
    gap = F.when(F.lag(us).over(w).isNotNull(), F.greatest(((us - F.lag(us).over(w)) * factor).cast("bigint"), F.lit(1000)))
    spaced = hit.withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn("__t0", F.first(us).over(w))
    return spaced.select("session_id", "event_id", (F.col("__t0") + F.sum("__gap").over(w)).alias("new_us"))


def inactivity(seq: DataFrame, chosen: DataFrame, gap_s: int) -> DataFrame:
    """The second half of the chosen sessions is shifted by a gap."""
    w = in_session(seq)
    hit = seq.join(chosen.select("session_id", "n_events"), "session_id")
    pos = F.row_number().over(w)
    return hit.select("session_id", "event_id", (F.unix_micros("timestamp") + F.when(pos > F.floor(F.col("n_events") / 2), F.lit(gap_s * 1_000_000)).otherwise(F.lit(0))).alias("new_us"))


def unseen_pairs(seq: DataFrame) -> DataFrame:
    """Pairs of tokens never seen one after the other: what an unexpected transition may insert."""
    vocabulary = seq.agg(F.collect_set("token").alias("v"))
    grid = vocabulary.select(F.explode("v").alias("src"), "v").select("src", F.explode("v").alias("dst"))
    seen = seq.select(F.col("token").alias("src"), F.lead("token").over(in_session(seq)).alias("dst")).filter("dst is not null").distinct()
    return grid.join(seen, ["src", "dst"], "left_anti")


def push_later(sessions: DataFrame) -> DataFrame:
    """Start of each session after pushing those that overlap the one before: a running sum of single pushes."""
    w = Window.partitionBy("learner_id").orderBy("start_us", "session_id")
    end = F.lag("end_us").over(w)
    pushed = sessions.withColumn("push", F.when(F.col("start_us") <= end, end + 1_000_000 - F.col("start_us")).otherwise(F.lit(0)))
    return pushed.withColumn("start_us", F.col("start_us") + F.sum("push").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("push")
