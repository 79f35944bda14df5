"""Fidelity and privacy metrics of two logs, and evaluation of detectors and clusterings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import distances as D
from tidemark.functions.randomness import uniform
from tidemark.functions.ranking import cumulate, quantiles, seeded_rank
from tidemark.operators.sequences import START


def in_session() -> Window:
    """Both logs may use the same session ids."""
    return Window.partitionBy("side", "session_id").orderBy("timestamp", "event_id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def _windowed(seq: DataFrame, n: int) -> DataFrame:
    w = in_session()
    return seq.select("side", F.col("token").alias("t0"), *(F.lead("token", k).over(w).alias(f"t{k}") for k in range(1, n))).filter(F.col(f"t{n - 1}").isNotNull()).select("side", F.concat_ws(" > ", *(f"t{k}" for k in range(n))).alias("g"))


def _gaps(seq: DataFrame) -> DataFrame:
    return seq.select("side", ((F.lead(F.unix_micros("timestamp")).over(in_session()) - F.unix_micros("timestamp")) / 1e6).alias("x")).filter("x is not null")


def _lengths(seq: DataFrame) -> DataFrame:
    return seq.groupBy("side", "session_id").agg(F.count("*").alias("n"), ((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 1e6).alias("d"), F.concat_ws(" > ", F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "event_id", "token"))), lambda x: x["token"])).alias("path"))


def _contexts(seq: DataFrame) -> DataFrame:
    return seq.select("side", F.coalesce(F.lag("token").over(in_session()), F.lit(START)).alias("context"), "token")


def top_path_overlap(seq: DataFrame, n: int = 10, length: int = 3) -> DataFrame:
    counts = _windowed(seq, length).groupBy("side", "g").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "g"))).filter(F.col("r") <= n)
    shared = top.groupBy("g").agg(F.count("*").alias("k"), F.max((F.col("side") == "a").cast("int")).alias("a"))
    return shared.agg(F.round(F.try_divide(F.sum((F.col("k") == 2).cast("double")), F.sum("a")), 6).alias("value"))


def duplicate_rate(seq: DataFrame, least: int = 3) -> DataFrame:
    """Share of b's sessions of some length that are exactly one of a's."""
    paths = _lengths(seq).filter(F.col("n") >= least)
    known = paths.filter("side = 'a'").select("path").distinct().withColumn("hit", F.lit(1))
    return paths.filter("side = 'b'").join(known, "path", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("value"))


def rare_replay_rate(seq: DataFrame, n: int = 3) -> DataFrame:
    """Share of a's n-grams found once that b has too."""
    c = lambda s: F.sum((F.col("side") == s).cast("int"))
    counts = _windowed(seq, n).groupBy("g").agg(c("a").alias("na"), c("b").alias("nb")).filter("na = 1")
    return counts.agg(F.round(F.avg((F.col("nb") > 0).cast("double")), 6).alias("value"))


def nearest_distance(a: DataFrame, b: DataFrame, *, seed: int = 0, most_a: int = 1000, most_b: int = 200) -> DataFrame:
    """5th percentile of b's distance to the nearest of a, over seeded samples of stated sizes (a sampling metric)."""
    take = lambda s, n, label: s.select("session_id", "event_sequence").orderBy(uniform(seed, label, F.col("session_id")), "session_id").limit(n)
    left = F.broadcast(take(a, most_a, "real").select(F.col("event_sequence").alias("sa")).distinct())
    pairs = take(b, most_b, "synthetic").join(left, F.lit(True))
    near = pairs.groupBy("session_id").agg(F.min(D.edit_distance(F.col("sa"), F.col("event_sequence"))).alias("d"))
    return near.agg(F.round(F.percentile("d", F.lit(0.05)), 6).alias("value"))  # of ``most_b`` rows at most


def _nearest(seq: DataFrame) -> DataFrame:
    """nearest_distance() of the sides' sessions."""
    item = F.struct("timestamp", "event_id", "token")
    made = seq.groupBy("side", "session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"]).alias("event_sequence"))
    return nearest_distance(made.filter("side = 'a'"), made.filter("side = 'b'"))


METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "event_type_tvd": lambda ev, seq: D.total_variation(ev, "event_type"),
    "activity_jsd": lambda ev, seq: D.jensen_shannon(ev, "activity_id"),
    "session_length_ks": lambda ev, seq: D.ks(_lengths(seq), "n"),
    "session_duration_w1": lambda ev, seq: D.wasserstein1(_lengths(seq), "d"),
    "interevent_time_ks": lambda ev, seq: D.ks(_gaps(seq), "x"),
    "bigram_tvd": lambda ev, seq: D.total_variation(_windowed(seq, 2), "g"),
    "transition_jsd": lambda ev, seq: D.transition_jsd(_contexts(seq)),
    "topn_path_overlap": lambda ev, seq: top_path_overlap(seq),
    "exact_session_dup_rate": lambda ev, seq: duplicate_rate(seq),
    "rare_ngram_replay_rate": lambda ev, seq: rare_replay_rate(seq),
    "nn_distance_p05": lambda ev, seq: _nearest(seq),
}


def validate(real: DataFrame, synthetic: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(metric, value) of two sessionized logs with ``token``; marginal metrics see all events, the others sessions only."""
    ev = both(real, synthetic)
    seq = ev.filter("session_id is not null")
    out = None
    for name in metrics or sorted(METRICS):
        one = METRICS[name](ev, seq).select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def token_gaps(seq: DataFrame) -> DataFrame:
    """Share of each token on both sides and the difference."""
    return D._shares(seq, "token").select("token", F.round("p", 6).alias("share_a"), F.round("q", 6).alias("share_b"), F.round(F.col("q") - F.col("p"), 6).alias("gap"))


def novel_transitions(seq: DataFrame) -> DataFrame:
    """Bigrams that one side alone has."""
    c = lambda s: F.sum((F.col("side") == s).cast("int"))
    counts = _windowed(seq, 2).groupBy("g").agg(c("a").alias("na"), c("b").alias("nb"))
    return counts.filter("na = 0 or nb = 0").select("g", F.when(F.col("na") == 0, "novel").otherwise("missing").alias("kind"), (F.col("na") + F.col("nb")).cast("bigint").alias("n"))


def detection(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, rates, ROC AUC (ties half) and average precision (ties one group) of (truth, score); no score ranks lowest."""
    s = scored.select(F.col("truth").cast("int").alias("t"), F.coalesce("score", F.lit(float("-inf"))).alias("s"))
    groups = s.groupBy("s").agg(F.sum("t").alias("pos"), F.count("*").alias("n"))
    ranked = cumulate(groups, "s", ["pos", "n"]).select("pos", "n", "s", F.col("n_before").alias("before"), (F.col("pos_total") - F.col("pos_before")).alias("hits"), (F.col("n_total") - F.col("n_before")).alias("seen"))
    flag = F.col("s") >= threshold
    some = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    neg = F.col("n") - F.col("pos")
    a = ranked.withColumn("neg", neg).agg(
        some(flag, "pos").alias("tp"), some(flag, "neg").alias("fp"), some(~flag, "pos").alias("fn"), some(~flag, "neg").alias("tn"),
        F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("ap"),
    )
    r = lambda c, name: F.round(c, 6).alias(name)
    return a.select(
        "tp", "fp", "fn", "tn",
        r(F.try_divide("tp", F.col("tp") + F.col("fp")), "precision"), r(F.try_divide("tp", F.col("tp") + F.col("fn")), "recall"),
        r(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "f1"), r(F.try_divide("fp", F.col("fp") + F.col("tn")), "fpr"),
        r(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), "roc_auc"), r(F.try_divide("ap", "p"), "average_precision"),
    )


def clustering(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index, normalised mutual information and purity of (truth, predicted); 1 where both are degenerate."""
    cells = labels.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    marked = cells.select("n", "truth", "predicted", F.sum("n").over(Window.partitionBy("truth")).alias("a"), F.sum("n").over(Window.partitionBy("predicted")).alias("b"), F.sum("n").over(D.whole()).alias("t"), F.row_number().over(Window.partitionBy("truth").orderBy("predicted")).alias("ra"), F.row_number().over(Window.partitionBy("predicted").orderBy("truth")).alias("rb"), F.max("n").over(Window.partitionBy("predicted")).alias("top"))
    h = lambda c: -F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))
    once = lambda r, v: F.sum(F.when(F.col(r) == 1, v).otherwise(0))
    s = marked.agg(
        F.sum(pairs("n")).alias("sn"), once("ra", pairs("a")).alias("sa"), once("rb", pairs("b")).alias("sb"), F.max(pairs("t")).alias("st"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), once("ra", h("a")).alias("ha"), once("rb", h("b")).alias("hb"),
        (once("rb", F.col("top")) / F.max("t")).alias("purity"),
    )
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("st"))
    most = (F.col("sa") + F.col("sb")) / 2
    return s.select(
        F.round(F.coalesce(F.try_divide(F.col("sn") - expected, F.when(most != expected, most - expected)), F.lit(1.0)), 6).alias("ari"),
        F.round(F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(0.0))), 6).alias("nmi"),
        F.round("purity", 6).alias("purity"),
    )


def split_by_learner(events: DataFrame, fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """(learner_id, holdout): a seeded share of the learners, at least one on either side."""
    learners = events.select("learner_id").distinct()
    ranked = seeded_rank(learners, uniform(seed, "split", F.col("learner_id")), "learner_id")
    n = learners.agg(F.count("*").alias("n")).select(F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * fraction), F.col("n") - 1)).alias("most"))
    return ranked.join(F.broadcast(n), F.lit(True)).select("learner_id", (F.col("rank") <= F.col("most")).alias("holdout"))


def evaluate(events: DataFrame, truth: DataFrame, predicted: DataFrame, *, level: str = "session", threshold: float = 0.5) -> dict[str, DataFrame]:
    """A detector against annotations: ``scores``, and recall ``by_type`` and ``by_category``.

    ``predicted`` has ``id`` and, for a scoring detector, ``score``; bare ids are
    all flagged.  Ids that the log does not have at the level, and scores that are
    no finite number, are errors.
    """
    key = f"{level}_id"
    universe = events.select(F.col(key).alias("id")).filter("id is not null").distinct()
    scores = predicted if "score" in predicted.columns else predicted.withColumn("score", F.lit(1.0))
    scores = scores.select(F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score")).groupBy("id").agg(F.max("score").alias("score"), F.bool_and(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"))
    wrong = scores.join(universe.withColumn("known", F.lit(True)), "id", "left").agg(F.sum(F.col("known").isNull().cast("int")).alias("unknown"), F.sum((~F.col("finite")).cast("int")).alias("odd")).first()
    if wrong["unknown"] or wrong["odd"]:
        raise ValueError(f"{wrong['unknown'] or 0} predicted ids are unknown at the level {level}, {wrong['odd'] or 0} scores are no finite number")
    anomalous = truth.filter((F.col("annotation") == "anomaly") & (F.col("level") == level))
    marked = universe.join(anomalous.select("id").distinct().withColumn("truth", F.lit(True)), "id", "left").join(scores.select("id", "score"), "id", "left")
    flagged = scores.filter(F.col("score") >= threshold).select("id")

    def recall(column: str) -> DataFrame:
        own = anomalous.select("id", F.col(column).alias("kind")).distinct()
        hits = own.join(flagged.withColumn("hit", F.lit(1.0)), "id", "left")
        return hits.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))

    scored = detection(marked.select(F.coalesce("truth", F.lit(False)).alias("truth"), "score"), threshold)
    if "score" not in predicted.columns:
        scored = scored.withColumn("roc_auc", F.lit(None).cast("double")).withColumn("average_precision", F.lit(None).cast("double"))
    return {"scores": scored, "by_type": recall("type"), "by_category": recall("category")}
