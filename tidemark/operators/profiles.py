"""Learner profiles: clusters of standardised features, with one generator model each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators import generate, profile
from tidemark.operators.sessionize import sessions

#: A feature tells a profile apart from this z-score on.
TELLING, CLIP = 0.25, 3.0
#: Starts of k-means, of which the cheapest is kept; learners that one of its tasks sees, so that small tables are not cut into many.
TRIES, PART = 10, 20_000


@dataclass(frozen=True)
class Profiles:
    """Learned clusters, largest first; only centroids and two statistics of each feature are kept on the driver."""

    vocabulary: tuple[str, ...]
    means: dict[str, float]
    stds: dict[str, float]
    centroids: list[list[float]]
    sizes: list[int]
    models: list[dict[str, DataFrame]]

    def assign(self, seq: DataFrame) -> DataFrame:
        """(learner_id, profile) of the learners of another log: the nearest centroid, the first of equally near ones."""
        return self.assign_rows(profile.learner_features(profile.spans(seq), seq, self.vocabulary))

    def assign_rows(self, rows: DataFrame) -> DataFrame:
        """As assign(), of learners whose features are known."""
        return rows.select("learner_id", _nearest(_point(self.means, self.stds), self.centroids).alias("profile"))

    def distinguishing(self, seq: DataFrame, top: int = 3) -> DataFrame:
        """(profile, feature, z): up to ``top`` features of each profile whose mean lies a quarter of a deviation or more from that of all."""
        rows = profile.learner_features(sessions(seq), seq, self.vocabulary)
        mine = rows.groupBy(_nearest(_point(self.means, self.stds), self.centroids).alias("profile")).agg(*(F.avg(c).alias(c) for c in self.means))
        z = [F.struct(F.abs((F.col(c) - m) / self.stds[c]).alias("size"), F.lit(c).alias("feature"), F.round((F.col(c) - m) / self.stds[c], 6).alias("z")) for c, m in self.means.items()]
        far = F.slice(F.sort_array(F.array(*z), asc=False), 1, top)
        return mine.select("profile", F.explode(far).alias("f")).filter(F.col("f.size") >= TELLING).select("profile", "f.feature", "f.z")

    def generate(self, n_sessions: int, seed: int = 0, mixture: list[float] | None = None, family: str = "semi_markov") -> DataFrame:
        """Sessions of all profiles with their number, by the sizes of the profiles or a mixture; the largest remainders get what is left."""
        weights = [float(x) for x in (mixture or self.sizes)]
        exact = [n_sessions * w / sum(weights) for w in weights]
        quota = [int(x) for x in exact]
        for i in sorted(range(len(exact)), key=lambda i: (quota[i] - exact[i], i))[: n_sessions - sum(quota)]:
            quota[i] += 1
        some = [(i, m, q) for i, (m, q) in enumerate(zip(self.models, quota, strict=True)) if q]
        one = lambda i, m, q: generate.GENERATORS[family](m, q, seed + i).withColumn("session_id", F.concat(F.lit(f"P{i}-"), "session_id")).withColumn("profile", F.lit(i))
        spark = next(iter(self.models[0].values())).sparkSession
        return reduce(DataFrame.unionByName, _together(spark, lambda x: one(*x), some))


def _point(means: dict[str, float], stds: dict[str, float]) -> Column:
    return F.array(*(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(c) - m) / stds[c])) for c, m in means.items()))


def _nearest(point: Column, centroids: list[list[float]]) -> Column:
    apart = lambda c: F.aggregate(F.zip_with(point, F.array(*(F.lit(x) for x in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    return F.array_min(F.array(*(F.struct(apart(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids))))["i"]


def _together(spark: SparkSession, f: Callable, things: Sequence) -> list:
    """``f`` of each, some at a time."""
    with ThreadPool(min(len(things), TRIES)) as pool:
        return pool.map(inheritable_thread_target(spark)(f), things)


def best_kmeans(points: DataFrame, k: int, seed: int, tries: int = TRIES, **options) -> KMeansModel:
    """The cheapest of some k-means runs with consecutive seeds, the first of equally cheap ones; as each is a row of short jobs, they run together."""
    starts = [KMeans(k=k, seed=seed + i, **options) for i in range(tries)]
    return min(_together(points.sparkSession, lambda start: start.fit(points), starts), key=lambda m: m.summary.trainingCost)


def in_parts(rows: DataFrame, n: int) -> DataFrame:
    """``n`` stored learners in as many parts as k-means needs, each in order."""
    return rows.coalesce(max(1, math.ceil(n / PART))).sortWithinPartitions("learner_id")


def fit_clusters(seq: DataFrame, n_profiles: int, vocabulary: tuple[str, ...], seed: int = 0, tries: int = TRIES, least: int = 5) -> tuple[Profiles, DataFrame]:
    """Profiles without models, and (learner_id, profile): the best of some k-means runs over standardised learner features, which are stored; every profile needs ``least`` learners."""
    rows = stored(profile.learner_features(profile.spans(seq), seq, vocabulary))
    names = [c for c in rows.columns if c != "learner_id"]
    stats = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    means, stds = {c: float(stats[f"m_{c}"]) for c in names}, {c: float(stats[f"s_{c}"] or 1.0) for c in names}
    points = in_parts(rows, stats["n"]).select("learner_id", array_to_vector(_point(means, stds)).alias("features")).cache()
    try:
        best = best_kmeans(points, n_profiles, seed, tries, maxIter=100)
        sizes, centres = best.summary.clusterSizes, [[float(x) for x in c] for c in best.clusterCenters()]
    finally:
        points.unpersist()
    if len(sizes) < n_profiles or min(sizes) < least:
        raise ValueError(f"{n_profiles} profiles leave fewer than {least} learners in one")
    order = sorted(range(n_profiles), key=lambda i: (-sizes[i], centres[i]))
    learned = Profiles(vocabulary, means, stds, [centres[i] for i in order], [int(sizes[i]) for i in order], [])
    return learned, learned.assign_rows(rows)


def fit_profiles(seq: DataFrame, n_profiles: int, vocabulary: tuple[str, ...], seed: int = 0, tries: int = TRIES, least: int = 5) -> Profiles:
    """fit_clusters(), with a model of each profile."""
    learned, members = fit_clusters(seq, n_profiles, vocabulary, seed, tries, least)
    own = stored(generate.read_of(seq).join(members, "learner_id"), "profile")
    learned.models.extend(generate.fit(own.filter(F.col("profile") == i).drop("profile"), kept=True) for i in range(n_profiles))
    return learned


def save_profiles(found: Profiles, path: str, *, force: bool = False) -> None:
    """A folder with profiles.json and a model each."""
    import json

    from tidemark import models

    spark = next(iter(found.models[0].values())).sparkSession
    with models.Staged(spark, path, marker="profiles.json", force=force) as aside:
        for i, m in enumerate(found.models):
            models.save(m if isinstance(m, generate.Model) else generate.Model(m, {}), f"{aside}/model-{i}")
        known = {"vocabulary": list(found.vocabulary), "means": found.means, "stds": found.stds, "centroids": found.centroids, "sizes": found.sizes}
        models.write_text(spark, f"{aside}/profiles.json", json.dumps(known, indent=2, sort_keys=True))


def load_profiles(spark: SparkSession, path: str) -> Profiles:
    import json

    from tidemark import models

    known = json.loads(models.read_text(spark, f"{path}/profiles.json"))
    own = [models.load(spark, f"{path}/model-{i}") for i in range(len(known["sizes"]))]
    return Profiles(tuple(known["vocabulary"]), known["means"], known["stds"], known["centroids"], known["sizes"], own)


def given_profiles(seq: DataFrame, assignments: DataFrame, vocabulary: tuple[str, ...], least: int = 5) -> tuple[list[str], Profiles]:
    """Names, in order of size, and profiles of assigned learners (learner_id, profile); a profile of fewer than ``least`` is an error."""
    own = seq.join(assignments.withColumnRenamed("profile", "__profile"), "learner_id")
    sizes = {r["__profile"]: r["n"] for r in own.groupBy("__profile").agg(F.count_distinct("learner_id").alias("n")).collect()}  # one row for each profile
    if not sizes or min(sizes.values()) < least:
        raise ValueError(f"a profile has fewer than {least} learners")
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    rows = profile.learner_features(sessions(seq), seq, vocabulary)
    stats = rows.agg(*(x for c in rows.columns[1:] for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    means, stds = {c: float(stats[f"m_{c}"]) for c in rows.columns[1:]}, {c: float(stats[f"s_{c}"] or 1.0) for c in rows.columns[1:]}
    joined = rows.join(assignments, "learner_id").groupBy("profile").agg(F.array(*(F.avg(x) for x in [F.get(_point(means, stds), F.lit(i)) for i in range(len(means))])).alias("centre"))
    centres = {r["profile"]: [float(x) for x in r["centre"]] for r in joined.collect()}
    models_ = [generate.fit(own.filter(F.col("__profile") == k).drop("__profile")) for k in names]
    return names, Profiles(vocabulary, means, stds, [centres[k] for k in names], [sizes[k] for k in names], models_)


#: What a profile defined by hand may say, and what it is else.
BY_HAND = {"start": None, "transitions": None, "share": 1.0, "session_length": {"mean": 6}, "sessions_per_learner": {"mean": 3}, "dwell_s": {"*": 60.0}, "dwell_spread": 0.5, "activities": {}, "course": None}


def _histogram(name: str, key: str, spec: dict) -> list[tuple[int, float]]:
    """Sizes and weights from a mean (1 + Poisson), a fixed size or counts."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ValueError(f"{name}: {key} has one of mean, fixed and counts")
    mode, value = next(iter(spec.items()))
    if mode == "fixed" and isinstance(value, int) and value >= 1:
        return [(value, 1.0)]
    if mode == "mean" and isinstance(value, int | float) and value >= 1:
        rate = value - 1
        return [(k + 1, w) for k in range(int(rate + 12 * math.sqrt(rate) + 20)) if (w := math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)) > 0]
    if mode == "counts" and value and all(int(k) >= 1 and v > 0 for k, v in value.items()):
        return [(int(k), float(v)) for k, v in sorted(value.items(), key=lambda x: int(x[0]))]
    raise ValueError(f"{name}: {key} does not take {spec}")


def define_profile(spark: SparkSession, name: str, spec: dict) -> generate.Model:
    """A semi-Markov model from behaviour said by hand: chances of first and next tokens, sizes, and median seconds after tokens."""
    if set(spec) - set(BY_HAND) or "start" not in spec or "transitions" not in spec:
        raise ValueError(f"{name} has start and transitions, and may have {', '.join(sorted(set(BY_HAND) - {'start', 'transitions'}))}")
    s = BY_HAND | spec
    rows = {generate.START: s["start"], **s["transitions"]}
    for token, chances in rows.items():
        if not isinstance(chances, dict) or not chances or any(isinstance(p, bool) or not isinstance(p, int | float) or p < 0 for p in chances.values()) or sum(chances.values()) <= 0:
            raise ValueError(f"{name}: the tokens after {token} have chances that are not all 0")
    if not all(x > 0 for x in s["dwell_s"].values()) or s["dwell_spread"] <= 0 or s["share"] < 0:
        raise ValueError(f"{name}: seconds and their spread are positive, a share is not negative")
    counts = [(c, t, p / sum(row.values())) for c, row in rows.items() for t, p in row.items() if p > 0]
    tokens = sorted({t for _, t, _ in counts} | set(s["transitions"]))
    weight = {t: sum(p for _, x, p in counts if x == t) or 1.0 for t in tokens}
    gaps = [(None if t == "*" else t, 1, "lognormal", math.log(m), float(s["dwell_spread"]), None) for t, m in ({"*": 60.0} | s["dwell_s"]).items()]
    make = spark.createDataFrame
    tables = {
        "tokens": make(list(weight.items()), "token string, n double"), "transitions": make(counts, "context string, token string, n double"), "lengths": make(_histogram(name, "session_length", s["session_length"]), "len bigint, n double"),
        "gaps": make(gaps, "token string, n bigint, family string, a double, b double, points array<double>"), "companions": make([(t, a, 1) for t in tokens for a in s["activities"].get(t, [t])], "token string, other string, n bigint"),
        "courses": make([(s["course"], 1)] if s["course"] else [], "course_id string, n bigint"), "per_learner": make(_histogram(name, "sessions_per_learner", s["sessions_per_learner"]), "sessions bigint, n double"),
        "starts": spark.sql("select explode(sequence(date'2026-01-05', date'2026-03-29')) as day, 0 as h").selectExpr("day", "explode(sequence(8, 20)) as hour", "1L as n"),
    }
    return generate.Model(tables, {"generator": "semi_markov", "order": 1, "smoothing_alpha": 0.0, "timing_family": "lognormal", "min_samples": 1, "length_model": "empirical"})


def define_profiles(spark: SparkSession, definitions: dict[str, dict]) -> tuple[dict[str, generate.Model], dict[str, float]]:
    """Models and shares, which add up to one, of profiles by name."""
    if not definitions:
        raise ValueError("at least one profile")
    shares = {k: float(d.get("share", 1.0)) for k, d in definitions.items()}
    made = {k: define_profile(spark, k, d) for k, d in definitions.items()}
    if sum(shares.values()) <= 0:
        raise ValueError("shares must not all be 0")
    return made, {k: v / sum(shares.values()) for k, v in shares.items()}


def pooled_vocabulary(seq: DataFrame, min_share: float = 0.01) -> tuple[str, ...]:
    """Tokens with at least a share of all events; the others count as one."""
    counts = seq.groupBy("token").agg(F.count("*").alias("n"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).filter(F.col("n") >= F.col("all") * min_share)
    return tuple(sorted(r["token"] for r in shares.select("token").collect()))  # 1 / min_share rows at most


def stability(seq: DataFrame, k: int, vocabulary: tuple[str, ...], *, repeats: int = 3, seed: int = 0, fraction: float = 0.3, least: int = 5) -> DataFrame:
    """(check, ari, nmi, purity): agreement of profiles across seeds, 80 % subsamples, and with those fitted on held-out learners."""
    from tidemark.functions.randomness import uniform
    from tidemark.operators import validation

    split = validation.split_by_learner(seq, fraction, seed)
    train, holdout = (seq.join(split.filter(c).select("learner_id"), "learner_id", "left_semi") for c in ("not holdout", "holdout"))
    base = fit_profiles(train, k, vocabulary, seed, least=least)
    some = lambda b: train.filter(uniform(seed, "subsample", str(b), F.col("learner_id")) < 0.8)
    tried = [("seed", train, lambda b=b: fit_profiles(train, k, vocabulary, seed + b, least=least)) for b in range(1, repeats + 1)]
    tried += [("subsample", train, lambda b=b: fit_profiles(some(b), k, vocabulary, seed, least=least)) for b in range(1, repeats + 1)]
    tried += [("replication", holdout, lambda: fit_profiles(holdout, k, vocabulary, seed, least=least))]
    out = None
    for check, on, make in tried:
        try:
            other = make()
        except ValueError:  # too few learners in a profile
            continue
        both = base.assign(on).withColumnRenamed("profile", "truth").join(other.assign(on).withColumnRenamed("profile", "predicted"), "learner_id")
        one = validation.clustering(both).withColumn("check", F.lit(check))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else seq.sparkSession.createDataFrame([], "ari double, nmi double, purity double, check string")


def detection_study(train: DataFrame, background: DataFrame, specs: list[dict], seed: int = 0) -> dict[str, DataFrame]:
    """How well transition scores of the training log find anomalies put into another log."""
    from tidemark.functions.scratch import stored
    from tidemark.operators import injection, sequences, validation

    events, truth, _ = injection.inject(background, specs, seed=seed, reference=train)
    scores = stored(sequences.transition_scores(train, events))
    return validation.evaluate(events, truth, scores.withColumnRenamed("session_id", "id"))


def artifact_auc(train: DataFrame, real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Whether transition scores tell generated sessions from real ones: half is that they can't."""
    from tidemark.operators import sequences, validation

    scored = sequences.transition_scores(train, real).withColumn("truth", F.lit(False)).unionByName(sequences.transition_scores(train, synthetic).withColumn("truth", F.lit(True)))
    return validation.detection(scored).select("roc_auc")
