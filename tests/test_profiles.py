"""Profiles of learners and measures of memorisation on logs small enough to count by hand."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import memorisation as R
from tidemark.operators import profiles as K
from tidemark.operators import assemble, profile, sequences, sessionize

T0 = datetime(2026, 3, 2, 9, tzinfo=UTC)


def log(spark, learners):
    """Session events of {learner: [session, ...]}; a letter is an event type."""
    rows = [(f"{who}-{i}-{k}", who, T0 + timedelta(hours=i, seconds=30 * k), f"{who}-{i}", "quiz", t, "c", None, True) for who, own in learners.items() for i, s in enumerate(own) for k, t in enumerate(s)]
    made = spark.createDataFrame(rows, "event_id string, learner_id string, timestamp timestamp, session_id string, activity_id string, event_type string, course_id string, score double, success boolean")
    return sequences.tokens(made)


def tables(spark, learners):
    return sessionize.sessions(log(spark, learners))


def test_profiles(spark):
    people = {f"r{i}": ["aaaa", "aaab"] for i in range(6)} | {f"w{i}": ["bb"] for i in range(9)}
    seq = log(spark, people)
    found = K.fit_profiles(seq, 2, ("a", "b"), seed=1)
    assert found.sizes == [9, 6]
    assert {(r.learner_id[0], r.profile) for r in found.assign(seq).collect()} == {("w", 0), ("r", 1)}
    assert found.assign(log(spark, {"new": ["bb"]})).first().profile == 0
    assert {r.profile for r in found.distinguishing(seq).collect()} == {0, 1}
    made = found.generate(10, seed=2)
    assert made.select("profile", "session_id").distinct().groupBy("profile").count().orderBy("profile").collect() == [(0, 6), (1, 4)]
    assert {r.token for r in made.filter("profile = 0").select("token").distinct().collect()} == {"b"}
    with pytest.raises(ValueError):
        K.fit_profiles(seq, 2, ("a", "b"), least=7)


def test_exposure_and_trajectories(spark):
    train = tables(spark, {"A": ["abc", "abd"], "B": ["abc"], "C": ["xy"]})
    target = tables(spark, {"D": ["abc", "abd"], "E": ["xyz", "xy"], "F": ["abc"]})
    assert R.session_exposure(train, target).first() == (4, 0.75, 0.25)
    assert R.trajectory_match(train, target).first() == (2, 0.5)
    nobody = target.limit(0)
    assert R.session_exposure(train, nobody).first() == (0, None, None)
    assert R.trajectory_match(train, nobody).first() == (0, None)
    assert {r.session_id for r in R.rarest(train).collect()} == {"A-1", "C-0"}


def test_histograms_share_bins(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 4.9), ("b", 5.0), ("b", None)], "side string, v double")
    assert {tuple(r) for r in R.shared_histogram(rows, "v", "side", 2).collect()} == {("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)}
    assert [tuple(r) for r in R.shared_histogram(rows.filter("v = 5"), "v", "side").collect()] == [("b", 0, 1)]


def test_recall_and_unknown(spark):
    truth = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "y")], "id int, kind string")
    flagged = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert {tuple(r) for r in R.recall_by(truth, flagged, "id", "kind").collect()} == {("x", 2, 0.5), ("y", 1, 0.0)}
    assert [r.id for r in R.unknown_ids(flagged, truth, "id").collect()] == [9]


def test_closest(spark):
    a = spark.createDataFrame([("p", 0.0, 0.0), ("q", 3.0, 5.0)], "k string, x double, y double")
    b = spark.createDataFrame([("u", 3.0, 4.0), ("v", 30.0, 40.0)], "k string, x double, y double")
    assert {tuple(r) for r in R.closest(a, b, "k").collect()} == {("p", 5.0), ("q", 1.0)}
    with pytest.raises(ValueError):
        R.closest(a, b, "k", most=1)


def test_closest_of_all_reference_rows(spark):
    a = spark.createDataFrame([("p", 2999.0), ("q", -4.0)], "k string, x double")
    b = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"))
    want = {("p", 0.0), ("q", 4.0)}
    assert {tuple(r) for r in R.closest(a, b, "k").collect()} == {tuple(r) for r in R.closest(a, b, "k", block=7).collect()} == want
    assert {tuple(r) for r in R.closest(a, b.limit(0), "k").collect()} == {("p", None), ("q", None)}
    far = spark.createDataFrame([(str(i), 0.0) for i in range(99)] + [("far", 1.0)], "k string, x double")
    z = {c: profile.standardize(far, "k", **o).filter("k = 'far'").first().x for c, o in {"free": {"clip": None}, "clipped": {}}.items()}
    assert z == {"free": 9.94987, "clipped": 3.0}


def test_ten_starts_by_default(spark, monkeypatch):
    seeds = []

    class Counted(K.KMeans):
        def __init__(self, *, seed, **options):
            super().__init__(seed=seed, **options)
            seeds.append(seed)

    monkeypatch.setattr(K, "KMeans", Counted)
    people = {f"r{i}": ["aaaa"] for i in range(5)} | {f"w{i}": ["bb"] for i in range(5)}
    K.fit_profiles(log(spark, people), 2, ("a", "b"), seed=4)
    assert seeds == list(range(4, 14))


def test_profiles_come_back_and_can_be_given(spark, tmp_path):
    people = {f"r{i}": ["aaaa", "aaab"] for i in range(6)} | {f"w{i}": ["bb"] for i in range(9)}
    seq = log(spark, people)
    found = K.fit_profiles(seq, 2, ("a", "b"), seed=1)
    K.save_profiles(found, f"{tmp_path}/p")
    back = K.load_profiles(spark, f"{tmp_path}/p")
    assert back.assign(seq).orderBy("learner_id").collect() == found.assign(seq).orderBy("learner_id").collect()
    assert sorted(map(tuple, back.generate(10, 2).collect())) == sorted(map(tuple, found.generate(10, 2).collect()))
    told = spark.createDataFrame([(k, "reader" if k[0] == "r" else "worker") for k in people], "learner_id string, profile string")
    names, given = K.given_profiles(seq, told, ("a", "b"))
    assert names == ["worker", "reader"] and {(r.learner_id[0], r.profile) for r in given.assign(seq).collect()} == {("w", 0), ("r", 1)}
    with pytest.raises(ValueError):
        K.given_profiles(seq, told, ("a", "b"), least=7)
    assert K.pooled_vocabulary(log(spark, {"u": ["aaaaaaaaab"]}), 0.2) == ("a",)
    wide = profile.learner_features(tables(spark, {"u": ["aaab"]}), log(spark, {"u": ["aaab"]}), ("a",), others=True).first()
    assert wide["share_a"] == 0.75 and wide["share_(other)"] == 0.25


def test_profiles_by_hand(spark):
    keen = {"start": {"open": 1}, "transitions": {"open": {"read": 3, "quit": 1}, "read": {"open": 1}}, "share": 3, "session_length": {"fixed": 5}, "dwell_s": {"*": 60, "read": 600}, "activities": {"read": ["book-1", "book-2"]}, "course": "c9"}
    made, shares = K.define_profiles(spark, {"keen": keen, "idle": {"start": {"quit": 1}, "transitions": {"quit": {"quit": 1}}}})
    assert shares == {"keen": 0.75, "idle": 0.25}
    rows = assemble.log_of(made["keen"], 40, 3).collect()
    assert len(rows) == 200 and {r["course_id"] for r in rows} == {"c9"} and {r["activity_id"] for r in rows if r["token"] == "read"} == {"book-1", "book-2"}
    gaps = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r["session_id"], r["timestamp"])):
        if by.get("session") == r["session_id"]:
            gaps.setdefault(by["token"], []).append((r["timestamp"] - by["at"]).total_seconds())
        by = {"session": r["session_id"], "token": r["token"], "at": r["timestamp"]}
    middle = lambda x: sorted(x)[len(x) // 2]
    assert 400 < middle(gaps["read"]) < 900 and 40 < middle(gaps["open"]) < 90
    for bad in ({}, {"start": {"a": 1}}, keen | {"colour": 1}, keen | {"start": {"a": 0}}, keen | {"start": {"a": True}}, keen | {"session_length": {"mean": 0}}, keen | {"dwell_s": {"*": 0}}, keen | {"sessions_per_learner": {"mean": 2, "fixed": 3}}):
        with pytest.raises(ValueError):
            K.define_profile(spark, "x", bad)
    with pytest.raises(ValueError):
        K.define_profiles(spark, {})


def test_studies(spark):
    people = {f"r{i}": ["aaaa", "aaab", "aaaa"] for i in range(12)} | {f"w{i}": ["bb", "bbb"] for i in range(12)}
    seq = log(spark, people)
    steady = {r["check"]: r["ari"] for r in K.stability(seq, 2, ("a", "b"), repeats=1, seed=3, least=2).collect()}
    assert steady == {"seed": 1.0, "subsample": 1.0, "replication": 1.0}
    found = K.detection_study(seq, seq, [{"type": "unexpected_transition", "rate": 0.2, "transitions": [["b", "a"]]}], seed=1)
    assert found["scores"].first()["roc_auc"] > 0.9 and found["by_type"].first()["n"] == 12
    assert K.artifact_auc(seq, seq, seq).first()["roc_auc"] == 0.5


def test_clusters_in_few_jobs(spark, monkeypatch):
    """Features are stored, the starts see them in one part, and no model is fitted of what is only assigned."""
    people = {f"r{i}": ["aaaa", "aaab"] for i in range(6)} | {f"w{i}": ["bb"] for i in range(9)}
    seq = log(spark, people).repartition(4)
    seen, fit = [], K.KMeans.fit
    monkeypatch.setattr(K.KMeans, "fit", lambda self, points: (seen.append(points.rdd.getNumPartitions()), fit(self, points))[1])
    monkeypatch.setattr(K.generate, "fit", None)
    found, members = K.fit_clusters(seq, 2, ("a", "b"), seed=1)
    assert seen == [1] * 10 and found.models == []
    assert {(r.learner_id[0], r.profile) for r in members.collect()} == {("w", 0), ("r", 1)}
    assert sorted(members.collect()) == sorted(found.assign(seq).collect())
    assert K.in_parts(spark.range(9).withColumnRenamed("id", "learner_id").repartition(4), 2 * K.PART + 1).rdd.getNumPartitions() == 3


def test_spans_are_those_of_sessions(spark):
    own = log(spark, {"A": ["abc", "a"], "B": ["cc"]})
    names = ("session_id", "learner_id", "n_events", "duration_s")
    assert sorted(profile.spans(own).select(*names).collect()) == sorted(sessionize.sessions(own).select(*names).collect())


def test_starts_run_together(spark, monkeypatch):
    import threading

    everyone = threading.Barrier(K.TRIES, timeout=60)
    fit = K.KMeans.fit
    monkeypatch.setattr(K.KMeans, "fit", lambda self, points: (everyone.wait(), fit(self, points))[1])
    people = {f"r{i}": ["aaaa"] for i in range(5)} | {f"w{i}": ["bb"] for i in range(5)}
    assert K.fit_profiles(log(spark, people), 2, ("a", "b"), seed=4).sizes == [5, 5]


def test_learner_clusters_in_one_part(spark, monkeypatch):
    from tidemark.plans import queries

    seen, fit = [], K.KMeans.fit
    monkeypatch.setattr(K.KMeans, "fit", lambda self, points: (seen.append(points.rdd.getNumPartitions()), fit(self, points))[1])
    rows = queries.QUERIES["learner_clusters"](spark, "/root/testdata/sf0.001").collect()
    learners = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    sizes = [sum(r["profile"] == i for r in rows) for i in range(3)]
    assert seen == [1] * 10 and sum(sizes) == len({r["learner_id"] for r in rows}) == learners and sizes == sorted(sizes, reverse=True) and min(sizes) > 0


def test_models_of_one_stored_log(spark, monkeypatch):
    import threading

    people = {f"r{i}": ["aaaa", "aaab"] for i in range(6)} | {f"w{i}": ["bb"] for i in range(9)}
    seq = log(spark, people)
    with monkeypatch.context() as m:
        m.setattr(K.generate, "_kept", None)
        found = K.fit_profiles(seq, 2, ("a", "b"), seed=1)
    plain = lambda df: sorted(map(str, df.collect()))
    for own, letter in zip(found.models, "wr", strict=True):
        want = K.generate.fit(seq.filter(F.col("learner_id").startswith(letter)))
        assert own.settings == want.settings and {k: plain(v) for k, v in own.items()} == {k: plain(v) for k, v in want.items()}
    both, markov = threading.Barrier(2, timeout=60), K.generate.markov
    monkeypatch.setitem(K.generate.GENERATORS, "markov", lambda *a: (both.wait(), markov(*a))[1])
    made = found.generate(10, seed=2, family="markov")
    assert sorted(r.session_id for r in made.select("session_id").distinct().collect()) == sorted([f"P0-S{i:06d}" for i in range(6)] + [f"P1-S{i:06d}" for i in range(4)])
