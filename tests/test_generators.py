"""Families of lengths and gaps, settings, models on disk, controls and experiments."""

import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import log, models
from tidemark.operators import assemble, calendar, controls
from tidemark.operators import generate as G
from tidemark.operators import sequences as Q

T0 = datetime(2026, 5, 4, 8, tzinfo=UTC)


@pytest.fixture(scope="module")
def seq(spark):
    rows = []
    for s in range(60):
        kinds, gap = ["view", "read", "submit", "view", "read"][: 2 + s % 4], 10
        at = T0 + timedelta(hours=7 * s)
        for k, kind in enumerate(kinds):
            rows.append((f"e{s}-{k}", f"u{s % 12}", at, f"s{s}", f"{kind}-{s % 2}", kind, f"c{s % 12 % 3}", 1.0, True, 5, {"device": "x"}))
            at += timedelta(seconds=gap * (1 + s % 5) * (3 if kind == "read" else 1))
    return Q.tokens(spark.createDataFrame(rows, log.EVENTS))


def test_settings_are_checked():
    assert G.hyperparameters("semi_markov", {"order": 2})["min_samples"] == 5
    for name, bad in (("markov", {"order": 0}), ("markov", {"order": True}), ("markov", {"timing_family": "gamma"}), ("semi_markov", {"timing_family": "weibull"}), ("independent", {"order": 1}), ("markov", {"length_model": "fixed"}), ("markov", {"smoothing_alpha": -1})):
        with pytest.raises(ValueError):
            G.hyperparameters(name, bad)


def test_length_models(spark, seq):
    assert {(r["len"], r["n"]) for r in G.fit_lengths(seq).collect()} == {(n, 15) for n in (2, 3, 4, 5)}
    assert G.fit_lengths(seq, "fixed", 7).collect() == [(7, 1)]
    for rate in (0.0, 2.5, 80.0):
        rows = G.poisson_lengths(spark, rate).collect()
        assert sum(r["n"] for r in rows) == pytest.approx(1) and sum((r["len"] - 1) * r["n"] for r in rows) == pytest.approx(rate)
    model = G.fit(seq, length="poisson")
    lengths = [r["n"] for r in G.independent(model, 2000, seed=2).groupBy("session_id").agg(F.count("*").alias("n")).collect()]
    assert sum(lengths) / 2000 == pytest.approx(3.5, abs=0.15) and min(lengths) >= 1


@pytest.mark.parametrize("family", ["empirical", "lognormal", "gamma", "exponential", "constant"])
def test_gap_families_keep_their_moments(spark, seq, family):
    gaps = G.fit_gaps(seq, family, 5)
    by = {r["token"]: r for r in gaps.collect()}
    assert set(by) == {None, "view", "read", "submit"} and set(G_family(by)) == {family}
    path = spark.range(4000).select(F.format_string("S%05d", "id").alias("session_id"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("read").alias("token")), F.struct(F.lit(2).alias("pos"), F.lit("view").alias("token")))).alias("x")).select("session_id", "x.*")
    drawn = [r["at_s"] for r in G.timed(path, gaps, 5).filter("pos = 2").collect()]
    mean = sum(drawn) / len(drawn)
    seen = [10 * (1 + s % 5) * 3 for s in range(60) if s % 4 >= 1]
    if family == "constant":
        assert set(drawn) == {sorted(seen)[len(seen) // 2]}
    else:
        assert mean == pytest.approx(sum(seen) / len(seen), rel=0.08)
    if family == "gamma":
        spread = sum((x - mean) ** 2 for x in drawn) / len(drawn)
        assert spread == pytest.approx(sum((x - sum(seen) / len(seen)) ** 2 for x in seen) / len(seen), rel=0.15)
    if family == "lognormal":
        logs = [math.log(x) for x in drawn]
        assert sum(logs) / len(logs) == pytest.approx(by["read"]["a"], abs=0.03)
    assert set(drawn) <= set(map(float, seen)) or family not in ("empirical", "constant")


def G_family(by):
    return {r["family"] for r in by.values()}


def test_degenerate_and_pooled_gaps(spark, seq):
    same = seq.filter("session_id in ('s0', 's4', 's8')")
    assert {r["token"] for r in G.fit_gaps(same, "gamma", 50).collect()} == {None}
    still = seq.withColumn("timestamp", F.lit(T0))
    for family in ("lognormal", "exponential", "gamma"):
        assert {(r["family"], r["a"]) for r in G.fit_gaps(still, family).collect()} == {("constant", 0.0)}
    assert G.fit_gaps(seq.limit(0), "lognormal").count() == 0


def test_smoothing_reaches_unseen_pairs(seq):
    plain = G.fit_named("markov", seq)
    assert plain.settings["order"] == 1 and plain.settings["generator"] == "markov"
    pairs = lambda m: {(r["src"], r["dst"]) for r in Q.edges(log_like(G.sample(m, 300, 1))).collect()}
    seen = {("view", "read"), ("read", "submit"), ("submit", "view")}
    assert pairs(plain) <= seen and len(pairs(G.fit_named("markov", seq, {"smoothing_alpha": 50.0}))) == 9
    with pytest.raises(ValueError):
        G.fit_named("markov", seq, {"order": 9})
    assert G.fit_named("markov", seq, {"order": 9, "on_insufficient_data": "backoff"}).settings["order"] == 4


def log_like(sample):
    return sample.select("session_id", F.format_string("%05d", F.col("pos").cast("int")).alias("event_id"), F.timestamp_seconds("at_s").alias("timestamp"), "token")


def test_models_come_back_as_they_were(spark, seq, tmp_path):
    model = G.fit_named("semi_markov", seq, {"order": 2})
    path = str(tmp_path / "model")
    models.save(model, path, training=seq)
    back = models.load(spark, path)
    assert back.settings == model.settings and sorted(map(tuple, G.sample(back, 30, 3).collect())) == sorted(map(tuple, G.sample(model, 30, 3).collect()))
    assert "| order | 2 |" in (tmp_path / "model" / "DESCRIPTION.md").read_text()
    with pytest.raises(ValueError, match="exists"):
        models.save(model, path)
    models.save(model, path, force=True)
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "letter.txt").write_text("mine")
    with pytest.raises(ValueError, match="not ours"):
        models.save(model, str(tmp_path / "own"), force=True)
    models.load(spark, path)["tokens"].limit(1).write.mode("append").parquet(f"{path}/tokens")
    with pytest.raises(ValueError, match="not the one"):
        models.load(spark, path)
    with pytest.raises(RuntimeError), models.Staged(spark, str(tmp_path / "half")) as aside:
        models.write_json(spark, f"{aside}/a.json", {})
        raise RuntimeError
    assert sorted(p.name for p in tmp_path.iterdir()) == ["model", "own"]


def test_controls_are_checked_and_applied(seq):
    model = G.fit_named("semi_markov", seq)
    for bad in ({"weights": {}}, {"event_weights": {"a": -1}}, {"dwell_scale": {"a": 0}}, {"session_length": {"scale": 2, "fixed": 3}}, {"session_length": {"fixed": 1.5}}, {"sessions_per_learner": {"scale": 2}}, {"event_weights": 3}):
        with pytest.raises(ValueError):
            controls.controls(bad)
    for bad in ({"event_weights": {"nothing": 2}}, {"event_weights": dict.fromkeys(("view", "read", "submit"), 0)}, {"event_weights": {"*": 2}}):
        with pytest.raises(ValueError):
            controls.apply(model, bad)
    assert controls.apply(model, {}).settings == model.settings
    made = controls.apply(model, {"event_weights": {"submit": 0}, "dwell_scale": {"*": 2.0, "read": 3}, "session_length": {"scale": 1.5}, "sessions_per_learner": {"mean": 10}})
    assert {r["token"] for r in made["tokens"].collect()} == {"view", "read"} and made.settings["dwell_scale"] == {"*": 2.0, "read": 3.0}
    assert {(r["len"], r["n"]) for r in made["lengths"].collect()} == {(3, 15), (4, 15), (6, 15), (8, 15)}
    assert made["per_learner"].collect() == [(10, 12)] and len(made.settings["controls"]) == 1
    assert controls.apply(made, {"dwell_scale": {"read": 2}}).settings["dwell_scale"]["read"] == 6.0


def test_experiments_do_what_was_asked(spark, seq):
    model = G.fit_named("semi_markov", seq)
    plan = calendar.opening(spark, "2026-06-01", "2026-06-28", hours={h: 1 for h in range(9, 17)})
    spec = {"controls": {"event_weights": {"submit": 0}, "dwell_scale": {"*": 3}, "session_length": {"fixed": 4}, "sessions_per_learner": {"fixed": 3}}, "anomalies": [{"type": "inactivity", "rate": 0.2}]}
    made = assemble.experiment(model, spec, 90, 4, calendar=plan)
    checked = {(r["control"], r["target"]): r["status"] for r in made["check"].collect()}
    assert set(checked.values()) == {"ok"} and {c for c, _ in checked} == {"event_weights", "dwell_scale", "session_length", "sessions_per_learner", "calendar", "calendar.hours", "calendar.weekdays"}
    assert made["annotations"].filter("level = 'session'").count() == 18
    events = made["events"]
    assert events.count() == 360 and events.select("learner_id").distinct().count() == 30
    assert {r["course_id"] for r in events.select("course_id").distinct().collect()} <= {"c0", "c1", "c2"}
    assert events.filter("not startswith(activity_id, event_type)").count() == 0
    plain = assemble.log_of(model, 30, 1)
    days = {str(r["d"]) for r in plain.select(F.to_date("timestamp").alias("d")).distinct().collect()}
    assert min(days) >= "2026-05-04" and not any(log.check(plain).values())
    for bad in ({}, {"controls": {}}, {"other": 1}):
        with pytest.raises(ValueError):
            assemble.experiment(model, bad, 10)
