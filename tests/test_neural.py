"""The recurrent generator: slopes against differences, what it learns, shards, blocks, models on disk."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import benchmark, log, models
from tidemark.operators import assemble, controls, neural
from tidemark.operators import generate as G
from tidemark.operators import sequences as Q

SMALL = {"embedding_dim": 6, "hidden_dim": 12, "epochs": 12, "learning_rate": 0.03, "batch_size": 16}


@pytest.fixture(scope="module")
def seq(spark):
    """a b a b ... or c c c ...; 5 s after a, 50 s after any other."""
    rows, start = [], datetime(2026, 5, 4, 8, tzinfo=UTC)
    for s in range(120):
        at = start + timedelta(hours=s)
        for k in range(3 + s % 4):
            kind = "c" if s % 2 else "ab"[k % 2]
            rows.append((f"e{s}-{k}", f"u{s % 9}", at, f"s{s}", kind, kind, None, None, None, None, None))
            at += timedelta(seconds=5 if kind == "a" else 50)
    return Q.tokens(spark.createDataFrame(rows, log.EVENTS))


@pytest.fixture(scope="module")
def model(seq):
    return G.fit_named("gru", seq, SMALL)


@pytest.mark.parametrize("binned", [True, False])
def test_slopes_are_those_of_differences(binned):
    h = {"embedding_dim": 3, "hidden_dim": 4, "seed": 1}
    w = {k: v.astype(np.float64) for k, v in neural.initial(5, 6, h).items()}
    rng = np.random.default_rng(2)
    batch = [(rng.integers(1, 6, n), rng.integers(0, 6, n - 1) if binned else rng.normal(0, 1, n - 1)) for n in (1, 4, 7)]
    total, count, slopes = neural.loss_and_slopes(w, batch, binned)
    assert count == 12
    for k, v in w.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]:
            old, both = v[at], []
            for d in (1e-5, -1e-5):
                v[at] = old + d
                both.append(neural.loss_and_slopes(w, batch, binned, slopes=False)[0] / count)
            v[at] = old
            assert slopes[k][at] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-7), k


def test_learns_tokens_and_times(seq, model):
    told = model.settings["history"]
    assert told[-1] < told[0] / 2 and model.settings["epochs_trained"] == len(told) and model.settings["validation_loss"] == min(told)
    rows = G.sample(model, 600, seed=3).orderBy("session_id", "pos").collect()
    paths: dict = {}
    for r in rows:
        paths.setdefault(r["session_id"], []).append((r["token"], r["at_s"]))
    assert len(paths) == 600 and {len(p) for p in paths.values()} == {3, 4, 5, 6}
    steps = [(p[k][0], p[k + 1][0], round(p[k + 1][1] - p[k][1], 3)) for p in paths.values() for k in range(len(p) - 1)]
    fits = [(b == {"a": "b", "b": "a", "c": "c"}[a]) and gap == (5 if a == "a" else 50) for a, b, gap in steps]
    assert sum(fits) / len(fits) > 0.9
    assert 0.3 < sum(p[0][0] == "c" for p in paths.values()) / 600 < 0.7


def test_samples_do_not_depend_on_partitions_and_models_return_from_disk(spark, model, tmp_path):
    want = sorted(G.sample(model, 300, seed=5).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(G.sample(model, 300, seed=5).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    models.save(model, f"file://{tmp_path}/m")
    again = models.load(spark, f"file://{tmp_path}/m")
    assert sorted(G.sample(again, 300, seed=5).collect()) == want
    assert sorted(G.sample(model, 300, seed=6).collect()) != want


def test_shards_are_averaged(seq, monkeypatch):
    monkeypatch.setattr(neural, "SHARD_SESSIONS", 30)
    monkeypatch.setattr(neural, "PIECE", 50)
    one, two = (G.fit_named("gru", seq, SMALL | {"epochs": 3, "timing": "mixture", "max_length": 4}) for _ in range(2))
    assert one.settings["history"] == pytest.approx(two.settings["history"]) and one.settings["history"][-1] < one.settings["history"][0]
    assert {r["tensor"]: bytes(r["body"]) for r in one["weights"].collect()} == {r["tensor"]: bytes(r["body"]) for r in two["weights"].collect()}
    low, high = one.settings["log_gap_range"]
    gaps = G.sample(one, 50, seed=1).groupBy("session_id").agg(F.max("at_s").alias("m"), F.count("*").alias("n")).filter("n > 1").collect()
    assert all(np.exp(low) * (r["n"] - 1) - 0.01 <= r["m"] <= np.exp(high) * (r["n"] - 1) + 0.01 for r in gaps)


def test_bins(spark):
    few = spark.createDataFrame([(x,) for x in (4.0, 1.0, 1.0, 16.0)], "x double")
    (a, one), (b, two), (c, three) = neural.gap_bins(few, 3)
    assert (one, two, three, c) == ([1.0], [4.0], [16.0], None) and np.exp([a, b]) == pytest.approx([2, 8])
    many = neural.gap_bins(spark.range(1, 1001).select(F.col("id").cast("double").alias("x")), 10)
    assert len(many) == 10 and all(len(v) <= neural.KEPT for _, v in many)
    assert all(max(v) <= np.exp(e) + 1e-6 < min(w) for (e, v), (_, w) in zip(many, many[1:], strict=False))
    assert neural.gap_bins(few.limit(0), 3) == [(None, [1.0])]


def test_settings_controls_and_awkward_logs(spark, seq, model):
    for bad in ({"timing": "other"}, {"validation_fraction": 1.0}, {"epochs": 0}, {"order": 1}):
        with pytest.raises(ValueError):
            G.hyperparameters("gru", bad)
    with pytest.raises(ValueError, match="no weights"):
        controls.apply(model, {"event_weights": {"a": 2}})
    last = lambda m: {r["session_id"]: r["m"] for r in G.sample(m, 40, seed=2).groupBy("session_id").agg(F.max("at_s").alias("m")).collect()}
    plain, slow = last(model), last(controls.apply(model, {"dwell_scale": {"*": 2}}))
    assert all(slow[k] == pytest.approx(2 * v, abs=0.01) for k, v in plain.items())
    with pytest.raises(ValueError, match="no network"):
        G.gru(G.fit(seq), 3)
    with pytest.raises(ValueError, match="no sessions"):
        neural.fit(seq.limit(0), G.hyperparameters("gru", {}))
    lone = seq.filter("session_id = 's0'").limit(1)
    own = G.fit_named("gru", lone, SMALL | {"epochs": 1})
    assert [(r["token"], r["at_s"]) for r in G.sample(own, 2).collect()] == [("a", 0.0)] * 2
    events = assemble.log_of(model, 30, 4)
    assert events.select("session_id").distinct().count() == 30


def test_benchmark_fits_the_network(seq, monkeypatch):
    monkeypatch.setitem(G.HYPERPARAMETERS, "gru", G.HYPERPARAMETERS["gru"] | {"epochs": (int, 2)})
    got = benchmark.run(seq, generators=("gru",), repeats=1, n_sessions=40, metrics=("bigram_tvd", "session_length_ks"))
    assert {(r["generator"], r["metric"]) for r in got.collect()} == {(g, m) for g in ("gru", "reference") for m in ("bigram_tvd", "session_length_ks")}
