from __future__ import annotations

import datetime
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tidemark import benchmark, log, plugins
from tidemark.functions import distances, ranking
from tidemark.operators import generate, profile, sequences, sessionize, validation
from tidemark.sources import files, ingest
from tidemark.streaming import sessions as streams

BASE = datetime.datetime(2026, 3, 1, 9, tzinfo=datetime.UTC)
#: Events of three learners: id, learner, minute, type, activity, session.
ROWS = [
    ("n4", "nora", 50, "open", "atlas", None), ("n1", "nora", 0, "open", "map", None), ("n3", "nora", 4, "read", "atlas", None), ("n2", "nora", 4, "read", "map", None),
    ("p2", "paul", 3, "quit", "map", "desk"), ("p1", "paul", 0, "open", "map", "desk"), ("q1", "quinn", 7, "read", "atlas", None),
]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(e, l, BASE + datetime.timedelta(minutes=m), s, a, t, "c1", None, t != "quit", None, {}) for e, l, m, t, a, s in ROWS]
    return spark.createDataFrame(rows, log.EVENTS)


def paths(toy, **options):
    made = sessionize.sessions(sessionize.sessionize(toy, **options))
    return {r["session_id"]: r["event_sequence"] for r in made.collect()}


def test_sessions(toy):
    assert paths(toy) == {"nora:s1": ["open", "read", "read"], "nora:s2": ["open"], "desk": ["open", "quit"], "quinn:s1": ["read"]}
    assert "nora:s2" not in paths(toy, idle_timeout_s=46 * 60) and "nora:s2" in paths(toy, idle_timeout_s=46 * 60 - 1)
    assert "paul:s1" in paths(toy, strategy="idle_timeout")
    with pytest.raises(ValueError):
        sessionize.sessionize(toy, idle_timeout_s=0)
    made = sessionize.sessionize(toy)
    assert not any(log.check(made, sessionize.sessions(made)).values())
    assert log.fingerprint(toy.drop("metadata")).first() == log.fingerprint(toy.drop("metadata").repartition(5)).first()
    assert {r["learner_id"]: r["course_ids"] for r in sessionize.participants(toy, sessionize.sessions(made)).collect()} == {"nora": ["c1"], "paul": ["c1"], "quinn": ["c1"]}


def test_fingerprint_of_many_rows(spark):
    n = 70_000
    hashes = [int(hashlib.sha256(f'{{"id":{i}}}'.encode()).hexdigest()[:12], 16) for i in range(n)]
    assert sum(hashes) >= 1 << 63
    mixed = 0
    for h in hashes:
        mixed ^= h
    made = log.fingerprint(spark.range(n))
    assert made.first() == (n, int.from_bytes((sum(hashes) % (1 << 64)).to_bytes(8, "big"), "big", signed=True), mixed)
    assert dict(made.dtypes) == {"n_rows": "bigint", "hash_sum": "bigint", "hash_xor": "bigint"}
    assert log.fingerprint(spark.range(9)).first()["hash_sum"] == sum(hashes[:9]) and log.fingerprint(spark.range(0)).first() == (0, 0, 0)


def test_explicit_sessions_are_checked(toy):
    with pytest.raises(Exception, match="an id on every event"):
        sessionize.sessionize(toy, strategy="explicit").collect()
    named = toy.withColumn("session_id", F.col("learner_id"))
    assert paths(named, strategy="explicit")["nora"] == ["open", "read", "read", "open"]
    shared = toy.withColumn("session_id", F.lit("all"))
    with pytest.raises(Exception, match="two learners"):
        sessionize.sessionize(shared, strategy="explicit").collect()
    assert sessionize.conflicts(shared).first()["n_learners"] == 3
    clash = toy.withColumn("session_id", F.when(F.col("learner_id") == "paul", F.lit("nora:s1")))
    with pytest.raises(Exception, match="two learners"):
        sessionize.sessionize(clash, strict=True).collect()


def test_sequences(toy):
    seq = sequences.tokens(sessionize.sessionize(toy))
    assert {(r["ngram"], r["n"]) for r in sequences.ngrams(seq, 2).collect()} == {("open > read", 1), ("read > read", 1), ("open > quit", 1)}
    d = sequences.density(sequences.transitions(seq)).first()
    assert (d["n_starts"], d["vocabulary"], d["density"]) == (4, 3, round(3 / 9, 6))
    rows = sequences.probabilities(sequences.transitions(seq), 1.0).groupBy("context").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in rows)
    assert sorted(r["gap_s"] for r in profile.gaps(seq).collect()) == [0, 180, 240]
    assert {(r["token"], r["label"], r["n"]) for r in sequences.predecessors(seq, 1).collect()} == {("open", "<start>", 3), ("quit", "open", 1), ("read", "<start>", 1)}


def test_quantiles_in_slices(spark):
    rng = random.Random(4)
    values = [(k, x) for k, n in (("a", 1), ("b", 500), (None, 37)) for x in [float(rng.choice([-1, 1])) * rng.choice([0, 0.5, 1, 3, rng.uniform(0, 1e6), rng.expovariate(9)]) for _ in range(n)]]
    frame = spark.createDataFrame([*values, ("a", None)], "k string, x double")
    got = {r["k"]: r for r in ranking.quantiles(frame, F.col("x"), {"q": 0.1, "m": 0.5, "z": 1.0}, ("k",)).collect()}
    stats = {r["k"]: r["points"] for r in ranking.order_statistics(frame, F.col("x"), 20, ("k",)).collect()}
    for k in ("a", "b", None):
        own = sorted(x for key, x in values if key == k)
        for name, p in (("q", 0.1), ("m", 0.5), ("z", 1.0)):
            at = (len(own) - 1) * p
            low = int(at)
            assert got[k][name] == pytest.approx(own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low))
        assert stats[k] == (own if len(own) <= 20 else [own[round(i * (len(own) - 1) / 19)] for i in range(20)])
    one = profile.describe(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double"), "x").first()
    assert (one["n"], one["p25"], one["median"], one["p75"]) == (4, 1.75, 3.0, 5.5)
    none = profile.describe(frame.limit(0), "x").first()
    assert none["n"] == 0 and none["median"] is None
    assert profile.describe(frame.limit(0), "x", "k").count() == 0
    whole = ranking.cumulate(frame.filter("x is not null").groupBy("x").agg(F.count("*").alias("n")), "x", ["n"]).orderBy("x").collect()
    seen = 0
    for r, after in zip(whole, [*whole[1:], None], strict=True):
        assert (r["n_before"], r["n_total"], r["next"]) == (seen, len(values), after and after["x"])
        seen += r["n"]


def test_distances_of_equal_and_disjoint_logs(toy):
    seq = sequences.tokens(sessionize.sessionize(toy))
    same = {r["metric"]: r["value"] for r in validation.validate(seq, seq).collect()}
    assert all(same[k] == 0 for k in ("event_type_tvd", "activity_jsd", "session_length_ks", "session_duration_w1", "interevent_time_ks", "bigram_tvd", "transition_jsd"))
    assert same["topn_path_overlap"] == same["exact_session_dup_rate"] == 1
    other = seq.withColumn("event_type", F.lit("x")).withColumn("token", F.lit("x")).withColumn("activity_id", F.lit("y"))
    far = {r["metric"]: r["value"] for r in validation.validate(seq, other).collect()}
    assert far["event_type_tvd"] == far["activity_jsd"] == far["bigram_tvd"] == far["transition_jsd"] == 1
    assert far["topn_path_overlap"] == far["exact_session_dup_rate"] == 0
    one = seq.sparkSession.createDataFrame([(["a", "b", "c"], ["a", "c"])], "x array<string>, y array<string>")
    assert one.select(distances.edit_distance(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3)
    rows = [(["a", "z"], ["a"], 0.5), ([], [], 0.0), (["é", "漢", "é"], ["漢"], 2 / 3), ([str(i) for i in range(300)], [str(i) for i in range(299)] + ["x"], 1 / 300)]
    for x, y, d in rows:
        assert seq.sparkSession.createDataFrame([(x, y)], "x array<string>, y array<string>").select(distances.edit_distance(F.col("x"), F.col("y"))).first()[0] == pytest.approx(d)


def test_evaluation(spark):
    scored = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.4), (False, None)], "truth boolean, score double")
    r = validation.detection(scored).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["roc_auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "truth string, predicted int")
    assert validation.clustering(same).first().asDict() == {"ari": 1.0, "nmi": 1.0, "purity": 1.0}
    single = spark.createDataFrame([("a", 1), ("a", 1)], "truth string, predicted int")
    assert validation.clustering(single).first().asDict() == {"ari": 1.0, "nmi": 1.0, "purity": 1.0}


def test_generators_follow_what_they_saw(spark):
    rows = [(f"e{s}-{i}", f"u{s % 3}", BASE + datetime.timedelta(hours=6 * s, seconds=30 * i), f"s{s}", "x", t) for s in range(10) for i, t in enumerate("abc")]
    seq = sequences.tokens(spark.createDataFrame(rows, "event_id string, learner_id string, timestamp timestamp, session_id string, activity_id string, event_type string"))
    model = generate.fit(seq)
    made = generate.semi_markov(model, 20, seed=1)
    got = made.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("p"), F.max("at_s").alias("m")).collect()
    assert len(got) == 20 and {r["p"] for r in got} == {"abc"} and all(r["m"] == pytest.approx(60) for r in got)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, generate.semi_markov(model, 20, seed=1).repartition(7).collect()))
    gone = generate.independent(generate.reweight(model, {"b": 0.0}), 30)
    assert {r["token"] for r in gone.collect()} == {"a", "c"}
    report = benchmark.run(seq, generators=("markov",), repeats=2, n_sessions=10).collect()
    assert {r["generator"] for r in report} == {"reference", "markov"}


def test_ingest_reasons_and_pseudonyms(spark):
    raw = spark.createDataFrame([(0, "1", "u", "2026-01-01 10:00:00", "r", "view", " 2 "), (1, "2", "u", "soon", "r", "view", None), (2, "3", " ", "2026-01-01 10:00:00", "r", "view", "x"), (3, "1", "u", "2026-01-01 10:00:00", "r", "view", "inf"), (4, None, "u", "2026-01-01 09:00:00", "r", "view", "1e3")], "__row bigint, id string, who string, at string, what string, kind string, grade string")
    mapping = ingest.Mapping({"event_id": ingest.Spec("id"), "learner_id": ingest.Spec("who", hash_salt="k"), "timestamp": ingest.Spec("at", format="%Y-%m-%d %H:%M:%S", timezone="Europe/Paris"), "activity_id": ingest.Spec("what"), "event_type": ingest.Spec("kind"), "score": ingest.Spec("grade")}, metadata=("grade",))
    events, report = ingest.ingest(raw, mapping)
    got = {r["event_id"]: r for r in events.collect()}
    assert sorted(got) == ["1", "row-4"] and got["1"]["score"] == 2.0 and got["row-4"]["score"] == 1000.0
    assert got["1"]["learner_id"] == "h_" + hmac.new(b"k", b"u", hashlib.sha256).hexdigest()[:32]
    assert got["1"]["timestamp"].astimezone(datetime.UTC).hour in (9, 10, 8)
    counts = {r["reason"]: r["n"] for r in report.collect()}
    assert counts == {"timestamp:invalid_timestamp": 1, "learner_id:missing_required": 1, "score:invalid_double": 1, "score:not_finite": 1, "out_of_order": 1, "rows_read": 5, "rows_kept": 2, "naive_timezone": 2}


def test_files_and_corpora(spark, toy, tmp_path):
    (tmp_path / "x.csv").write_text('﻿a,b\n1,"x\ny"\n2\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_source(spark, str(tmp_path / "x.csv")).collect()] == [("1", "x\ny"), ("2", None)]
    (tmp_path / "y.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        files.read_source(spark, str(tmp_path / "y.csv")).collect()
    made = sessionize.sessionize(toy)
    files.write_corpus(made, f"{tmp_path}/c", sessionize.sessions(made), {"name": "toy"})
    events, held, metadata = files.read_corpus(spark, f"{tmp_path}/c")
    assert events.count() == 7 and held.count() == 4 and metadata == {"name": "toy"}
    files.write_table(events.limit(3), f"{tmp_path}/more", "parquet")
    spark.read.parquet(f"{tmp_path}/more").write.mode("append").parquet(f"{tmp_path}/c/events")
    with pytest.raises(ValueError, match="fingerprint"):
        files.read_corpus(spark, f"{tmp_path}/c")
    for kind in ("csv", "tsv", "jsonl"):
        files.write_table(made, f"{tmp_path}/t.{kind}", kind)
        assert files.read_source(spark, f"{tmp_path}/t.{kind}").count() == 7


def test_stream_and_plugins(spark, toy, tmp_path):
    toy.select("learner_id", "timestamp", "event_type").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("learner_id string, timestamp timestamp, event_type string").parquet(f"{tmp_path}/in")
    run = streams.session_counts(stream).writeStream.format("memory").queryName("held").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["n_events"] for r in spark.table("held").collect()) == [1, 1, 2, 3]
    plugins.register("metric", "mine", lambda ev, seq: ev)
    assert "mine" in plugins.available("metric")
    plugins.unregister("metric", "mine")
    with pytest.raises(ValueError):
        plugins.register("metric", "bigram_tvd", len)
