"""Ground truth tables and injected anomalies on logs small enough to follow."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import log
from tidemark.operators import annotations as A
from tidemark.operators import injection as I
from tidemark.operators import sequences as Q
from tidemark.operators import sessionize as S

T0 = datetime(2026, 5, 4, 8, tzinfo=UTC)


@pytest.fixture(scope="module")
def seq(spark):
    rows = []
    for s in range(40):
        kinds = ["view", "read", "submit", "view"][: 1 + s % 4]
        rows += [(f"e{s}-{k}", f"u{s % 5}", T0 + timedelta(hours=s, minutes=2 * k), f"s{s}", f"{kind}-page{s % 3}", kind, "c", 1.0, True, 5, {}) for k, kind in enumerate(kinds)]
    return Q.tokens(spark.createDataFrame(rows, log.EVENTS))


def test_tables_are_checked(spark):
    good = A.rows(spark.createDataFrame([("a",), ("b",)], "id string"), "session", "anomaly", "burst", category="unusual_valid")
    more = A.rows(spark.createDataFrame([("a",)], "id string"), "learner", "profile", "steady", value=F.lit('"steady"'))
    both = A.together(good, more)
    assert both.count() == 3 and both.columns == list(A.COLUMNS)
    with pytest.raises(ValueError, match="duplicate"):
        A.together(good, good)
    for column, wrong in (("level", "course"), ("annotation", "guess"), ("category", None), ("value", "{"), ("id", "")):
        assert column in A.faults(good.withColumn(column, F.lit(wrong).cast("string")))
    assert A.faults(more.withColumn("category", F.lit("unusual_valid"))) == {"category": 1} and A.faults(A.empty(spark)) == {}
    assert A.anomalies(both, "session", kind="burst", category="unusual_valid").count() == 2 and A.anomalies(both, "event").count() == 0
    assert {r["id"] for r in A.anomalous_ids(both, "session").collect()} == {"a", "b"}
    to = spark.createDataFrame([("a", "x"), ("b", "y")], "old string, new string")
    assert {(r["level"], r["id"]) for r in A.remap(both, {"session": to, "learner": to}).collect()} == {("session", "x"), ("session", "y"), ("learner", "x")}
    with pytest.raises(Exception, match="no new one"):
        A.remap(both, {"session": to}).collect()


def test_requests_are_checked(tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"anomalies": [{"type": "inactivity", "rate": 0.1, "gap_s": 60}]}))
    assert I.load_requests(str(path)) == [I.Request("inactivity", 0.1, {"gap_s": 60})]
    path.write_text(json.dumps({"anomalies": [], "more": 1}))
    with pytest.raises(ValueError):
        I.load_requests(str(path))
    bad = [{}, {"type": "x", "rate": 0.1}, {"type": "inactivity", "rate": 0}, {"type": "inactivity", "rate": True}, {"type": "inactivity", "rate": 0.1, "gap": 1}, {"type": "inactivity", "rate": 0.1, "gap_s": -1}, {"type": "repetition", "rate": 0.1, "pattern": "zigzag"}, {"type": "abnormal_timing", "rate": 0.1, "factor": 1}, {"type": "unexpected_transition", "rate": 0.1, "transitions": [["a"]]}, {"type": "event_frequency", "rate": 0.1, "count": 1}]
    for spec in bad:
        with pytest.raises(ValueError):
            I.requests([spec])
    with pytest.raises(ValueError):
        I.requests([{"type": "inactivity", "rate": 0.6}, {"type": "repetition", "rate": 0.6}])


def spaced(rows):
    return [(b["timestamp"] - a["timestamp"]).total_seconds() for a, b in zip(rows, rows[1:], strict=False)]


def test_every_kind_changes_its_sessions_alone(seq):
    specs = [{"type": "event_frequency", "rate": 0.1, "token": "read", "count": 5, "window_s": 10}, {"type": "abnormal_timing", "rate": 0.1, "factor": 0.1}, {"type": "unexpected_transition", "rate": 0.1}, {"type": "repetition", "rate": 0.1, "length": 4, "gap_s": 3}, {"type": "inactivity", "rate": 0.1, "gap_s": 7200}]
    events, truth, report = I.inject(seq, specs, seed=3)
    assert A.faults(truth) == {} and A.unknown(truth, events).count() == 0
    assert [(k, r["requested"], r["injected"]) for k, r in report["anomalies"].items()] == [(s["type"], 4, 4) for s in specs]
    assert report["anomalies"]["abnormal_timing"]["not_applicable"] > 0
    by = {}
    for r in sorted(events.collect(), key=lambda r: r["event_id"]):
        by.setdefault(r["session_id"], []).append(r)
    kinds = {r["id"]: r["type"] for r in truth.filter("level = 'session'").collect()}
    hit = {r["id"] for r in truth.filter("level = 'event'").collect()}
    details = {r["id"]: json.loads(r["parameters"]) for r in truth.filter("level = 'session'").collect()}
    assert len(kinds) == 20 and len(by) == 40
    usual = {("view", "read"), ("read", "submit"), ("submit", "view")}
    for sid, rows in by.items():
        new = [r for r in rows if r["event_id"] in hit]
        gaps, pairs = spaced(rows), [(a["token"], b["token"]) for a, b in zip(rows, rows[1:], strict=False)]
        kind = kinds.get(sid)
        assert (len(new) > 0) == (kind is not None) and (not new or int(details[sid]["injected_events"]) == len(new))
        if kind in ("event_frequency", "repetition", "unexpected_transition"):
            assert all(r["score"] is None and r["activity_id"].startswith(r["token"]) for r in new)
            assert len(rows) - len(new) <= 4 and [r["token"] for r in rows if r not in new] == ["view", "read", "submit", "view"][: len(rows) - len(new)]
        if kind == "event_frequency":
            assert [r["token"] for r in new] == ["read"] * 5 and gaps.count(2) >= 4
        elif kind == "repetition":
            assert len({r["token"] for r in new}) == 2 and [r["token"] for r in new[:2]] == [r["token"] for r in new[2:]]
        elif kind == "unexpected_transition":
            assert (new[0]["token"], new[1]["token"]) not in usual
        elif kind == "abnormal_timing":
            assert set(gaps) == {12.0} and len(new) == len(rows) - 1
        elif kind == "inactivity":
            assert sorted(gaps)[-1] == 7320 and len(new) == 1
        else:
            assert set(gaps) <= {120.0} and set(pairs) <= usual
    spans = sorted((rows[0]["learner_id"], rows[0]["timestamp"], rows[-1]["timestamp"]) for rows in by.values())
    assert all(b[1] > a[2] for a, b in zip(spans, spans[1:], strict=False) if a[0] == b[0])
    numbers = sorted(int(r["event_id"][1:]) for rows in by.values() for r in rows)
    assert numbers == list(range(1, len(numbers) + 1)) and {sid[0] for sid in by} == {"S"}
    assert [r["event_id"] for rows in by.values() for r in rows] == [r["event_id"] for rows in by.values() for r in sorted(rows, key=lambda r: (r["timestamp"], r["event_id"]))]
    again, _, _ = I.inject(seq.repartition(7), specs, seed=3)
    assert log.fingerprint(again.drop("metadata")).first() == log.fingerprint(events.drop("metadata")).first()
    assert not any(log.check(events, S.sessions(events)).values())


def test_sessions_that_do_not_fit_are_passed_over(seq):
    _, truth, report = I.inject(seq, [{"type": "abnormal_timing", "rate": 1.0}], seed=1)
    assert report["anomalies"]["abnormal_timing"] | {"parameters": None} == {"category": "unusual_valid", "rate": 1.0, "requested": 40, "injected": 20, "not_applicable": 20, "parameters": None}
    everything = [{"type": "unexpected_transition", "rate": 0.5, "transitions": [["submit", "submit"]]}]
    events, truth, _ = I.inject(seq, everything, seed=1, reference=seq)
    assert truth.filter("level = 'event'").count() == 40 and events.filter("token = 'submit'").count() == 20 + 40


def test_kinds_can_be_added(seq):
    quiet = I.Kind("unusual_valid", {}, lambda p: True, lambda p, c: F.col("n_events") == 1, lambda rows, p, c, seed: rows.withColumn("__us", F.unix_micros("timestamp")).withColumn("__affected", F.lit(True)))
    I.register_anomaly("quiet", quiet)
    try:
        _, truth, _ = I.inject(seq, [{"type": "quiet", "rate": 0.1}], seed=2)
        assert {r["type"] for r in truth.collect()} == {"quiet"} and truth.count() == 8
        for name, kind in (("quiet", quiet), ("inactivity", quiet), ("not a name", quiet), ("other", len)):
            with pytest.raises(ValueError):
                I.register_anomaly(name, kind)
    finally:
        I.unregister_anomaly("quiet")
    assert "quiet" not in I.ANOMALIES
