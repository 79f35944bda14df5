"""Chains of higher order, calendars, checks of controls, inserted anomalies and ranks."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.randomness import uniform
from tidemark.functions.ranking import seeded_rank
from tidemark.operators import calendar as C
from tidemark.operators import generate as G
from tidemark.operators import manipulation as M
from tidemark.operators import sequences as Q

T0 = datetime(2026, 3, 2, 9, tzinfo=UTC)


def log(spark, sessions, gap=30):
    rows = [(f"s{i}", f"s{i}-{k}", T0 + timedelta(hours=6 * i, seconds=gap * k), t) for i, s in enumerate(sessions) for k, t in enumerate(s)]
    return spark.createDataFrame(rows, "session_id string, event_id string, timestamp timestamp, token string")


def test_longest_context_decides(spark):
    seq = log(spark, ["abcab", "abdab"] * 3)
    made = G.markov(G.fit(seq, 2), 40, seed=3, order=2).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("s"))
    assert {r.s for r in made.collect()} == {"abcab", "abdab"}
    assert G.markov(G.fit(seq, 2), 5, 3, 2).agg(F.min("pos")).first()[0] == 1


def test_order_needs_long_sessions(spark):
    seq = log(spark, ["ab", "abc"])
    assert G.supported_order(seq, 2) == 2
    with pytest.raises(ValueError):
        G.supported_order(seq, 3)
    assert G.supported_order(seq, 3, backoff=True) == 2
    assert G.supported_order(seq.limit(0), 3, backoff=True) == 1


WORK = dict.fromkeys(("Mon", "Tue", "Wed", "Thu", "Fri"), 1.0)


def test_next_open(spark):
    office = C.opening(spark, "2026-03-27", "2026-03-31", hours={9: 1, 10: 1}, week=WORK, zone="Europe/Berlin")
    asked = ["2026-03-20 12:00:00", "2026-03-27 08:30:00", "2026-03-27 03:00:00", "2026-03-27 10:00:00", "2026-03-31 09:00:00", None]
    want = ["2026-03-27 08:00:00", "2026-03-27 08:30:00", "2026-03-27 08:00:00", "2026-03-30 07:00:00", "2026-03-31 09:00:00", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, t string").select("i", F.to_timestamp("t").alias("t"))
    got = office.next_open(rows, "t", "n").select("i", F.col("n").cast("string")).collect()
    assert [r.n for r in sorted(got)] == want


def test_calendar_starts_and_check(spark):
    office = C.opening(spark, "2026-03-02", "2026-03-29", hours={h: 1 for h in range(9, 17)}, week=WORK, rushes=[("2026-03-20", 3, 5.0)])
    starts = office.draw(spark.range(2000), 5, "id").select("start_time").cache()
    checked = office.check(starts).collect()
    assert {r.status for r in checked} == {"ok"} and {r.target for r in checked} == {"period", "closed", "distribution", "2026-03-20"}
    rush = starts.filter(F.to_date("start_time").between("2026-03-17", "2026-03-20")).count() / 2000
    assert abs(rush - 20 / 36) < 0.05
    night = starts.select((F.col("start_time") - F.expr("interval 10 hours")).alias("start_time"))
    assert {r.status for r in office.check(night).collect()} == {"failed", "ok"}
    assert {r.status for r in office.check(starts.limit(0)).collect()} == {"not_measurable"}
    calm = C.opening(spark, "2026-03-02", "2026-03-29", hours={h: 1 for h in range(9, 17)}, week=WORK)
    even = calm.draw(spark.range(2000), 6, "id")
    assert {r.target: r.status for r in office.check(even).collect()}["2026-03-20"] == "failed"
    for bad in ({"hours": {}}, {"hours": {24: 1}}, {"week": {"Day": 1}}, {"special": {"2026-03-02": 0.0, "2026-03-03": 0.0}}):
        with pytest.raises(ValueError):
            C.opening(spark, "2026-03-02", "2026-03-03", **bad)
    with pytest.raises(ValueError):
        C.opening(spark, "1000-01-01", "2999-12-31")


def test_learned_timetable_follows_the_log(spark):
    t = [T0 + timedelta(days=d) for d in (0, 0, 0, 7)]
    seen = C.learned(spark.createDataFrame([(x,) for x in t], "start_time timestamp"))
    assert {(str(r.day), r.weight) for r in seen.days.collect()} == {("2026-03-02", 3.0), ("2026-03-09", 1.0)}
    assert {r.hour for r in seen.hours.filter("weight > 0").collect()} == {9} and seen.hours.count() == 24
    with pytest.raises(ValueError):
        C.learned(spark.createDataFrame([], "start_time timestamp"))


def test_controls_are_measured(spark):
    a, b = log(spark, ["aab", "abc"], 10), log(spark, ["aaaa", "aaab"], 20)
    got = {(r.control, r.target): (r.before, r.after, r.status) for r in M.check_controls(a, b, {"a": 2.0, "b": 3.0, "c": 0.0, "z": 2.0, "y": 1.0}, {"*": 2.0, "a": 5.0, "z": 1.0}, 4 / 3).collect()}
    assert got == {
        ("event_weights", "a"): (0.5, 0.875, "ok"), ("event_weights", "b"): (0.333333, 0.125, "failed"), ("event_weights", "c"): (0.166667, 0.0, "ok"), ("event_weights", "z"): (0.0, 0.0, "not_measurable"),
        ("dwell_scale", "*"): (10.0, 20.0, "ok"), ("dwell_scale", "a"): (10.0, 20.0, "failed"), ("dwell_scale", "z"): (None, None, "not_measurable"), ("session_length", "scale"): (3.0, 4.0, "ok"),
    }


def test_bursts_shift_what_follows(spark):
    seq = log(spark, ["abc", "de"])
    chosen = seq.groupBy("session_id").agg(F.count("*").alias("n_events")).filter("session_id = 's0'")
    rows = sorted((r.new_us, r.token, r.inserted) for r in M.event_frequency(seq, chosen, "x", 4, 120, seed=1).collect())
    text = "".join(t for _, t, _ in rows)
    at = text.index("x")
    assert text == "abc"[:at] + "xxxx" + "abc"[at:] and at >= 1
    gaps = [(y[0] - x[0]) // 1_000_000 for x, y in zip(rows, rows[1:], strict=False)]
    assert all(g == 30 for g in gaps)


def test_inserted_pairs_were_never_seen(spark):
    seq = log(spark, ["abc", "bca"])
    chosen = seq.groupBy("session_id").agg(F.count("*").alias("n_events"))
    for sid, rows in (("s0", "abc"), ("s1", "bca")):
        made = "".join(r.token for r in sorted(M.unexpected_transition(seq, chosen, 10, seed=4).filter(F.col("session_id") == sid).collect(), key=lambda r: r.new_us) if r.inserted)
        assert len(made) == 2 and made not in ("ab", "bc", "ca") and set(made) <= set("abc") and rows
    every = log(spark, ["aa"])
    assert M.unexpected_transition(every, every.groupBy("session_id").agg(F.count("*").alias("n_events"))).count() == 0


def test_ranks_have_no_gaps(spark):
    rows = spark.range(20_000).withColumn("u", uniform(2, "r", F.floor(F.col("id") / 2)))
    ranked = seeded_rank(rows, F.col("u"), "id").orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 20_001))
    assert [(r.u, r.id) for r in ranked] == sorted((r.u, r.id) for r in ranked)
    assert seeded_rank(rows.limit(0), F.col("u"), "id").count() == 0
