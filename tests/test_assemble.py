"""Sessions dealt to learners: all of them, as many each as drawn, in the calendar and never overlapping."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.operators import assemble as A
from tidemark.operators.calendar import opening


def laid(spark, n, calendar, own=3):
    sample = spark.range(n).select(F.format_string("S%06d", F.col("id")).alias("session_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit("view").alias("token"), F.lit(600.5 * (p - 1)).alias("at_s")) for p in (1, 2, 3)))).alias("e")).select("session_id", "e.*")
    histogram = spark.createDataFrame([(own, 4)], "sessions bigint, n bigint")
    rows = A.assemble(sample, n, histogram, calendar, seed=3)
    return rows.groupBy("learner_id", "session_id").agg(F.unix_micros(F.min("timestamp")).alias("a"), F.unix_micros(F.max("timestamp")).alias("b")).orderBy("learner_id", "a").collect()


def test_all_sessions_are_dealt(spark):
    found = laid(spark, 100, opening(spark, "2026-03-02", "2026-03-08"))
    assert len({r.session_id for r in found}) == len(found) == 100
    owners = [r.learner_id for r in found]
    assert sorted(owners.count(x) for x in set(owners)) == [1] + [3] * 33
    assert all(r.b - r.a == 1_201_000_000 for r in found)
    assert [(r.session_id, r.a) for r in found] == [(r.session_id, r.a) for r in laid(spark, 100, opening(spark, "2026-03-02", "2026-03-08"))]


def test_no_overlap_where_time_is_short(spark):
    hour = opening(spark, "2026-03-02", "2026-03-02", hours={9: 1.0})
    found = laid(spark, 60, hour, own=20)
    assert any(y.a - x.b == A.APART for x, y in zip(found, found[1:], strict=False) if x.learner_id == y.learner_id)
    assert all(y.a - x.b >= A.APART for x, y in zip(found, found[1:], strict=False) if x.learner_id == y.learner_id)
    first = int(datetime(2026, 3, 2, 9, tzinfo=UTC).timestamp()) * 1_000_000
    opened = {r.learner_id: r.a for r in reversed(found)}
    assert all(first <= a < first + 3_600_000_000 for a in opened.values())


def test_blocks_of_learners(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 8)
    histogram = spark.createDataFrame([(1, 3), (2, 5), (4, 1)], "sessions bigint, n bigint")
    slots = A._slots(histogram, 200, 1).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1, 201))
    assert [r.learner for r in slots] == sorted(r.learner for r in slots)
