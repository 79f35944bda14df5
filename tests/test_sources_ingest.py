"""Files of all formats with their faults, mappings, quality reports and corpora."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import log
from tidemark.operators import annotations as A
from tidemark.operators import sessionize
from tidemark.sources import files, ingest


def test_formats_and_registries(spark, tmp_path):
    assert [files.detect_format(f"x{s}") for s in (".csv", ".tsv", ".ndjson", ".pq")] == ["csv", "tsv", "jsonl", "parquet"]
    with pytest.raises(ValueError):
        files.detect_format("x.doc")
    files.register_reader("lines", lambda s, p: s.read.text(p), ".txt")
    try:
        (tmp_path / "a.txt").write_text("one\ntwo\n")
        assert files.read_source(spark, f"{tmp_path}/a.txt").count() == 2 and "lines" in files.available_readers()
        for kind, suffix in (("csv", ".x"), ("lines", ".y"), ("new", ".csv"), ("new", "y")):
            with pytest.raises(ValueError):
                files.register_reader(kind, len, suffix)
        files.register_reader("odd", lambda s, p: [1], ".odd")
        (tmp_path / "b.odd").write_text("")
        with pytest.raises(TypeError):
            files.read_source(spark, f"{tmp_path}/b.odd")
    finally:
        files.unregister_reader("lines")
        files.unregister_reader("odd")
    with pytest.raises(ValueError):
        files.detect_format("a.txt")
    with pytest.raises(FileNotFoundError):
        files.read_source(spark, f"{tmp_path}/none.csv")


def test_delimited_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "1.csv").write_text('﻿a,b\n1,"x, y"\n', encoding="utf-8")
    (folder / "2.csv").write_text('a,b\r\n2,"say ""so"""\r\n3\r\n', encoding="utf-8")
    got = {tuple(r) for r in files.read_source(spark, str(folder)).collect()}
    assert got == {("1", "x, y"), ("2", 'say "so"'), ("3", None)}
    (folder / "3.csv").write_text("b,a\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_source(spark, str(folder))
    for i, text in enumerate(("a,a\n1,2\n", "a,\n1,2\n", "")):
        (tmp_path / f"h{i}.csv").write_text(text)
        with pytest.raises(ValueError):
            files.read_source(spark, f"{tmp_path}/h{i}.csv")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"x": [1, 2]}}\n\n{"a": "t", "c": null}\n')
    rows = {r["a"]: r.asDict() for r in files.read_source(spark, f"{tmp_path}/a.jsonl").collect()}
    assert rows["1"]["b"] == '{"x":[1,2]}' and rows["t"] == {"a": "t", "b": None, "c": None}
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="no JSON object"):
        files.read_source(spark, f"{tmp_path}/b.jsonl").collect()


def test_rows_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a\n" + "".join(f"{i}\n" for i in range(1, 3001)))
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = ingest.numbered(files.read_source(spark, str(path)))
            assert got.rdd.getNumPartitions() > 0
            assert all(int(r["a"]) == r["__row"] for r in got.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mappings_are_checked(tmp_path):
    data = {"fields": {"learner_id": {"source": "who", "hash": {"salt": "s"}}, "timestamp": {"source": "at", "format": "%d.%m.%Y"}, "activity_id": "what", "event_type": {"source": "kind", "default": "view"}}, "metadata": ["note"], "drop": ["mail"], "timezone": "Europe/Berlin"}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(data))
    made = ingest.Mapping.from_file(str(path))
    assert made.to_dict()["fields"]["learner_id"] == {"source": "who", "hash": {"salt": "<redacted>"}}
    assert ingest.Mapping.from_dict(made.to_dict() | {"drop": []}).fields["timestamp"] == made.fields["timestamp"]
    assert made.known_columns() == {"who", "at", "what", "kind", "note", "mail"} and made.missing_columns(["at"]) == ["what", "who"]
    assert set(ingest.Mapping.identity().fields) == set(ingest.KINDS)
    fields = data["fields"]
    for bad in ({}, {"fields": {}}, {"fields": {"colour": "x"}}, data | {"more": 1}, data | {"timezone": "Mars/Base"}, data | {"drop": ["who"]}, {"fields": fields | {"score": {"source": "x", "format": "iso"}}}, {"fields": fields | {"score": {"source": "x", "hash": {"salt": "s"}}}}, {"fields": {"learner_id": {"default": 1}}}):
        with pytest.raises(ValueError):
            ingest.Mapping.from_dict(bad)


CELLS = "__row bigint, id string, who double, at string, what string, kind string, grade string, ok string, ms string"


def raw(spark):
    rows = [
        (1, "a", 7.0, "2026-01-05T10:00:00", "p", "view", " 1.5 ", "Yes", "12"), (2, "b", 7.0, "2026-01-05T09:00:00+02:00", "p", "view", "nan", "F", "3.0"), (3, "a", 8.5, "2026-01-05", "p", "view", None, None, None),
        (4, "c", 8.0, "soon", "p", "view", "-inf", "perhaps", "1.5"), (5, "d", None, "2026-01-05T10:00:00Z", " ", "view", "1_0", "1", "-4"), (6, None, 9.0, "2026-07-05T10:00:00", "p", "view", "1e2", "0", "9"),
    ]
    return spark.createDataFrame(rows, CELLS)


MAPPING = {"fields": {"event_id": "id", "learner_id": "who", "timestamp": "at", "activity_id": "what", "event_type": "kind", "score": "grade", "success": "ok", "duration_ms": "ms"}, "timezone": "Europe/Paris"}


def test_cells_are_read_and_reported(spark):
    mapping = ingest.Mapping.from_dict(MAPPING)
    for zone in ("UTC", "America/New_York"):  # the session's zone plays no part
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            events, report = ingest.ingest(raw(spark), mapping)
            got = {r["event_id"]: r for r in events.withColumn("us", F.unix_micros("timestamp")).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        hour = lambda *t: int(datetime(*t, tzinfo=UTC).timestamp()) * 1_000_000
        assert {k: r["us"] for k, r in got.items()} == {"a": hour(2026, 1, 5, 9), "b": hour(2026, 1, 5, 7), "row-6": hour(2026, 7, 5, 8)}
    assert [(r["learner_id"], r["score"], r["success"], r["duration_ms"]) for _, r in sorted(got.items())] == [("7", 1.5, True, 12), ("7", None, False, 3), ("9", 100.0, False, 9)]
    counts = {r["reason"]: r["n"] for r in report.collect()}
    assert counts == {"rows_read": 6, "rows_kept": 3, "duplicate_event_id": 1, "out_of_order": 1, "naive_timezone": 2, "timestamp:invalid_timestamp": 1, "score:not_finite": 1, "success:invalid_boolean": 1, "duration_ms:invalid_bigint": 1, "learner_id:missing_required": 1, "activity_id:missing_required": 1, "score:invalid_double": 1, "duration_ms:negative": 1}
    full = ingest.quality_report(raw(spark).withColumn("more", F.lit(1)), mapping, "x.csv")
    assert full["status"] == "ready" and full["summary"] == {"rows_read": 6, "rows_kept": 3, "rows_dropped": 3} and full["unmapped_columns"] == ["more"]
    assert full["field_coverage"]["score"] == pytest.approx(2 / 3) and full["field_coverage"]["event_id"] == 1.0
    assert full["row_issues"]["samples"][0] == {"row": 4, "field": "duration_ms", "code": "invalid_bigint"} and full["row_issues"]["counts"]["missing_required"] == 2
    assert len(full["warnings"]) == 4 and ingest.quality_report(raw(spark).limit(0), mapping)["errors"] == ["the source has no rows"]
    assert ingest.quality_report(raw(spark).filter("__row = 4"), mapping)["status"] == "failed"
    with pytest.raises(Exception, match="repeats an earlier"):
        ingest.ingest(raw(spark), mapping, on_duplicate="error")[0].collect()
    with pytest.raises(ValueError, match="lacks"):
        ingest.ingest(raw(spark).drop("what"), mapping)
    naive = ingest.ingest(raw(spark), ingest.Mapping.from_dict({"fields": MAPPING["fields"]}))[1]
    assert {r["reason"]: r["n"] for r in naive.collect()}["timestamp:naive_timestamp"] == 3
    truth = ingest.ingest(raw(spark).withColumn("what", F.lit(True)), mapping)[1]
    assert {r["reason"]: r["n"] for r in truth.collect()}["activity_id:invalid_string"] == 6


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet"])
def test_corpora_come_back(spark, tmp_path, kind):
    rows = [("e1", "u", datetime(2026, 1, 5, 10, 0, 0, 5, tzinfo=UTC), "s", "a,\"b\"", "view", None, 0.1, True, 5, {"z": "1", "a": "2"}), ("e2", "u", datetime(2026, 1, 5, 11, tzinfo=UTC), "s", "a", "view", "c", None, None, None, {})]
    events = spark.createDataFrame(rows, log.EVENTS)
    sessions = sessionize.sessions(events)
    truth = A.rows(sessions.select(F.col("session_id").alias("id")), "session", "anomaly", "burst", category="unusual_valid", parameters=F.lit('{"n":"1, 2"}'))
    path = f"{tmp_path}/c"
    report = {"status": "ready", "errors": []}
    files.write_corpus(events, path, sessions, {"name": "x"}, kind=kind, report=report, mapping=MAPPING, annotations=truth)
    back, held, metadata = files.read_corpus(spark, path)
    assert sorted(map(str, back.select(*log.EVENTS.names).collect())) == sorted(map(str, events.collect())) and metadata == {"name": "x"}
    assert held.first()["event_sequence"] == ["view", "view"] and held.first()["duration_s"] == sessions.first()["duration_s"]
    assert files.read_annotations(spark, path).collect() == truth.collect()
    assert json.loads((tmp_path / "c" / "mapping.used.json").read_text()) == MAPPING
    with pytest.raises(ValueError, match="exists"):
        files.write_corpus(events, path, kind=kind)
    files.write_corpus(events.limit(1), path, kind=kind, force=True)
    assert files.read_corpus(spark, path)[1] is None
    with pytest.raises(ValueError, match="no annotations"):
        files.read_annotations(spark, path)
    with pytest.raises(ValueError, match="failed report"):
        files.write_corpus(events, f"{tmp_path}/d", report={"status": "failed", "errors": ["x"]})
    assert not (tmp_path / "d").exists()


def test_small_files_of_people(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert files.read_groups(spark, write("g.csv", "learner_id,group\nu,x\n")).collect() == [("u", "x")]
    assert files.read_assignments(spark, write("a.csv", "learner_id,profile\nu,x\nu,x\n,y\nv,\n")).collect() == [("u", "x")]
    with pytest.raises(ValueError, match="two profiles"):
        files.read_assignments(spark, write("b.csv", "learner_id,profile\nu,x\nu,y\n"))
    with pytest.raises(ValueError, match="lacks group"):
        files.read_groups(spark, write("h.csv", "learner_id,label\nu,x\n"))
    assert files.read_predictions(spark, write("p.csv", "id,score\n1,0.5\n")).collect() == [("1", 0.5)]
    assert files.read_predictions(spark, write("q.csv", "id,flag\n1,Yes\n2,no\n")).collect() == [("1",)]
    assert files.read_predictions(spark, write("r.csv", "id\n1\n")).collect() == [("1",)]
    with pytest.raises(FileNotFoundError):
        files.read_groups(spark, f"{tmp_path}/none.csv")


def test_converters_and_chunks(spark):
    clicks = spark.createDataFrame([("u", 1, "quiz", 2), ("u", 1, "forum", 1), ("u", 1, "forum", 1), ("u", 2, "page", 5), ("v", 1, "quiz", 1)], "who string, day int, kind string, n int")
    assert {tuple(r) for r in files.daily_dominant(clicks, "who", "day", kind="kind", weight="n").collect()} == {("u", 1, "forum", 4), ("u", 2, "page", 5), ("v", 1, "quiz", 1)}
    assert [len(c) for c in files.chunked(clicks, 2)] == [2, 2, 1]
    with pytest.raises(ValueError):
        list(files.chunked(clicks, 0))
    events = spark.range(100).select(F.format_string("u%d", F.col("id") % 10).alias("learner_id"), "id")
    some = files.sample_learners(events, 3, 1)
    assert some.count() == 30 and sorted(map(tuple, some.collect())) == sorted(map(tuple, files.sample_learners(events.repartition(7), 3, 1).collect()))
