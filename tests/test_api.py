"""Settings and the façade."""

import json

import pytest

from tidemark import api, benchmark, cli, config, reports
from tidemark.sources import files
from tidemark.sources import ingest as I


def test_precedence_and_types(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[generation]\nseed = 1\nn_sessions = 7\n[sessionization]\nidle_timeout_s = 60\n[validation.thresholds]\nbigram_tvd = 1\n')
    got = config.load(str(path), {"generation.n_sessions": 9}, {"TIDEMARK_SEED": "5", "TIDEMARK_OTHER": "x"})
    assert [got[k] for k in ("generation.seed", "generation.n_sessions", "sessionization.idle_timeout_s", "validation.thresholds")] == [5, 9, 60.0, {"bigram_tvd": 1.0}]
    assert dict(config.load(environ={})) == dict(config.Settings())
    assert config.load(overrides={"generator.order": 3}, environ={}).generator() == {"order": 3} and len(config.Settings().sections()) == 11
    for bad in ({"io.colour": 1}, {"nothing.x": 1}, {"generation.n_sessions": True}, {"generation.n_sessions": "9"}, {"logging.level": "LOUD"}, {"sessionization.idle_timeout_s": 0}, {"benchmark.generators": []}, {"io.strict": 1}, {"validation.thresholds": {"a": "b"}}):
        with pytest.raises(ValueError):
            config.load(overrides=bad, environ={})


def test_whole_way(spark, tmp_path):
    rows = [f"u{u},2026-03-02 {9 + s:02d}:{m:02d}:00,quiz,{t}" for u in range(6) for s in (0, 3) for m, t in ((0, "view"), (5, "attempt"), (9, "submit"))]
    source = tmp_path / "log.csv"
    source.write_text("who,at,what,type\n" + "\n".join(rows) + "\nu1,soon,quiz,view\n")
    mapping = I.Mapping({"learner_id": I.Spec("who"), "timestamp": I.Spec("at", format="%Y-%m-%d %H:%M:%S", timezone="UTC"), "activity_id": I.Spec("what"), "event_type": I.Spec("type")})
    settings = config.load(overrides={"generation.n_sessions": 12, "validation.thresholds": {"bigram_tvd": 0.1}}, environ={})
    with pytest.raises(ValueError):
        api.ingest(spark, str(source), mapping, settings, strict=True)
    events, report = api.ingest(spark, str(source), mapping, settings)
    assert {r["reason"]: r["n"] for r in report.collect()}["rows_kept"] == 36
    seq = api.sessionize(events, settings)
    tables = api.analyze(seq, settings)
    assert {(r["ngram"], r["n"]) for r in tables["ngrams"].collect()} == {("view > attempt", 12), ("attempt > submit", 12)}
    sample = api.generate(api.fit_generator(seq, settings), settings)
    assert sample.count() == 36 and sample.select("session_id").distinct().count() == 12
    with pytest.raises(ValueError):
        api.analyze(seq.limit(0))
    with pytest.raises(ValueError):
        api.validate(seq, seq, metrics=["charm"])
    report = api.validate(seq, seq, settings, metrics=["bigram_tvd", "event_type_tvd"])
    assert {(r["metric"], r["status"]) for r in report.collect()} == {("bigram_tvd", "pass"), ("event_type_tvd", "info")}


def test_commands_work_one_after_another(spark, tmp_path, capsys):
    run = lambda *argv: cli.main(["--set", "io.output_format=\"parquet\"", *argv])
    at = lambda name: str(tmp_path / name)
    assert run("demo", "--output", at("demo"), "--learners", "12") == 0
    assert run("sessionize", "--input", at("demo"), "--output", at("cut")) == 0
    assert run("analyze", "--input", at("cut"), "--by", "weekday", "--output", at("analysis")) == 0
    assert "| label |" in (tmp_path / "analysis" / "analysis.md").read_text()
    assert run("fit", "--input", at("cut"), "--output", at("model"), "--generator", "semi_markov") == 0
    (tmp_path / "e.json").write_text('{"controls": {"session_length": {"fixed": 4}}, "anomalies": [{"type": "inactivity", "rate": 0.5}]}')
    assert run("generate", "--model", at("model"), "--output", at("made"), "--n-sessions", "20", "--experiment", at("e.json")) == 0
    truth = files.read_annotations(spark, at("made"))
    (tmp_path / "p.csv").write_text("id\n" + "".join(f"{r['id']}\n" for r in truth.filter("level = 'session'").collect()))
    assert run("evaluate", "--corpus", at("made"), "--predictions", at("p.csv"), "--output", at("evaluation")) == 0
    assert json.loads((tmp_path / "evaluation" / "evaluation.json").read_text())["scores"][0]["f1"] == 1.0
    (tmp_path / "t.json").write_text('{"bigram_tvd": 0.0}')
    assert run("validate", "--real", at("cut"), "--synthetic", at("made"), "--metrics", "bigram_tvd,event_type_tvd", "--thresholds", at("t.json"), "--detailed", "--by", "course", "--output", at("validation")) == 1
    report = json.loads((tmp_path / "validation" / "report.json").read_text())
    assert report["status"] == "fail" and reports.metric(report, "bigram_tvd")["bound"] == 0.0
    assert run("plot", "--validation", at("validation/report.json"), "--real", at("cut"), "--output", at("plots")) == 0
    assert "bigram_tvd" in (tmp_path / "plots" / "validation.txt").read_text() and "####" in (tmp_path / "plots" / "validation.txt").read_text()
    made = json.loads((tmp_path / "made.run_manifest.json").read_text())
    assert made["exit_status"] == 0 and made["places"]["model"] == at("model")
    capsys.readouterr()
    assert run("info", "--input", at("cut")) == 0 and "semi_markov" in capsys.readouterr().out
    assert run("plugins") == 0 and run("nothing") == 2 and run("fit", "--input", at("none"), "--output", at("x")) == 2 and run("--set", "a=1", "info") == 2
    (tmp_path / "log.csv").write_text("who,at,what,type\nu,2026-03-02T09:00:00Z,quiz,view\nu,soon,quiz,view\n")
    (tmp_path / "m.json").write_text('{"fields": {"learner_id": "who", "timestamp": "at", "activity_id": "what", "event_type": "type"}}')
    assert run("ingest", "--input", at("log.csv"), "--mapping", at("m.json"), "--output", at("corpus")) == 0
    assert json.loads((tmp_path / "corpus" / "quality_report.json").read_text())["summary"]["rows_dropped"] == 1
    assert files.read_corpus(spark, at("corpus"))[0].first()["event_id"] == "row-1"
    assert run("ingest", "--input", at("log.csv"), "--mapping", at("m.json"), "--output", at("other"), "--strict") == 2


def test_benchmarks_follow_a_protocol(spark):
    seq = api.sessionize(api.demo_dataset(spark, 20, 1))
    benchmark.register_protocol(benchmark.Protocol("short", 0.5, 2, 10, ("bigram_tvd", "event_type_tvd")))
    try:
        errors = {}
        found = reports.rows(benchmark.run_protocol(seq, "short", ("markov", "none"), errors=errors))
        assert {(r["generator"], r["metric"], r["n"]) for r in found} == {(g, m, n) for g, n in (("reference", 1), ("markov", 2)) for m in ("bigram_tvd", "event_type_tvd")} and list(errors) == ["none"]
        assert reports.best(found, "bigram_tvd") == "markov" and "markov" in reports.dashboard({"rows": found})
        for bad in (benchmark.Protocol("short"), benchmark.Protocol("session_fidelity_v1"), benchmark.Protocol("x", 1.0), benchmark.Protocol("y", metrics=("charm",)), "z"):
            with pytest.raises(ValueError):
                benchmark.register_protocol(bad)
    finally:
        benchmark.unregister_protocol("short")
    with pytest.raises(ValueError):
        benchmark.run_protocol(seq, "short", ("markov",))


def test_texts_of_reports():
    assert reports.markdown("T", {"A": [{"x": None, "y": True, "z": [1.23456, "a|b"]}], "B": []}, ["note"]).splitlines()[4:7] == ["| x | y | z |", "| --- | --- | --- |", "| - | true | 1.235, a\\|b |"]
    assert reports.plain({"a": float("nan"), "b": (1, 2)}) == {"a": None, "b": [1, 2]}
    with pytest.raises(ValueError):
        reports.save_figure([], "x.gif", "a", "b")
    with pytest.raises((RuntimeError, OSError)):
        reports.save_figure([{"a": 1, "b": 2}], "/nowhere/x.png", "a", "b")
