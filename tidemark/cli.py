"""python -m tidemark.cli COMMAND: the steps of the façade on files; 0 is good, 1 a failed check, 2 an error."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import platform
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api, config, log, models, plugins, reports
from tidemark.operators import profile, sequences, sessionize
from tidemark.plans import queries
from tidemark.sources import files
from tidemark.sources import ingest as I

OK, FAILED, ERROR = 0, 1, 2
Step = Callable[[SparkSession, argparse.Namespace, config.Settings], tuple[int, dict[str, str]]]
#: Steps by name, with their arguments: a required one has no default.
STEPS: dict[str, tuple[Step, dict[str, dict[str, Any]]]] = {}


def step(command: str, /, **arguments: dict[str, Any]):
    def keep(work: Step) -> Step:
        STEPS[command] = (work, arguments)
        return work

    return keep


NEEDED, OPTIONAL = {"required": True}, {"default": None}


def _seq(spark: SparkSession, path: str, settings: config.Settings) -> DataFrame:
    events, _, _ = files.read_corpus(spark, path)
    return sequences.tokens(events, settings["sessionization.tokenization"])


def _put(spark: SparkSession, folder: str | None, texts: dict[str, str]) -> dict[str, str]:
    """Texts into files of a folder, or the readable one to the screen."""
    if folder is None:
        print(next(t for name, t in texts.items() if name.endswith(".md")))
        return {}
    for name, body in texts.items():
        models.write_text(spark, f"{folder}/{name}", body)
    return {"output": folder}


def _json(data: Any) -> str:
    return json.dumps(reports.plain(data), indent=2, sort_keys=True) + "\n"


@step("ingest", input=OPTIONAL, mapping=OPTIONAL, output=OPTIONAL, output_format=OPTIONAL, strict={"action": "store_true"})
def _(spark, a, s):
    source, mapped, out = a.input or s["io.input"], a.mapping or s["io.mapping"], a.output or s["io.output"]
    if not (source and mapped and out):
        raise ValueError("ingest needs an input, a mapping and an output")
    mapping = I.Mapping.from_file(mapped)
    report = I.quality_report(api.read_raw(spark, source, s), mapping, source.rsplit("/", 1)[-1])
    if report["status"] == "failed":
        print(_json(report))
        return FAILED, {"input": source}
    events, _ = api.ingest(spark, source, mapping, s, strict=a.strict or None)
    files.write_corpus(events, out, kind=a.output_format or s["io.output_format"], report=report, mapping=mapping.to_dict())
    print(f"{report['summary']['rows_kept']} of {report['summary']['rows_read']} rows kept")
    return OK, {"input": source, "mapping": mapped, "output": out}


@step("sessionize", input=NEEDED, output=NEEDED, strategy={"default": None, "choices": ["explicit", "idle_timeout", "composite"]}, idle_timeout={"default": None, "type": float}, tokenization={"default": None, "choices": ["event_type", "activity_id"]})
def _(spark, a, s):
    events, _, metadata = files.read_corpus(spark, a.input)
    made = api.sessionize(events, s, strategy=a.strategy, idle_timeout_s=a.idle_timeout, tokenization=a.tokenization)
    held = sessionize.sessions(made, a.tokenization or s["sessionization.tokenization"])
    if broken := {k: n for k, n in log.check(made, held).items() if n}:
        print("integrity:", broken)
        return FAILED, {"input": a.input}
    files.write_corpus(made, a.output, held, metadata, kind=files.read_manifest(spark, a.input).get("format", "parquet"))
    return OK, {"input": a.input, "output": a.output}


@step("analyze", input=NEEDED, output=OPTIONAL, ngram_order={"default": None, "type": int}, by=OPTIONAL, groups=OPTIONAL, timezone={"default": "UTC"}, min_sessions={"default": 1, "type": int})
def _(spark, a, s):
    profile.resolve_zone(a.timezone)
    seq = _seq(spark, a.input, s)
    tables = api.analyze(seq, s, ngram_order=a.ngram_order)
    if a.by:
        groups = files.read_groups(spark, a.groups) if a.groups else None
        labelled = profile.session_label(sessionize.sessions(seq), a.by, a.timezone, groups)
        tables |= {f"by_{a.by}": api.analyze_by(labelled, a.min_sessions), "omitted": profile.omitted(labelled, a.min_sessions)}
    found = reports.collected({k: t for k, t in tables.items() if k not in ("learners", "sessions")}, 50)
    return OK, {"input": a.input} | _put(spark, a.output, {"analysis.md": reports.markdown("Analysis", found), "analysis.json": _json(found)})


@step("fit", input=NEEDED, output=NEEDED, generator=OPTIONAL)
def _(spark, a, s):
    seq = _seq(spark, a.input, s)
    models.save(api.fit_generator(seq, s, name=a.generator), a.output, training=seq)
    return OK, {"input": a.input, "output": a.output}


@step("generate", model=NEEDED, output=NEEDED, n_sessions={"default": None, "type": int}, format=OPTIONAL, experiment=OPTIONAL)
def _(spark, a, s):
    model = models.load(spark, a.model)
    n, seed, code, truth = a.n_sessions or s["generation.n_sessions"], s["generation.seed"] or 0, OK, None
    if a.experiment:
        made = api.run_experiment(model, config.read_file(a.experiment), n, seed)
        events, truth = made["events"], made["annotations"]
        if made["check"] is not None:
            found = reports.rows(made["check"])
            code = FAILED if any(r["status"] == "failed" for r in found) else OK
            print("\n".join(reports.table(found)))
    else:
        events = api.generate(model, s, n_sessions=n)
    files.write_corpus(events, a.output, sessionize.sessions(events, s["sessionization.tokenization"]), {"model": a.model, "seed": seed}, kind=a.format or s["io.output_format"], annotations=truth)
    return code, {"model": a.model, "output": a.output}


@step("evaluate", corpus=NEEDED, predictions=NEEDED, level={"default": "session", "choices": ["learner", "session", "event"]}, threshold={"default": 0.5, "type": float}, output=OPTIONAL)
def _(spark, a, s):
    events, _, _ = files.read_corpus(spark, a.corpus)
    found = reports.collected(api.evaluate_detection(events, files.read_annotations(spark, a.corpus), files.read_predictions(spark, a.predictions), level=a.level, threshold=a.threshold))
    return OK, {"corpus": a.corpus} | _put(spark, a.output, {"evaluation.md": reports.markdown("Detection", found), "evaluation.json": _json(found)})


@step("validate", real=NEEDED, synthetic=NEEDED, metrics=OPTIONAL, thresholds=OPTIONAL, detailed={"action": "store_true"}, by=OPTIONAL, groups=OPTIONAL, timezone={"default": "UTC"}, output=OPTIONAL)
def _(spark, a, s):
    real, synthetic = _seq(spark, a.real, s), _seq(spark, a.synthetic, s)
    own = config.Settings(dict(s) | ({"validation.thresholds": config.read_file(a.thresholds)} if a.thresholds else {}))
    found = api.validate(real, synthetic, own, metrics=a.metrics.split(",") if a.metrics else None)
    report = reports.validation(found, real, synthetic, {"real": a.real, "synthetic": a.synthetic})
    texts = {"report.md": reports.validation_markdown(report), "report.json": _json(report)}
    if a.detailed:
        both = [x.withColumn("side", F.lit(side)) for side, x in (("a", real), ("b", synthetic))]
        if a.by:
            groups = files.read_groups(spark, a.groups) if a.groups else None
            both = [x.join(profile.session_label(sessionize.sessions(x), a.by, a.timezone, groups).select("session_id", "label"), "session_id") for x in both]
        part = reports.collected(api.compare_detailed(both[0].unionByName(both[1]), by=bool(a.by), zone=a.timezone))
        texts |= {"detailed.md": reports.markdown("Comparison", part), "detailed.json": _json(part)}
    return (OK if report["status"] == "pass" else FAILED), {"real": a.real, "synthetic": a.synthetic} | _put(spark, a.output, texts)


@step("benchmark", input=NEEDED, generators=OPTIONAL, protocol=OPTIONAL, seeds={"default": None, "type": int}, n_sessions={"default": None, "type": int}, output=OPTIONAL)
def _(spark, a, s):
    given = {"benchmark.generators": a.generators.split(",") if a.generators else None, "benchmark.protocol": a.protocol, "benchmark.repeats": a.seeds}
    own, errors = config.Settings(dict(s) | {k: v for k, v in given.items() if v is not None}), {}
    found = reports.rows(api.run_benchmark(_seq(spark, a.input, s), own, n_sessions=a.n_sessions, errors=errors))
    data = {"rows": found, "errors": errors, "best": {m: reports.best(found, m) for m in sorted({r["metric"] for r in found})}}
    return (FAILED if errors else OK), {"input": a.input} | _put(spark, a.output, {"benchmark.md": reports.markdown("Benchmark", {"Generators": found}), "benchmark.json": _json(data)})


@step("demo", output=NEEDED, learners={"default": 60, "type": int})
def _(spark, a, s):
    files.write_corpus(api.demo_dataset(spark, a.learners, s["generation.seed"] or 0), a.output, metadata={"source": "demo"}, kind=s["io.output_format"])
    return OK, {"output": a.output}


@step("plot", real=OPTIONAL, synthetic=OPTIONAL, validation=OPTIONAL, benchmark=OPTIONAL, output=NEEDED)
def _(spark, a, s):
    """The data of plots as tables, and dashboards as bars of text."""
    texts = {f"{kind}.txt": reports.dashboard(json.loads(models.read_text(spark, path))) for kind, path in (("validation", a.validation), ("benchmark", a.benchmark)) if path}
    for side, path in (("real", a.real), ("synthetic", a.synthetic)):
        if path:
            seq = _seq(spark, path, s)
            tables = {"types": profile.top_shares(seq, "event_type"), "activities": profile.top_shares(seq, "activity_id"), "gaps": profile.log_histogram(profile.gaps(seq), "gap_s"), "transitions": sequences.transition_matrix(seq), "flows": sequences.sankey(seq), "heat_map": profile.heat_map(seq)}
            tables |= {name: make(seq, None) for name, make in reports.PLOTS.items()}
            texts[f"{side}.json"] = _json(reports.collected(tables))
    if not texts:
        raise ValueError("plot needs a corpus, a validation report or a benchmark")
    texts["plots.md"] = "\n".join(sorted(texts)) + "\n"
    return OK, _put(spark, a.output, texts)


@step("info", input=OPTIONAL)
def _(spark, a, s):
    for kind, names in (("query", sorted(queries.QUERIES)), *((k, plugins.available(k)) for k in ("generator", "metric", "benchmark_suite", "anomaly")), ("reader", files.available_readers())):
        print(kind, *names)
    if a.input:
        events, held, metadata = files.read_corpus(spark, a.input)
        print(_json({"events": events.count(), "sessions": held.count() if held is not None else None, "metadata": metadata}))
    return OK, {}


@step("plugins")
def _(spark, a, s):
    broken = plugins.discover()
    print(_json({"broken": broken} | {k: plugins.available(k) for k in ("generator", "metric", "reader", "visualizer", "benchmark_suite", "anomaly")}))
    return (FAILED if broken else OK), {}


@step("query", name=NEEDED, tables=NEEDED, output=NEEDED)
def _(spark, a, s):
    queries.QUERIES[a.name](spark, a.tables).write.parquet(a.output)
    return OK, {"tables": a.tables, "output": a.output}


def manifest(argv: list[str], settings: config.Settings, began: datetime.datetime, places: dict[str, str], code: int) -> dict[str, Any]:
    """What ran, on what, and how it ended."""
    plain = reports.plain(settings.sections())
    return {
        "argv": argv, "started_at": began.isoformat(), "exit_status": code, "places": places, "python": platform.python_version(), "platform": platform.platform(),
        "config_fingerprint": hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest(), "config": plain, "generators": plugins.available("generator"),
    }


def main(argv: list[str] | None = None) -> int:
    given = list(sys.argv[1:] if argv is None else argv)
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--config", default=None)
    parser.add_argument("--set", action="append", default=[], metavar="section.name=JSON")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in STEPS.items():
        own = sub.add_parser(name)
        for key, options in arguments.items():
            own.add_argument(f"--{key.replace('_', '-')}", **options)
    try:
        a = parser.parse_args(given)
    except SystemExit as e:
        return OK if e.code == 0 else ERROR
    began = datetime.datetime.now(datetime.UTC)
    try:
        overrides = {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.set)}
        settings = config.load(a.config, overrides)
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        code, places = STEPS[a.command][0](spark, a, settings)
        if "output" in places and a.command != "query":
            models.write_json(spark, f"{places['output'].rstrip('/')}.run_manifest.json", manifest(given, settings, began, places, code))
    except Exception as e:  # every error has one way out
        print(f"error: {e}", file=sys.stderr)
        return ERROR
    return code


if __name__ == "__main__":
    raise SystemExit(main())
