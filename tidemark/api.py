"""The façade: whole steps under one set of settings; an argument goes before its setting."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import benchmark, config, demo, log, models, plugins, reports
from tidemark.config import Settings
from tidemark.operators import assemble, compare, injection, manipulation, profile, profiles, sequences, validation
from tidemark.operators import calendar as calendars
from tidemark.operators import controls as control_specs
from tidemark.operators import generate as G
from tidemark.operators import sessionize as S
from tidemark.sources import files
from tidemark.sources import ingest as I

load_config = config.load
load_dataset, save_dataset, load_annotations = files.read_corpus, files.write_corpus, files.read_annotations
activity_profiles, analyze_by, temporal_profile, deadline_effects = sequences.activity_profiles, profile.analyze_by, profile.temporal_profile, profile.deadline_effects
evaluate_detection, evaluate_clustering, compare_detailed = validation.evaluate, validation.clustering, compare.compare
save_model, load_model, describe_model = models.save, models.load, models.describe
apply_controls, run_experiment, inject_anomalies, manipulation_check = control_specs.apply, assemble.experiment, injection.inject, manipulation.check_controls
fit_profiles, define_profiles, save_profiles, load_profiles = profiles.fit_profiles, profiles.define_profiles, profiles.save_profiles, profiles.load_profiles
demo_dataset, register_plugin, discover_plugins, opening_hours = demo.demo_log, plugins.register, plugins.discover, calendars.opening

__all__ = [
    "activity_profiles", "analyze", "analyze_by", "apply_controls", "compare_detailed", "deadline_effects", "define_profiles", "demo_dataset", "describe_model", "discover_plugins", "evaluate_clustering", "evaluate_detection", "fit_generator", "fit_profiles", "generate",
    "ingest", "inject_anomalies", "load_annotations", "load_config", "load_dataset", "load_model", "load_profiles", "manipulation_check", "opening_hours", "register_plugin", "run_benchmark", "run_experiment", "save_dataset", "save_model", "save_profiles", "sessionize", "temporal_profile", "validate",
]


def read_raw(spark: SparkSession, source: str, settings: Settings = Settings()) -> DataFrame:
    """A source's rows with their number, in order of files and lines."""
    return I.numbered(files.read_source(spark, source, None if settings["io.format"] == "auto" else settings["io.format"]))


def ingest(spark: SparkSession, source: str, mapping: I.Mapping, settings: Settings = Settings(), *, strict: bool | None = None, on_duplicate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted events and the report of a file; ``strict`` makes any dropped row an error."""
    raw = read_raw(spark, source, settings)
    events, report = I.ingest(raw, mapping, on_duplicate=on_duplicate or settings["io.on_duplicate"])
    if settings["io.strict"] if strict is None else strict:
        n = {r["reason"]: r["n"] for r in report.filter(F.col("reason").isin("rows_read", "rows_kept")).collect()}
        if n.get("rows_read", 0) != n.get("rows_kept", 0):
            raise ValueError(f"{n.get('rows_read', 0) - n.get('rows_kept', 0)} rows were dropped")
    events = I.normalize_types(events, log.KNOWN_TYPES + settings["io.event_types"], settings["io.unknown_event_policy"])
    return (I.strip_metadata(events, *settings["privacy.strip_metadata_keys"]) if settings["privacy.strip_metadata_keys"] else events), report


def sessionize(events: DataFrame, settings: Settings = Settings(), *, strategy: str | None = None, idle_timeout_s: float | None = None, tokenization: str | None = None) -> DataFrame:
    """Session events with tokens, the input of everything below."""
    timeout = settings["sessionization.idle_timeout_s"] if idle_timeout_s is None else idle_timeout_s
    cut = S.sessionize(events, strategy=strategy or settings["sessionization.strategy"], idle_timeout_s=timeout)
    return sequences.tokens(cut, tokenization or settings["sessionization.tokenization"])


def analyze(seq: DataFrame, settings: Settings = Settings(), *, ngram_order: int | None = None) -> dict[str, DataFrame]:
    """The descriptive tables, all lazy; a log without sessions is an error."""
    if seq.limit(1).count() == 0:
        raise ValueError("the log has no sessions; sessionize it first")
    sessions, graph, counts = S.sessions(seq), sequences.edges(seq), sequences.transitions(seq)
    return {
        "types": seq.groupBy("event_type").agg(F.count("*").alias("n")), "tokens": seq.groupBy("token").agg(F.count("*").alias("n")), "corpus": profile.corpus_features(seq, counts),
        "lengths": profile.describe(sessions, "n_events"), "durations": profile.describe(sessions, "duration_s"), "interevent": profile.describe(profile.gaps(seq), "gap_s"), "sojourn": profile.describe(profile.gaps(seq), "gap_s", "token"),
        "ngrams": sequences.ngrams(seq, ngram_order or settings["analysis.ngram_order"]), "transitions": counts, "density": sequences.density(counts), "entropy": profile.entropy(seq, "token"),
        "edges": sequences.top_edges(graph), "self_loops": sequences.self_loop_share(graph), "learners": profile.learner_profiles(seq, sessions), "sessions": profile.session_features(seq), "activities": sequences.activity_profiles(seq),
    }


def fit_generator(seq: DataFrame, settings: Settings = Settings(), *, name: str | None = None, order: int | None = None, **given: Any) -> G.Model:
    """A model by the generator's name and settings; without an order of its own it falls back where sessions are short."""
    chosen = name or settings["generator.name"]
    known = G.HYPERPARAMETERS.get(chosen, {})
    own = {k: v for k, v in settings.generator().items() if k in known} | given
    if order is not None:
        own["order"] = order
    elif "order" in known and "on_insufficient_data" not in own:
        own["on_insufficient_data"] = "backoff"
    return G.fit_named(chosen, seq, own).with_settings(tokenization=settings["sessionization.tokenization"])


def generate(model: G.Model, settings: Settings = Settings(), *, n_sessions: int | None = None, seed: int | None = None, calendar: calendars.Timetable | None = None) -> DataFrame:
    """A canonical log with tokens."""
    drawn = (settings["generation.seed"] or 0) if seed is None else seed
    return assemble.log_of(model, n_sessions or settings["generation.n_sessions"], drawn, calendar=calendar, new_ids=settings["generation.id_strategy"] == "remap")


def validate(real: DataFrame, synthetic: DataFrame, settings: Settings = Settings(), *, metrics: list[str] | None = None) -> DataFrame:
    """(metric, value, bound, status): 'skip' without a value, 'info' without a bound."""
    wanted = metrics or list(settings["validation.metrics"]) or None
    limits = settings["validation.thresholds"]
    if unknown := sorted((set(wanted or ()) | set(limits)) - set(validation.METRICS)):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    bounds = F.create_map(*(F.lit(x) for p in limits.items() for x in p)) if limits else F.create_map().cast("map<string,double>")
    made = validation.validate(real, synthetic, wanted).withColumn("bound", F.try_element_at(bounds, F.col("metric")))
    good = F.when(F.col("metric").isin(*reports.HIGHER), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return made.withColumn("status", F.when(F.col("value").isNull(), "skip").when(F.col("bound").isNull(), "info").when(good, "pass").otherwise("fail"))


def run_benchmark(seq: DataFrame, settings: Settings = Settings(), *, n_sessions: int | None = None, seed: int | None = None, errors: dict[str, str] | None = None) -> DataFrame:
    return benchmark.run_protocol(seq, settings["benchmark.protocol"], settings["benchmark.generators"], (settings["generation.seed"] or 0) if seed is None else seed, errors, repeats=settings["benchmark.repeats"], n_sessions=n_sessions)
