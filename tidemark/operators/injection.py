"""Anomalies put into sessions, with their ground truth.

Sessions are taken in a seeded order; each request takes the next ones until its
share is reached, and those it can't use are passed over for good, so a session
has one anomaly at most.  Every draw is a hash of seed, label and session.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.randomness import derive_seed, uniform
from tidemark.functions.ranking import cumulate, quantiles, seeded_rank
from tidemark.functions.scratch import stored
from tidemark.operators import annotations as A
from tidemark.operators.generate import push_later
from tidemark.operators.sequences import in_session

#: Tokens of a vocabulary that draws may choose from.
MOST_TOKENS = 2_000
CANONICAL = ("event_id", "learner_id", "timestamp", "session_id", "activity_id", "event_type", "course_id", "score", "success", "duration_ms", "metadata")


class Context(NamedTuple):
    """What is normal: token field, vocabulary, pairs never seen, median gap, and each token's companions (token, others)."""

    field: str
    vocabulary: list[str]
    unseen: list[tuple[str, str]]
    gap_s: float
    companions: DataFrame


class Kind(NamedTuple):
    """An injector: what it needs of a session (n_events, n_tokens), and what it makes of the events of chosen ones.

    ``rewrite(rows, params, context, seed)`` gets events with ``n_events`` and
    ``own`` (the session's distinct tokens, sorted) and returns them with
    ``__us`` and ``__affected``, new ones among them.
    """

    category: str
    defaults: Mapping[str, Any]
    check: Callable[[dict[str, Any]], bool]
    fits: Callable[[dict[str, Any], Context], Column]
    rewrite: Callable[[DataFrame, dict[str, Any], Context, int], DataFrame]


def _us() -> Column:
    return F.unix_micros("timestamp")


def _choice(values: Column, u: Column) -> Column:
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def _listed(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _inserted(rows: DataFrame, tokens: Column, gap_us: int, context: Context, seed: int) -> DataFrame:
    """``rows`` with ``tokens`` after a drawn event, ``gap_us`` apart; what follows moves by all of them."""
    w, session = in_session(rows), F.col("session_id")
    marked = rows.withColumn("__nth", F.row_number().over(w)).withColumn("__at", F.floor(uniform(seed, "position", session) * F.col("n_events")) + 1).withColumn("__new", tokens)
    later = F.when(F.col("__nth") > F.col("__at"), F.size("__new") * F.lit(gap_us)).otherwise(F.lit(0))
    kept = marked.withColumn("__us", _us() + later).withColumn("__affected", F.lit(False))
    other = "activity_id" if context.field == "event_type" else "event_type"
    fresh = marked.filter("__nth = __at").select("*", F.posexplode("__new").alias("__k", "__token")).join(context.companions.withColumnRenamed("token", "__token"), "__token", "left")
    companion = F.coalesce(_choice(F.col("others"), uniform(seed, "companion", session, F.col("__k"))), F.col(other))
    made = {"event_id": F.concat(F.lit("new-"), session, F.lit("-"), F.format_string("%06d", F.col("__k"))), context.field: F.col("__token"), other: companion, "token": F.col("__token"), "score": F.lit(None).cast("double"), "success": F.lit(None).cast("boolean"), "duration_ms": F.lit(None).cast("bigint"), "__us": _us() + (F.col("__k") + 1) * F.lit(gap_us), "__affected": F.lit(True)}
    columns = [*rows.columns, "__us", "__affected"]
    return kept.select(*columns).unionByName(fresh.select(*(made.get(c, F.col(c)).alias(c) for c in columns)))


def _burst(rows: DataFrame, p: dict[str, Any], context: Context, seed: int) -> DataFrame:
    if p["token"] is not None and p["token"] not in context.vocabulary:
        raise ValueError(f"no session has the token {p['token']!r}")
    token = F.lit(p["token"]) if p["token"] is not None else _choice(_listed(context.vocabulary), uniform(seed, "token", F.col("session_id")))
    return _inserted(rows, F.array_repeat(token, p["count"]), round(p["window_s"] * 1e6 / p["count"]), context, seed)


def _pair(rows: DataFrame, p: dict[str, Any], context: Context, seed: int) -> DataFrame:
    pairs = sorted(tuple(x) for x in p["transitions"]) if p["transitions"] else context.unseen
    drawn = _choice(F.array(*(_listed(x) for x in pairs)), uniform(seed, "pair", F.col("session_id")))
    return _inserted(rows, drawn, round(max(context.gap_s, 1.0) * 1e6), context, seed)


def _repeats(rows: DataFrame, p: dict[str, Any], context: Context, seed: int) -> DataFrame:
    every, session = _listed(context.vocabulary), F.col("session_id")
    pool = F.col("own") if p["pattern"] == "loop" else F.when(F.size("own") >= 2, F.col("own")).otherwise(every)
    a = _choice(pool, uniform(seed, "first", session))
    if p["pattern"] == "loop":
        return _inserted(rows, F.array_repeat(a, p["length"]), round(p["gap_s"] * 1e6), context, seed)
    b = _choice(F.filter(pool, lambda x: x != a), uniform(seed, "second", session))
    tokens = F.transform(F.sequence(F.lit(1), F.lit(p["length"])), lambda i: F.when(i % 2 == 1, a).otherwise(b))
    return _inserted(rows, tokens, round(p["gap_s"] * 1e6), context, seed)


def _hurried(rows: DataFrame, p: dict[str, Any], context: Context, seed: int) -> DataFrame:
    w = in_session(rows)
    gap = F.greatest(((_us() - F.lag(_us()).over(w)) * p["factor"]).cast("bigint"), F.lit(1000))
    spaced = rows.withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn("__first", F.first(_us()).over(w)).withColumn("__affected", F.row_number().over(w) > 1)
    so_far = F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spaced.withColumn("__us", F.col("__first") + so_far).drop("__gap", "__first")


def _paused(rows: DataFrame, p: dict[str, Any], context: Context, seed: int) -> DataFrame:
    cut = F.floor(uniform(seed, "cut", F.col("session_id")) * (F.col("n_events") - 1)) + 2
    marked = rows.withColumn("__nth", F.row_number().over(in_session(rows))).withColumn("__cut", cut)
    later = F.when(F.col("__nth") >= F.col("__cut"), F.lit(round(p["gap_s"] * 1e6))).otherwise(F.lit(0))
    return marked.withColumn("__us", _us() + later).withColumn("__affected", F.col("__nth") == F.col("__cut")).drop("__nth", "__cut")


def _is(value: Any, kind: type | tuple, more_than: float) -> bool:
    return isinstance(value, kind) and not isinstance(value, bool) and value > more_than


def _pairs(value: Any) -> bool:
    return value is None or (isinstance(value, list | tuple) and bool(value) and all(isinstance(p, list | tuple) and len(p) == 2 and all(isinstance(t, str) for t in p) for p in value))


_ANY = lambda p, c: F.lit(True)
#: Names, categories and defaults that users' files rely on.
ANOMALIES: dict[str, Kind] = {
    "event_frequency": Kind("unusual_valid", {"token": None, "count": 20, "window_s": 180.0}, lambda p: _is(p["count"], int, 1) and _is(p["window_s"], (int, float), 0), _ANY, _burst),
    "abnormal_timing": Kind("unusual_valid", {"factor": 0.05, "min_events": 3}, lambda p: _is(p["factor"], (int, float), 0) and p["factor"] < 1 and _is(p["min_events"], int, 1), lambda p, c: F.col("n_events") >= p["min_events"], _hurried),
    "unexpected_transition": Kind("invalid_workflow", {"transitions": None}, lambda p: _pairs(p["transitions"]), lambda p, c: F.lit(bool(p["transitions"] or c.unseen)), _pair),
    "repetition": Kind("unusual_valid", {"pattern": "ping_pong", "length": 12, "gap_s": 5.0}, lambda p: p["pattern"] in ("loop", "ping_pong") and _is(p["length"], int, 2) and _is(p["gap_s"], (int, float), 0), lambda p, c: F.lit(p["pattern"] == "loop" or len(c.vocabulary) > 1), _repeats),
    "inactivity": Kind("unusual_valid", {"gap_s": 2400.0}, lambda p: _is(p["gap_s"], (int, float), 0), lambda p, c: F.col("n_events") >= 2, _paused),
}
BUILT_IN = frozenset(ANOMALIES)


def register_anomaly(name: str, kind: Kind, *, replace: bool = False) -> None:
    if not name.isidentifier() or not isinstance(kind, Kind) or kind.category not in A.CATEGORIES:
        raise ValueError("an anomaly is a Kind with a known category, under an identifier")
    if name in BUILT_IN or (name in ANOMALIES and not replace):
        raise ValueError(f"anomaly {name!r} exists")
    ANOMALIES[name] = kind


def unregister_anomaly(name: str) -> None:
    if name not in BUILT_IN:
        ANOMALIES.pop(name, None)


class Request(NamedTuple):
    """A share of the sessions that gets a kind of anomaly."""

    kind: str
    rate: float
    params: dict[str, Any]


def requests(specs: Sequence[Mapping[str, Any]]) -> list[Request]:
    """Checked requests from mappings with ``type``, ``rate`` and the kind's parameters."""
    out = []
    for spec in specs:
        kind, rate = spec.get("type"), spec.get("rate")
        if kind not in ANOMALIES or isinstance(rate, bool) or not isinstance(rate, int | float) or not 0 < rate <= 1:
            raise ValueError(f"an anomaly has a type of {sorted(ANOMALIES)} and a rate in (0, 1]")
        given = {k: v for k, v in spec.items() if k not in ("type", "rate")}
        params = dict(ANOMALIES[kind].defaults) | given
        if set(given) - set(ANOMALIES[kind].defaults) or not ANOMALIES[kind].check(params):
            raise ValueError(f"{kind} does not take {given}")
        out.append(Request(kind, float(rate), params))
    if not out or sum(r.rate for r in out) > 1 + 1e-9:
        raise ValueError("the rates of one or more anomalies add up to 1 at most")
    return out


def load_requests(path: str) -> list[Request]:
    """From the list ``anomalies`` of a YAML, TOML or JSON file, which has nothing else."""
    data = config.read_file(path)
    if set(data) != {"anomalies"} or not isinstance(data["anomalies"], list):
        raise ValueError("the file has one list, anomalies")
    return requests(data["anomalies"])


def token_field(seq: DataFrame) -> str:
    """Which field the tokens are."""
    same = seq.agg(F.coalesce(F.bool_and(F.col("token") == F.col("event_type")), F.lit(True)).alias("kind")).first()
    return "event_type" if same["kind"] else "activity_id"


def context_of(seq: DataFrame, reference: DataFrame | None = None) -> Context:
    """The vocabulary of both logs, and what is normal in ``reference`` (by default the log itself)."""
    normal = seq if reference is None else reference
    field = token_field(seq)
    other = "activity_id" if field == "event_type" else "event_type"
    both = seq.select("token").unionByName(normal.select("token")).distinct().limit(MOST_TOKENS + 1)
    vocabulary = sorted(r["token"] for r in both.collect())
    if len(vocabulary) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens are too many to draw from")
    w = in_session(normal)
    follow = normal.select("token", F.lead("token").over(w).alias("next"), ((F.lead(_us()).over(w) - _us()) / 1e6).alias("gap"))
    seen = {(r["token"], r["next"]) for r in follow.filter("next is not null").select("token", "next").distinct().collect()}  # at most the square of the vocabulary
    gap = quantiles(follow.filter("gap is not null"), F.col("gap"), {"m": 0.5}).first()["m"]
    companions = seq.groupBy("token").agg(F.array_sort(F.collect_set(other)).alias("others"))
    unseen = [(a, b) for a in vocabulary for b in vocabulary if (a, b) not in seen]
    return Context(field, vocabulary, unseen, 30.0 if gap is None else gap, companions)


def choose(seq: DataFrame, wanted: Sequence[Request], context: Context, seed: int) -> tuple[DataFrame, dict[str, Any]]:
    """(session_id, n_events, own, request) of the chosen sessions, and what each request asked for and got."""
    own = seq.groupBy("session_id").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("token")).alias("own"))
    pool = stored(seeded_rank(own, uniform(seed, "anomaly", F.col("session_id")), "session_id"))
    n, at, chosen, report = pool.count(), 0, [], {}
    for i, r in enumerate(wanted):
        quota = round(r.rate * n)
        fits = pool.filter((F.col("rank") > at) & ANOMALIES[r.kind].fits(r.params, context))
        last = cumulate(fits.groupBy("rank").agg(F.count("*").alias("n")), "rank", ["n"]).filter(F.col("n_before") == quota - 1).select("rank").first() if quota else None
        stop = n if quota and last is None else last["rank"] if quota else at
        took = fits.filter(F.col("rank") <= stop)
        done = quota if quota and last is not None else took.count()
        chosen.append(took.select("session_id", "n_events", "own", F.lit(i).alias("request")))
        report[r.kind] = {"category": ANOMALIES[r.kind].category, "rate": r.rate, "requested": quota, "injected": done, "not_applicable": stop - at - done, "parameters": r.params}
        at = stop
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out, {"sessions": n, "anomalies": report}


def remap_ids(events: DataFrame, seed: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``events`` under new ids, and the tables (old, new) of each level.

    Learners and sessions are numbered in a seeded order, events in that of the
    new learners and time; numbers are gapless and padded to one width.
    """
    width = lambda df: len(str(max(1, df.count())))
    named = lambda letter, number, n: F.concat(F.lit(letter), F.lpad(number.cast("string"), n, "0"))
    learners = events.groupBy("learner_id").agg(F.count("*").alias("n"))
    ranked = seeded_rank(learners, uniform(seed, "learner", F.col("learner_id")), "learner_id")
    below = cumulate(ranked, "rank", ["n"])
    people = below.select("learner_id", "n_before", named("L", F.col("rank"), width(learners)).alias("new"))
    sessions = events.filter("session_id is not null").select("session_id").distinct()
    visits = seeded_rank(sessions, uniform(seed, "session", F.col("session_id")), "session_id").select("session_id", named("S", F.col("rank"), width(sessions)).alias("new_session"))
    total = events.count()
    order = Window.partitionBy("learner_id").orderBy("timestamp", "event_id")
    numbered = events.withColumn("__nth", F.row_number().over(order)).join(people, "learner_id").join(visits, "session_id", "left")
    numbered = numbered.withColumn("__event", named("E", F.col("n_before") + F.col("__nth"), len(str(max(1, total)))))
    made = {"learner_id": F.col("new"), "session_id": F.col("new_session"), "event_id": F.col("__event")}
    mapping = {"learner": people.select(F.col("learner_id").alias("old"), "new"), "session": visits.select(F.col("session_id").alias("old"), F.col("new_session").alias("new")), "event": numbered.select(F.col("event_id").alias("old"), F.col("__event").alias("new"))}
    return numbered.select(*(made.get(c, F.col(c)).alias(c) for c in events.columns)), mapping


def apply_requests(seq: DataFrame, chosen: DataFrame, wanted: Sequence[Request], context: Context, seed: int) -> DataFrame:
    """All session events with new ones, times moved, ``__affected`` and ``request`` (null in sessions left as they are).

    Later sessions of a learner are pushed behind one that grew.
    """
    columns = [c for c in seq.columns if c not in ("n_events", "own", "request")]
    mine = seq.select(*columns)
    hit = mine.join(chosen, "session_id")
    out = mine.join(chosen.select("session_id"), "session_id", "left_anti").select(*columns, _us().alias("__us"), F.lit(False).alias("__affected"), F.lit(None).cast("int").alias("request"))
    for i, r in enumerate(wanted):
        made = ANOMALIES[r.kind].rewrite(hit.filter(F.col("request") == i), r.params, context, derive_seed(seed, r.kind))
        out = out.unionByName(made.select(*out.columns))
    spans = out.groupBy("learner_id", "session_id").agg(F.min("__us").alias("start_us"), F.max("__us").alias("end_us"))
    moved = push_later(spans.withColumn("was", F.col("start_us"))).select("session_id", (F.col("start_us") - F.col("was")).alias("__push"))
    return out.join(moved, "session_id").withColumn("timestamp", F.timestamp_micros((F.col("__us") + F.col("__push")).cast("bigint"))).select(*columns, "__affected", "request")


def inject(seq: DataFrame, specs: Sequence[Mapping[str, Any] | Request], *, seed: int, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(events, annotations, report): a share of the sessions with anomalies, under new ids that tell nothing.

    Events without a session are left out.
    """
    wanted = list(specs) if all(isinstance(s, Request) for s in specs) else requests(specs)
    own = seq.filter("session_id is not null")
    context = context_of(own, reference)
    chosen, report = choose(own, wanted, context, seed)
    made = stored(apply_requests(own, stored(chosen), wanted, context, seed))
    events = stored(remap_ids(made, derive_seed(seed, "ids"))[0])
    kinds = F.create_map(*(x for i, r in enumerate(wanted) for x in (F.lit(i), F.lit(r.kind))))
    categories = F.create_map(*(x for i, r in enumerate(wanted) for x in (F.lit(i), F.lit(ANOMALIES[r.kind].category))))
    asked = F.create_map(*(x for i, r in enumerate(wanted) for x in (F.lit(i), F.to_json(F.create_map(*(y for k, v in sorted(r.params.items()) for y in (F.lit(k), F.lit(str(v)))))))))
    grown = events.filter("request is not null")
    sessions = grown.groupBy(F.col("session_id").alias("id"), "request").agg(F.sum(F.col("__affected").cast("int")).alias("n"))
    details = F.to_json(F.map_concat(F.from_json(F.element_at(asked, F.col("request")), "map<string,string>"), F.create_map(F.lit("injected_events"), F.col("n").cast("string"))))
    kind, category = F.element_at(kinds, F.col("request")), F.element_at(categories, F.col("request"))
    truth = A.rows(sessions, "session", "anomaly", kind, category=category, parameters=details).unionByName(A.rows(grown.filter("__affected").select(F.col("event_id").alias("id"), "request"), "event", "anomaly", kind, category=category))
    return events.drop("__affected", "request"), truth, report
