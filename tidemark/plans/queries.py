"""Queries over the supplied tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import log
from tidemark.functions import distances as D
from tidemark.functions.randomness import uniform
from tidemark.functions.scratch import stored
from tidemark.operators import assemble as A
from tidemark.operators import calendar as C
from tidemark.operators import generate as G
from tidemark.operators import manipulation as M
from tidemark.operators import memorisation as R
from tidemark.operators import profile as P
from tidemark.operators import profiles as K
from tidemark.operators import sequences as Q
from tidemark.operators import sessionize as S
from tidemark.operators import validation as V
from tidemark.sources import ingest as I

#: The median gap of the supplied clickstream is hours, so sessions end after eight.
TIMEOUT = 28_800
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The canonical log, its sessions, and the deterministic halves in SQL.
_EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS learner_id, ts, CAST(epoch_us(ts) AS BIGINT) AS us,
 'k' || json_extract_string(props, '$.k') AS activity_id, event_type, event_type AS token, 'c' || CAST(user_id % 4 AS VARCHAR) AS course_id, value AS score, event_type <> 'error' AS success,
 CASE WHEN user_id % 10 < 3 THEN 'b' ELSE 'a' END AS side FROM events)"""


def _cut(timeout: int) -> str:
    return f"""cut AS (SELECT *, us - lag(us) OVER (PARTITION BY learner_id ORDER BY ts, event_id) AS gap FROM ev),
 seq AS (SELECT *, learner_id || ':s' || CAST(sum(CASE WHEN gap IS NULL OR gap > {timeout}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY learner_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM cut)"""


_SES = """ses AS (SELECT session_id, any_value(learner_id) AS learner_id, any_value(side) AS side, any_value(course_id) AS course_id, min(us) AS start_us, max(us) AS end_us, min(ts) AS start_ts, count(*) AS n_events, (max(us) - min(us)) / 1e6 AS duration_s, string_agg(token, ' > ' ORDER BY ts, event_id) AS path FROM seq GROUP BY session_id)"""
_BASE = f"WITH {_EV}, {_cut(TIMEOUT)}, {_SES}"
_W = "(PARTITION BY session_id ORDER BY ts, event_id)"


def query(name: str, sql: str | None = None, base: str = _BASE):
    """Register a query; its SQL may use ev, seq (events with sessions) and ses (sessions)."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (base + (", " if sql.startswith("+") else " ") + sql.removeprefix("+")) if base else sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> DataFrame:
    return log.from_events(spark.read.parquet(f"{d}/events.parquet"))


def seq(spark: SparkSession, d: str, timeout: int = TIMEOUT) -> DataFrame:
    return Q.tokens(S.sessionize(events(spark, d), idle_timeout_s=timeout))


def ses(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(seq(spark, d))


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Sessionized events with ``side``: learners whose number ends in 0, 1 or 2 are 'b'."""
    return seq(spark, d).withColumn("side", F.when(F.col("learner_id").cast("bigint") % 10 < 3, "b").otherwise("a"))


@query("sessionize", "SELECT event_id, session_id FROM seq")
def _(spark, d):
    return seq(spark, d).select("event_id", "session_id")


@query("sessionize_half_hour", "SELECT count(DISTINCT session_id) AS n_sessions, count(*) AS n_events FROM seq", f"WITH {_EV}, {_cut(1800)}")
def _(spark, d):
    return seq(spark, d, 1800).agg(F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_events"))


@query("sessions", "SELECT session_id, learner_id, start_us, end_us, n_events, round(duration_s, 6) AS duration_s, path, course_id FROM ses")
def _(spark, d):
    return ses(spark, d).select("session_id", "learner_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "n_events", F.round("duration_s", 6).alias("duration_s"), F.concat_ws(" > ", "event_sequence").alias("path"), "course_id")


@query("sessions_explicit", "SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_events, string_agg(role, ' > ' ORDER BY turn) AS path FROM conversations GROUP BY conv_id", "")
def _(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    at = F.timestamp_micros(F.col("turn").cast("bigint") * 1_000_000)
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    log_ = t.select(F.concat_ws("-", own, F.format_string("%09d", F.col("turn").cast("bigint"))).alias("event_id"), own.alias("learner_id"), at.alias("timestamp"), own.alias("session_id"), F.col("role").alias("event_type"), F.lit(None).cast("string").alias("course_id"))
    made = S.sessions(S.sessionize(log_, strategy="explicit"))
    return made.select("session_id", "n_events", F.concat_ws(" > ", "event_sequence").alias("path"))


@query("participants", "SELECT learner_id, string_agg(DISTINCT course_id, ',' ORDER BY course_id) AS courses FROM ev GROUP BY learner_id")
def _(spark, d):
    return S.participants(events(spark, d)).select("learner_id", F.array_join("course_ids", ",").alias("courses"))


@query("event_type_counts", "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("token_counts", "SELECT activity_id AS token, count(*) AS n FROM seq GROUP BY activity_id")
def _(spark, d):
    return Q.tokens(S.sessionize(events(spark, d), idle_timeout_s=TIMEOUT), "activity_id").groupBy("token").agg(F.count("*").alias("n"))


def _grams(n: int) -> str:
    leads = " || ' > ' || ".join(["token"] + [f"lead(token, {k}) OVER {_W}" for k in range(1, n)])
    return f"g AS (SELECT session_id, side, {leads} AS ngram FROM seq)"


@query("bigrams", f"+{_grams(2)} SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY ngram")
def _(spark, d):
    return Q.ngrams(seq(spark, d), 2)


@query("rare_trigrams", "+g AS (SELECT activity_id || ' > ' || lead(activity_id) OVER w || ' > ' || lead(activity_id, 2) OVER w AS ngram FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY ngram HAVING count(*) <= 3")
def _(spark, d):
    return Q.rare_ngrams(Q.ngrams(Q.tokens(seq(spark, d), "activity_id"), 3), 3)


def _trans(k: int) -> str:
    pads = " || ' > ' || ".join(f"coalesce(lag(token, {i}) OVER {_W}, '<start>')" for i in range(k, 0, -1))
    return f"c AS (SELECT side, {pads} AS context, token FROM seq), t AS (SELECT context, token, count(*) AS n FROM c GROUP BY context, token)"


@query("transitions_1", f"+{_trans(1)} SELECT * FROM t")
def _(spark, d):
    return Q.transitions(seq(spark, d), 1)


@query("transitions_2", f"+{_trans(2)} SELECT * FROM t")
def _(spark, d):
    return Q.transitions(seq(spark, d), 2)


@query("transition_probabilities", f"+{_trans(1)}, v AS (SELECT DISTINCT token FROM t), s AS (SELECT context, sum(n) AS total FROM t GROUP BY context) SELECT s.context, v.token, round((coalesce(t.n, 0) + 0.5) / (s.total + 0.5 * (SELECT count(*) FROM v)), 6) AS p FROM s CROSS JOIN v LEFT JOIN t ON t.context = s.context AND t.token = v.token")
def _(spark, d):
    return Q.probabilities(Q.transitions(seq(spark, d)), 0.5).select("context", "token", F.round("p", 6).alias("p"))


@query("transition_density", f"+{_trans(1)} SELECT CAST(sum(n) AS BIGINT) AS n_transitions, CAST(sum(CASE WHEN context = '<start>' THEN n END) AS BIGINT) AS n_starts, count(DISTINCT token) AS vocabulary, round(sum(CASE WHEN context <> '<start>' THEN 1.0 ELSE 0 END) / (count(DISTINCT token) * count(DISTINCT token)), 6) AS density FROM t")
def _(spark, d):
    return Q.density(Q.transitions(seq(spark, d)))


def _describe(v: str) -> str:
    q = ", ".join(f"round(quantile_cont({v}, {p}), 4) AS {n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
    return f"count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS std, round(min({v}), 4) AS min, round(max({v}), 4) AS max, {q}"


_GAPS = f"gp AS (SELECT side, session_id, token, (lead(us) OVER {_W} - us) / 1e6 AS gap_s FROM seq)"


@query("describe_duration", f"SELECT {_describe('duration_s')} FROM ses")
def _(spark, d):
    return P.describe(ses(spark, d), "duration_s")


@query("interevent_times", f"+{_GAPS} SELECT {_describe('gap_s')} FROM gp")
def _(spark, d):
    return P.describe(P.gaps(seq(spark, d)), "gap_s")


@query("sojourn_times", f"+{_GAPS} SELECT token, {_describe('gap_s')} FROM gp WHERE gap_s IS NOT NULL GROUP BY token")
def _(spark, d):
    return P.describe(P.gaps(seq(spark, d)), "gap_s", "token")


@query("token_entropy", "SELECT round(-sum(p * log2(p)), 6) AS entropy_bits FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ev GROUP BY event_type)")
def _(spark, d):
    return P.entropy(events(spark, d), "event_type")


@query("corpus_features", "SELECT count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, count(DISTINCT learner_id) AS n_learners, count(DISTINCT event_type) AS vocabulary FROM seq")
def _(spark, d):
    return P.corpus_features(seq(spark, d), None)


@query("session_features", "+e AS (SELECT session_id, event_type, count(*) AS n FROM seq GROUP BY 1, 2), h AS (SELECT session_id, round(abs(sum(p * log2(p))), 6) AS type_entropy FROM (SELECT session_id, n / sum(n) OVER (PARTITION BY session_id) AS p FROM e) GROUP BY 1) SELECT s.session_id, count(*) AS length, round((max(us) - min(us)) / 1e6, 6) AS duration_s, count(DISTINCT activity_id) AS unique_activities, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, any_value(h.type_entropy) AS type_entropy FROM seq s JOIN h ON h.session_id = s.session_id GROUP BY s.session_id")
def _(spark, d):
    return P.session_features(seq(spark, d))


@query("learner_profiles", "SELECT learner_id, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, round(avg(n_events), 6) AS mean_length, round(avg(duration_s), 4) AS mean_duration_s, CAST(1 AS BIGINT) AS n_courses FROM ses GROUP BY learner_id")
def _(spark, d):
    return P.learner_profiles(seq(spark, d), ses(spark, d))


@query("top_edges", f"+{_grams(2)} SELECT split_part(ngram, ' > ', 1) AS src, split_part(ngram, ' > ', 2) AS dst, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, src, dst LIMIT 10")
def _(spark, d):
    return Q.top_edges(Q.edges(seq(spark, d)))


@query("self_loop_share", f"+p AS (SELECT token, lead(token) OVER {_W} AS nx FROM seq) SELECT round(avg(CASE WHEN token = nx THEN 1.0 ELSE 0.0 END), 6) AS share FROM p WHERE nx IS NOT NULL")
def _(spark, d):
    return Q.self_loop_share(Q.edges(seq(spark, d)))


@query("activity_profiles", f"+r AS (SELECT token, session_id, learner_id, success, score, lag(token) OVER {_W} AS b, lead(token) OVER {_W} AS a, (lead(us) OVER {_W} - us) / 1e6 AS dw FROM seq) SELECT token, count(*) AS n, count(DISTINCT session_id) AS n_sessions, count(DISTINCT learner_id) AS n_learners, round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0 END), 6) AS start_share, round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END), 6) AS end_share, round(avg(CASE WHEN b = token THEN 1.0 ELSE 0 END), 6) AS repeat_share, round(quantile_cont(dw, 0.5), 4) AS dwell_median_s, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(score), 6) AS mean_score, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY token")
def _(spark, d):
    return Q.activity_profiles(seq(spark, d))


def _ranked(inner: str, k: int, by: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, label) AS rank FROM ({inner})) WHERE rank <= {k}"


@query("companions", _ranked("SELECT token, activity_id AS label, count(*) AS n FROM seq GROUP BY 1, 2", 5, "token"))
def _(spark, d):
    return Q.companions(seq(spark, d))


@query("successors", f"+f AS (SELECT token, coalesce(lead(token) OVER {_W}, '(end)') AS label FROM seq) " + _ranked("SELECT token, label, count(*) AS n FROM f GROUP BY 1, 2", 5, "token"))
def _(spark, d):
    return Q.neighbours(seq(spark, d))


@query("heat_map", "+c AS (SELECT w.i AS weekday, h.i AS hour FROM generate_series(0, 6) AS w(i) CROSS JOIN generate_series(0, 23) AS h(i)), t AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM ev GROUP BY 1, 2) SELECT CAST(c.weekday AS INTEGER) AS weekday, CAST(c.hour AS INTEGER) AS hour, coalesce(n, 0) AS n FROM c LEFT JOIN t ON t.weekday = c.weekday AND t.hour = c.hour")
def _(spark, d):
    return P.heat_map(events(spark, d))


_WEEK = "CAST(floor(date_diff('day', CAST(date_trunc('week', (SELECT min(start_ts) FROM ses)) AS DATE), CAST({0} AS DATE)) / 7.0) + 1 AS INTEGER)"


@query("weekly", f"+a AS (SELECT {_WEEK.format('start_ts')} AS week, count(*) AS n_sessions, count(DISTINCT learner_id) AS n_learners FROM ses GROUP BY 1), b AS (SELECT {_WEEK.format('ts')} AS week, count(*) AS n_events FROM ev GROUP BY 1) SELECT CAST(w.i AS INTEGER) AS week, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_events, 0) AS n_events, coalesce(n_learners, 0) AS n_learners FROM generate_series(1, (SELECT max(week) FROM a)) AS w(i) LEFT JOIN a ON a.week = w.i LEFT JOIN b ON b.week = w.i")
def _(spark, d):
    return P.weekly(events(spark, d), ses(spark, d))


@query("between_sessions", f"+p AS (SELECT start_us, lag(end_us) OVER (PARTITION BY learner_id ORDER BY start_us, session_id) AS pe FROM ses), q AS (SELECT greatest((start_us - pe) / 1e6, 0.0) AS gap_s FROM p WHERE pe IS NOT NULL) SELECT {_describe('gap_s')} FROM q")
def _(spark, d):
    return P.describe(P.between_sessions(ses(spark, d)), "gap_s")


@query("deadline_effects", "+d AS (SELECT CAST(start_ts AS DATE) AS day, count(*) AS n FROM ses GROUP BY 1), s AS (SELECT CAST(u.x AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS x) u LEFT JOIN d ON d.day = CAST(u.x AS DATE)), l AS (SELECT 'one' AS deadline, DATE '2024-01-10' AS due UNION ALL SELECT 'two', DATE '2024-01-20'), m AS (SELECT deadline, avg(CASE WHEN day BETWEEN due - 3 AND due THEN n END) AS a, avg(CASE WHEN NOT day BETWEEN due - 3 AND due THEN n END) AS b FROM s CROSS JOIN l GROUP BY 1) SELECT deadline, round(a, 6) AS per_day_near, round(b, 6) AS per_day_else, round(a / b, 6) AS ratio FROM m")
def _(spark, d):
    return P.deadline_effects(ses(spark, d), [("one", "2024-01-10"), ("two", "2024-01-20")])


_BY = """+x AS (SELECT session_id, course_id AS label, n_events, learner_id FROM ses), st AS (SELECT label, count(*) AS n_sessions, count(DISTINCT learner_id) AS n_learners, CAST(sum(n_events) AS BIGINT) AS n_events, round(avg(n_events), 6) AS mean_length FROM x GROUP BY GROUPING SETS ((label), ())),
 tk AS (SELECT course_id AS label, token, count(*) AS n FROM seq GROUP BY 1, 2), pp AS (SELECT label, token, n / sum(n) OVER (PARTITION BY label) AS p FROM tk), qq AS (SELECT token, sum(n) / (SELECT sum(n) FROM tk) AS q FROM tk GROUP BY token),
 tv AS (SELECT label, round(sum(greatest(p - q, 0.0)), 6) AS tvd FROM pp JOIN qq USING (token) GROUP BY label) SELECT coalesce(st.label, '(all)') AS label, n_sessions, n_learners, n_events, mean_length, coalesce(tvd, 0.0) AS tvd FROM st LEFT JOIN tv ON tv.label = st.label"""


@query("analyze_by_course", _BY)
def _(spark, d):
    return P.analyze_by(P.session_label(ses(spark, d), "course"))


@query("sessions_by_weekday", "SELECT CAST(isodow(start_ts) AS VARCHAR) || '-' || strftime(start_ts, '%a') AS label, count(*) AS n FROM ses GROUP BY 1")
def _(spark, d):
    return P.session_label(ses(spark, d), "weekday").groupBy("label").agg(F.count("*").alias("n"))


@query("sessions_by_week", f"SELECT CAST({_WEEK.format('start_ts')} AS VARCHAR) AS label, count(*) AS n FROM ses GROUP BY 1")
def _(spark, d):
    return P.session_label(ses(spark, d), "week").groupBy("label").agg(F.count("*").alias("n"))


_TYPES = ("click", "error", "purchase", "signup", "view")
_LF = "lf AS (SELECT s.learner_id, s.n_sessions, round(s.ml, 6) AS mean_length, round(ln(1 + s.md), 6) AS log_duration, round(m.sr, 6) AS success_rate, " + ", ".join(f"m.share_{t}" for t in _TYPES) + " FROM (SELECT learner_id, count(*) AS n_sessions, avg(n_events) AS ml, avg(duration_s) AS md FROM ses GROUP BY 1) s JOIN (SELECT learner_id, avg(CASE WHEN success THEN 1.0 ELSE 0 END) AS sr, " + ", ".join(f"round(avg(CASE WHEN event_type = '{t}' THEN 1.0 ELSE 0 END), 6) AS share_{t}" for t in _TYPES) + " FROM ev GROUP BY 1) m ON m.learner_id = s.learner_id)"
_LC = ["n_sessions", "mean_length", "log_duration", "success_rate", *(f"share_{t}" for t in _TYPES)]


@query("learner_features", f"+{_LF} SELECT * FROM lf")
def _(spark, d):
    return P.learner_features(ses(spark, d), events(spark, d), _TYPES)


@query("standardized_features", f"+{_LF} SELECT learner_id, " + ", ".join(f"round(greatest(-3.0, least(3.0, ({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END)), 5) AS {c}" for c in _LC) + " FROM lf")
def _(spark, d):
    return P.standardize(P.learner_features(ses(spark, d), events(spark, d), _TYPES), "learner_id")


def _kmeans(spark, d):
    """Learner clusters by k-means, numbered by descending size; no SQL twin."""
    from pyspark.ml.feature import VectorAssembler

    s = seq(spark, d)
    known = stored(P.learner_features(P.spans(s), s, _TYPES))
    rows = P.standardize(K.in_parts(known, known.count()), "learner_id")
    points = VectorAssembler(inputCols=_LC, outputCol="features").transform(rows).select("learner_id", "features").cache()
    try:
        model = K.best_kmeans(points, 3, 7, maxIter=50, initSteps=5)
        sizes, centres = model.summary.clusterSizes, model.clusterCenters()
    finally:
        points.unpersist()
    order = {c: r for r, c in enumerate(sorted(range(3), key=lambda c: (-sizes[c], list(centres[c]))))}
    number = F.create_map(*(F.lit(x) for p in order.items() for x in p))
    return model.transform(points).select("learner_id", F.element_at(number, F.col("prediction")).alias("profile"))


QUERIES["learner_clusters"] = _kmeans


def _tvd(table: str, key: str) -> str:
    return f"SELECT round(sum(abs(coalesce(na / ta, 0) - coalesce(nb / tb, 0))) / 2, 6) AS value FROM (SELECT na, nb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM (SELECT {key}, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}))"


def _js(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2)"


def _steps(table: str, key: str) -> str:
    return f"st AS (SELECT x, sum(na) OVER (ORDER BY x) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY x) / sum(nb) OVER () AS fb, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT {key} AS x, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM {table} WHERE {key} IS NOT NULL GROUP BY 1))"


_KS, _W1 = "SELECT round(max(abs(fa - fb)), 6) AS value FROM st", "SELECT round(sum(abs(fa - fb) * (nx - x)), 4) AS value FROM st"
_METRIC_SQL = {
    "event_type_tvd": _tvd("ev", "event_type"),
    "activity_jsd": f"+c AS (SELECT na / sum(na) OVER () AS p, nb / sum(nb) OVER () AS q FROM (SELECT activity_id, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM ev GROUP BY 1)) SELECT round(sum({_js('p', 'q')}), 6) AS value FROM c",
    "session_length_ks": f"+{_steps('ses', 'n_events')} {_KS}",
    "session_duration_w1": f"+{_steps('ses', 'duration_s')} {_W1}",
    "interevent_time_ks": f"+{_GAPS}, {_steps('gp', 'gap_s')} {_KS}",
    "bigram_tvd": f"+{_grams(2)} {_tvd('g', 'ngram')}",
    "transition_jsd": f"+{_trans(1)}, n AS (SELECT context, token, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM c GROUP BY 1, 2), s AS (SELECT context, na, nb, sum(na) OVER (PARTITION BY context) AS ta, sum(nb) OVER (PARTITION BY context) AS tb FROM n), p AS (SELECT context, ta, tb, na / ta AS p, CASE WHEN tb = 0 THEN 0 ELSE nb / tb END AS q FROM s WHERE ta > 0), j AS (SELECT context, any_value(ta) AS ta, CASE WHEN any_value(tb) = 0 THEN 1.0 ELSE sum({_js('p', 'q')}) END AS d FROM p GROUP BY context) SELECT round(sum(d * ta) / sum(ta), 6) AS value FROM j",
    "topn_path_overlap": f"+{_grams(3)}, k AS (SELECT side, ngram, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, ngram) AS r FROM g WHERE ngram IS NOT NULL GROUP BY side, ngram) SELECT round(count(b.ngram) / CAST(count(*) AS DOUBLE), 6) AS value FROM (SELECT * FROM k WHERE side = 'a' AND r <= 10) a LEFT JOIN (SELECT * FROM k WHERE side = 'b' AND r <= 10) b ON a.ngram = b.ngram",
    "exact_session_dup_rate": "SELECT round(avg(CASE WHEN path IN (SELECT path FROM ses WHERE side = 'a' AND n_events >= 3) THEN 1.0 ELSE 0.0 END), 6) AS value FROM ses WHERE side = 'b' AND n_events >= 3",
    "rare_ngram_replay_rate": f"+{_grams(3)}, k AS (SELECT ngram, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM g WHERE ngram IS NOT NULL GROUP BY 1) SELECT round(avg(CASE WHEN nb > 0 THEN 1.0 ELSE 0.0 END), 6) AS value FROM k WHERE na = 1",
}


def _metric(name: str):
    def run(spark, d):
        both = halves(spark, d)
        return V.METRICS[name](both, both)

    return run


for _name, _sql in _METRIC_SQL.items():
    query(f"metric_{_name}", _sql)(_metric(_name))


@query("metric_nn_distance_p05", None)
def _(spark, d):
    made = ses(spark, d)
    low = F.col("learner_id").cast("bigint") % 10 < 3
    return V.nearest_distance(made.filter(~low), made.filter(low), seed=1)


@query("token_gaps", "SELECT token, round(na / sum(na) OVER (), 6) AS share_a, round(nb / sum(nb) OVER (), 6) AS share_b, round(nb / sum(nb) OVER () - na / sum(na) OVER (), 6) AS gap FROM (SELECT token, count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb FROM seq GROUP BY 1)")
def _(spark, d):
    return V.token_gaps(halves(spark, d))


@query("novel_transitions", "+g AS (SELECT side, activity_id || ' > ' || lead(activity_id) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g FROM seq WHERE CAST(substr(event_id, -1) AS INTEGER) < 3) SELECT g, CASE WHEN min(side) = 'b' THEN 'novel' ELSE 'missing' END AS kind, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY g HAVING min(side) = max(side)")
def _(spark, d):
    """A third of the events, so that either side lacks some pairs of activities."""
    some = halves(spark, d).filter("cast(substring(event_id, -1) as int) < 3")
    return V.novel_transitions(Q.tokens(some, "activity_id"))


@query("detection", "SELECT * FROM (WITH s AS (SELECT CAST(quality = 0 AS INTEGER) AS t, CAST(doc_id % 17 AS DOUBLE) / 17 AS s FROM labels), g AS (SELECT s, CAST(sum(t) AS BIGINT) AS pos, count(*) AS n FROM s GROUP BY s), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(pos) OVER (ORDER BY s DESC) AS hits, sum(n) OVER (ORDER BY s DESC) AS seen FROM g), a AS (SELECT CAST(sum(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= 0.5 THEN n - pos ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN s < 0.5 THEN pos ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN s < 0.5 THEN n - pos ELSE 0 END) AS BIGINT) AS tn, sum(pos * (bf + (n + 1) / 2.0)) AS ranks, sum(pos) AS p, sum(n - pos) AS q, sum(pos * hits / CAST(seen AS DOUBLE)) AS ap FROM r) SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr, round((ranks - p * (p + 1) / 2.0) / (p * q), 6) AS roc_auc, round(ap / p, 6) AS average_precision FROM a)", "")
def _(spark, d):
    t = spark.read.parquet(f"{d}/labels.parquet")
    return V.detection(t.select((F.col("quality") == 0).alias("truth"), ((F.col("doc_id") % 17).cast("double") / 17).alias("score")))


@query("clustering", "SELECT * FROM (WITH c AS (SELECT quality AS truth, doc_id % 3 AS predicted, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1, 2), a AS (SELECT truth, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT predicted, sum(n) AS n, max(n) AS top FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c), v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sn, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, (SELECT n * (n - 1) / 2 FROM t) AS st, (SELECT sum(c.n / t.n * ln(c.n * t.n / (a.n * b.n))) FROM c JOIN a ON a.truth = c.truth JOIN b ON b.predicted = c.predicted CROSS JOIN t) AS mi, (SELECT -sum(a.n / t.n * ln(a.n / t.n)) FROM a CROSS JOIN t) AS ha, (SELECT -sum(b.n / t.n * ln(b.n / t.n)) FROM b CROSS JOIN t) AS hb, (SELECT sum(top) FROM b) / (SELECT n FROM t) AS pu) SELECT round((sn - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(pu, 6) AS purity FROM v)", "")
def _(spark, d):
    t = spark.read.parquet(f"{d}/labels.parquet")
    return V.clustering(t.select(F.col("quality").alias("truth"), (F.col("doc_id") % 3).alias("predicted")))


def _u(seed: int, *parts: str) -> str:
    text = " || chr(31) || ".join([f"'{seed}'", *parts])
    return f"(CAST(('0x' || substr(sha256({text}), 1, 13)) AS BIGINT) / pow(2, 52))"


@query("split_by_learner", f"+l AS (SELECT DISTINCT learner_id, {_u(3, chr(39) + 'split' + chr(39), 'learner_id')} AS u FROM ev) SELECT learner_id, row_number() OVER (ORDER BY u, learner_id) <= greatest(1, least(ceil((SELECT count(*) FROM l) * 0.3), (SELECT count(*) FROM l) - 1)) AS holdout FROM l")
def _(spark, d):
    return V.split_by_learner(events(spark, d), 0.3, 3)


@query("session_nll", f"+{_trans(1)}, v AS (SELECT count(DISTINCT token) AS v FROM t), z AS (SELECT context, token, (n + 1.0) / (sum(n) OVER (PARTITION BY context) + (SELECT v FROM v)) AS p FROM t), y AS (SELECT session_id, coalesce(lag(token) OVER {_W}, '<start>') AS context, token FROM seq) SELECT session_id, round(avg(-ln(p)), 6) AS nll FROM y JOIN z ON z.context = y.context AND z.token = y.token GROUP BY session_id")
def _(spark, d):
    return Q.nll(seq(spark, d))


@query("sankey", f"+p AS (SELECT session_id, token, row_number() OVER {_W} AS step, lead(token) OVER {_W} IS NULL AS last FROM seq), q AS (SELECT * FROM p WHERE step <= 4), k AS (SELECT step, token FROM (SELECT step, token, row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, token) AS r FROM q GROUP BY step, token) WHERE r <= 3), n AS (SELECT q.session_id, q.step, CASE WHEN k.token IS NULL THEN 'other' ELSE q.token END AS label FROM q LEFT JOIN k ON k.step = q.step AND k.token = q.token UNION ALL SELECT session_id, step + 1, '(end)' FROM q WHERE last AND step < 4), f AS (SELECT step, label AS src, lead(label) OVER (PARTITION BY session_id ORDER BY step) AS dst FROM n) SELECT step, src, dst, count(*) AS n FROM f WHERE dst IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    return Q.sankey(seq(spark, d), 4, 3)


@query("length_histogram", "SELECT n_events AS length, count(*) AS n FROM ses GROUP BY 1")
def _(spark, d):
    return ses(spark, d).groupBy(F.col("n_events").alias("length")).agg(F.count("*").alias("n"))


@query("ecdf_interevent", f"+{_GAPS}, h AS (SELECT floor(log10(gap_s) * 4) AS bin, count(*) AS n FROM gp WHERE gap_s > 0 GROUP BY 1) SELECT CAST(bin AS BIGINT) AS bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM h")
def _(spark, d):
    from pyspark.sql import Window

    h = P.gaps(seq(spark, d)).filter("gap_s > 0").groupBy(F.floor(F.log10("gap_s") * 4).alias("bin")).agg(F.count("*").alias("n"))
    return h.select("bin", "n", F.round(F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(D.whole()), 6).alias("share"))


@query("timeline_sample", f"+c AS (SELECT session_id FROM ses ORDER BY {_u(5, chr(39) + 'timeline' + chr(39), 'session_id')}, session_id LIMIT 30) SELECT s.session_id, s.event_id, s.token, round((us - first_value(us) OVER (PARTITION BY s.session_id ORDER BY ts, event_id)) / 6e7, 4) AS minute FROM seq s JOIN c ON c.session_id = s.session_id")
def _(spark, d):
    """A sampling operator: thirty sessions for a plot."""
    s = seq(spark, d)
    chosen = s.select("session_id").distinct().orderBy(uniform(5, "timeline", F.col("session_id")), "session_id").limit(30)
    us = F.unix_micros("timestamp")
    return s.join(F.broadcast(chosen), "session_id").select("session_id", "event_id", "token", F.round((us - F.first(us).over(Q.in_session(s))) / 6e7, 4).alias("minute"))


@query("unseen_pairs", f"+v AS (SELECT DISTINCT activity_id AS t FROM ev), b AS (SELECT DISTINCT activity_id AS src, lead(activity_id) OVER {_W} AS dst FROM seq) SELECT x.t AS src, y.t AS dst FROM v x CROSS JOIN v y LEFT JOIN b ON b.src = x.t AND b.dst = y.t WHERE b.src IS NULL")
def _(spark, d):
    return G.unseen_pairs(Q.tokens(seq(spark, d), "activity_id"))


_PICK = f"q AS (SELECT session_id, n_events FROM (SELECT session_id, n_events, row_number() OVER (ORDER BY {_u(7, chr(39) + 'anomaly' + chr(39), 'session_id')}, session_id) AS r FROM ses WHERE n_events >= 2) WHERE r <= (SELECT round_even(count(*) * 0.1, 0) FROM ses))"


@query("anomaly_quota", f"+{_PICK} SELECT * FROM q")
def _(spark, d):
    return G.anomaly_quota(seq(spark, d), 0.1, 7)


@query("anomaly_timing", f"+{_PICK}, g AS (SELECT s.session_id, s.event_id, s.ts, s.us, greatest(CAST(trunc((s.us - lag(s.us) OVER (PARTITION BY s.session_id ORDER BY s.ts, s.event_id)) * 0.1) AS BIGINT), 1000) AS gp, lag(s.us) OVER (PARTITION BY s.session_id ORDER BY s.ts, s.event_id) AS pu FROM seq s JOIN q ON q.session_id = s.session_id) SELECT session_id, event_id, CAST(first_value(us) OVER (PARTITION BY session_id ORDER BY ts, event_id) + coalesce(sum(CASE WHEN pu IS NULL THEN 0 ELSE gp END) OVER (PARTITION BY session_id ORDER BY ts, event_id), 0) AS BIGINT) AS new_us FROM g")
def _(spark, d):
    s = seq(spark, d)
    return G.abnormal_timing(s, G.anomaly_quota(s, 0.1, 7), 0.1).select("session_id", "event_id", F.col("new_us").cast("bigint").alias("new_us"))


@query("anomaly_inactivity", f"+{_PICK} SELECT s.session_id, s.event_id, CAST(s.us + CASE WHEN row_number() OVER (PARTITION BY s.session_id ORDER BY s.ts, s.event_id) > floor(q.n_events / 2) THEN 7200000000 ELSE 0 END AS BIGINT) AS new_us FROM seq s JOIN q ON q.session_id = s.session_id")
def _(spark, d):
    s = seq(spark, d)
    return G.inactivity(s, G.anomaly_quota(s, 0.1, 7), 7200).select("session_id", "event_id", F.col("new_us").cast("bigint").alias("new_us"))


_POS = f"row_number() OVER (PARTITION BY s.session_id ORDER BY s.ts, s.event_id) AS r, floor({_u(5, chr(39) + 'position' + chr(39), 's.session_id')} * q.n_events) + 1 AS p"


@query("anomaly_event_frequency", f"+{_PICK}, z AS (SELECT s.*, {_POS} FROM seq s JOIN q ON q.session_id = s.session_id) SELECT session_id, event_id, token, CAST(us + CASE WHEN r > p THEN 180000000 ELSE 0 END AS BIGINT) AS new_us, false AS inserted FROM z UNION ALL SELECT session_id, event_id || '+' || CAST(k AS VARCHAR), 'view', CAST(us + k * 9000000 AS BIGINT), true FROM z CROSS JOIN generate_series(1, 20) AS t(k) WHERE r = p")
def _(spark, d):
    s = seq(spark, d)
    return M.event_frequency(s, G.anomaly_quota(s, 0.1, 7), "view", 20, 180, seed=5)


@query("anomaly_unexpected_transition", f"+{_PICK}, v AS (SELECT DISTINCT activity_id AS t FROM ev), b AS (SELECT DISTINCT activity_id AS src, lead(activity_id) OVER {_W} AS dst FROM seq), c AS (SELECT x.t AS src, y.t AS dst, row_number() OVER (ORDER BY x.t, y.t) - 1 AS pair FROM v x CROSS JOIN v y LEFT JOIN b ON b.src = x.t AND b.dst = y.t WHERE b.src IS NULL), z AS (SELECT s.*, c.src, c.dst, {_POS} FROM seq s JOIN q ON q.session_id = s.session_id JOIN c ON c.pair = floor({_u(5, chr(39) + 'pair' + chr(39), 's.session_id')} * (SELECT count(*) FROM c))) SELECT session_id, event_id, activity_id AS token, CAST(us + CASE WHEN r > p THEN 120000000 ELSE 0 END AS BIGINT) AS new_us, false AS inserted FROM z UNION ALL SELECT session_id, event_id || '+' || CAST(k AS VARCHAR), CASE WHEN k = 1 THEN src ELSE dst END, CAST(us + k * 60000000 AS BIGINT), true FROM z CROSS JOIN generate_series(1, 2) AS t(k) WHERE r = p")
def _(spark, d):
    s = Q.tokens(seq(spark, d), "activity_id")
    return M.unexpected_transition(s, G.anomaly_quota(s, 0.1, 7), 60, seed=5)


def _share(token: str, side: str) -> str:
    return f"coalesce(count(CASE WHEN side = '{side}' AND token = '{token}' THEN 1 END) / count(CASE WHEN side = '{side}' THEN 1 END), 0)"


def _median(token: str, side: str) -> str:
    return f"median(CASE WHEN side = '{side}'" + (f" AND token = '{token}'" if token != "*" else "") + " THEN gap_s END)"


_MEAN = "CAST(count(CASE WHEN side = '{0}' THEN 1 END) AS DOUBLE) / count(CASE WHEN side = '{0}' AND gap_s IS NULL THEN 1 END)"
_ITEMS = [("event_weights", "click", _share("click", "a"), _share("click", "b"), "c < b"), ("event_weights", "error", _share("error", "a"), _share("error", "b"), "c = 0"), ("event_weights", "view", _share("view", "a"), _share("view", "b"), "c > b"), ("dwell_scale", "*", _median("*", "a"), _median("*", "b"), "abs(c / b / 1.0 - 1) <= 0.2"), ("dwell_scale", "view", _median("view", "a"), _median("view", "b"), "abs(c / b / 2.0 - 1) <= 0.2"), ("session_length", "scale", _MEAN.format("a"), _MEAN.format("b"), "abs(c / b / 1.0 - 1) <= 0.2")]


@query("manipulation_check", f"+h AS (SELECT side, session_id, token, (lead(us) OVER {_W} - us) / 1e6 AS gap_s FROM seq) " + " UNION ALL ".join(f"SELECT '{control}' AS control, '{target}' AS target, round(b, 6) AS before, round(c, 6) AS after, CASE WHEN {right} THEN 'ok' ELSE 'failed' END AS status FROM (SELECT {b} AS b, {c} AS c FROM h)" for control, target, b, c, right in _ITEMS))
def _(spark, d):
    s = halves(spark, d)
    return M.check_controls(s.filter("side = 'a'"), s.filter("side = 'b'"), {"view": 1.5, "error": 0.0, "click": 0.5, "signup": 1.0}, {"view": 2.0, "*": 1.0}, 1.0)


#: Office hours of working days in three weeks, shorter than the log.
def _office(spark: SparkSession) -> C.Timetable:
    week = dict.fromkeys(("Mon", "Tue", "Wed", "Thu", "Fri"), 1.0)
    return C.opening(spark, "2024-01-01", "2024-01-21", hours=dict.fromkeys(range(8, 18), 1.0), week=week, rushes=[("2024-01-15", 3, 2.0)])



@query("calendar_next_allowed", "+o AS (SELECT s AS b, s + INTERVAL 1 HOUR AS e FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-21 23:00:00', INTERVAL 1 HOUR) AS t(s) WHERE hour(s) BETWEEN 8 AND 17 AND isodow(s) < 6) SELECT session_id, CAST(coalesce(greatest(epoch_us(o.b), start_us), start_us) AS BIGINT) AS next_us FROM ses ASOF LEFT JOIN o ON ses.start_ts < o.e")
def _(spark, d):
    return _office(spark).next_open(ses(spark, d), "start_time", "next").select("session_id", F.unix_micros("next").alias("next_us"))


_DAYS = "p AS (SELECT isodow(s) - 1 AS k, sum(CASE WHEN isodow(s) > 5 THEN 0.0 WHEN s BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-15' THEN 2.0 ELSE 1.0 END) AS w FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-21', INTERVAL 1 DAY) AS t(s) GROUP BY 1 UNION ALL SELECT 100 + i, CASE WHEN i BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END FROM generate_series(0, 23) AS t(i)), n AS (SELECT count(*) AS n FROM ses), x AS (SELECT isodow(start_ts) - 1 AS k, count(*) AS c FROM ses GROUP BY 1 UNION ALL SELECT 100 + hour(start_ts), count(*) FROM ses GROUP BY 1), dv AS (SELECT p.k >= 100 AS hours, sum(abs(coalesce(x.c, 0) / n.n - p.w / t.w)) / 2 AS m, greatest(0.1, 0.75 * sqrt(count(*) / max(n.n))) AS b FROM p JOIN (SELECT k >= 100 AS hours, sum(w) AS w FROM p GROUP BY 1) t ON t.hours = (p.k >= 100) LEFT JOIN x ON x.k = p.k CROSS JOIN n GROUP BY 1)"


@query("calendar_check", f"""+{_DAYS}, i AS (SELECT 'calendar' AS control, 'period' AS target, CAST(count(CASE WHEN CAST(start_ts AS DATE) NOT BETWEEN DATE '2024-01-01' AND DATE '2024-01-22' THEN 1 END) AS DOUBLE) AS m, 0.0::DOUBLE AS b FROM ses UNION ALL SELECT 'calendar.hours', 'closed', CAST(count(CASE WHEN hour(start_ts) NOT BETWEEN 8 AND 17 THEN 1 END) AS DOUBLE), 0.0 FROM ses UNION ALL SELECT CASE WHEN hours THEN 'calendar.hours' ELSE 'calendar.weekdays' END, 'distribution', m, b FROM dv), ru AS (SELECT day, CASE WHEN isodow(day) > 5 THEN 0.0::DOUBLE WHEN day BETWEEN DATE '2024-01-12' AND DATE '2024-01-15' THEN 2.0 ELSE 1.0 END AS w, day BETWEEN DATE '2024-01-12' AND DATE '2024-01-15' AS near, coalesce((SELECT count(*) FROM ses WHERE CAST(start_ts AS DATE) = day), 0) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-21', INTERVAL 1 DAY)) AS DATE) AS day)),
 rr AS (SELECT avg(CASE WHEN near THEN w END) AS w1, avg(CASE WHEN NOT near AND w > 0 THEN w END) AS w0, avg(CASE WHEN near THEN n END) AS r1, avg(CASE WHEN NOT near AND w > 0 THEN n END) AS r0, sum(CASE WHEN near THEN n END) AS n1, sum(CASE WHEN NOT near AND w > 0 THEN n END) AS n0 FROM ru),
 rm AS (SELECT abs((r1 / r0) / (w1 / w0) - 1) AS m, greatest(0.2, 3 * sqrt(1.0 / greatest(n1, 1) + 1.0 / greatest(n0, 1))) AS b, n1 FROM rr)
SELECT control, target, round(m, 6) AS measured, round(b, 6) AS bound, CASE WHEN m <= b THEN 'ok' ELSE 'failed' END AS status FROM i UNION ALL SELECT 'calendar.deadlines', '2024-01-15', round(m, 6), round(b, 6), CASE WHEN n1 < 20 THEN 'not_measurable' WHEN m <= b THEN 'ok' ELSE 'failed' END FROM rm""")
def _(spark, d):
    return _office(spark).check(ses(spark, d))


_PLAN = """dd AS (SELECT day, sum(w) OVER (ORDER BY day) / sum(w) OVER () AS cum FROM (SELECT CAST(s AS DATE) AS day, CASE WHEN isodow(s) > 5 THEN 0.0::DOUBLE WHEN s BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-15' THEN 2.0 ELSE 1.0 END AS w FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-21', INTERVAL 1 DAY) AS t(s))),
 hh AS (SELECT hour, sum(w) OVER (ORDER BY hour) / sum(w) OVER () AS cum FROM (SELECT i AS hour, CASE WHEN i BETWEEN 8 AND 17 THEN 1.0::DOUBLE ELSE 0.0 END AS w FROM generate_series(0, 23) AS t(i)))"""


def _drawn_start(seed: int, key: str) -> str:
    """Microseconds of a start that _PLAN gives the entity ``key`` in SQL."""
    u = lambda label: _u(seed, f"'{label}'", key)
    return f"(epoch_us(CAST((SELECT min(day) FROM dd WHERE cum > {u('day')}) AS TIMESTAMP)) + (SELECT min(hour) FROM hh WHERE cum > {u('hour')}) * 3600000000 + CAST(floor({u('within')} * 3600000000) AS BIGINT))"


@query("calendar_starts", f"WITH {_PLAN} SELECT i AS session, CAST({_drawn_start(11, 'CAST(i AS VARCHAR)')} AS BIGINT) AS start_us FROM generate_series(0, 499) AS t(i)", "")
def _(spark, d):
    return _office(spark).draw(spark.range(500), 11, "id").select(F.col("id").alias("session"), F.unix_micros("start_time").alias("start_us"))


@query("transition_matrix", f"+f AS (SELECT activity_id AS t FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12), b AS (SELECT activity_id AS src, lead(activity_id) OVER {_W} AS dst FROM seq) SELECT src, dst, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS p FROM b JOIN f ON f.t = b.src JOIN f g ON g.t = b.dst GROUP BY 1, 2")
def _(spark, d):
    return Q.transition_matrix(Q.tokens(seq(spark, d), "activity_id"))


@query("sessions_per_learner", "SELECT sessions, count(*) AS n FROM (SELECT learner_id, count(DISTINCT session_id) AS sessions FROM seq GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return A.sessions_per_learner(seq(spark, d))


@query("generate_assembled")
def _(spark, d):
    s = seq(spark, d)
    return A.assemble(G.semi_markov(G.fit(s), 500, seed=11), 500, A.sessions_per_learner(s), _office(spark), seed=11)


@query("generate_markov_3")
def _(spark, d):
    s = seq(spark, d)
    order = G.supported_order(s, 3, backoff=True)
    return G.markov(G.fit(s, order), 500, seed=11, order=order)


def _generated(name: str):
    def run(spark, d):
        return G.GENERATORS[name](G.fit(seq(spark, d)), 500, seed=11)

    return run


for _name in ("independent", "markov", "semi_markov"):
    query(f"generate_{_name}")(_generated(_name))


@query("generate_gru")
def _(spark, d):
    model = G.fit_named("gru", seq(spark, d), {"epochs": 6, "hidden_dim": 32, "embedding_dim": 16})
    return G.sample(model, 500, seed=11)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of either half."""
    s = ses(spark, d)
    b = F.col("learner_id").cast("bigint") % 10 < 3
    return s.filter(~b), s.filter(b)


@query("session_exposure", "+k AS (SELECT path, count(*) AS known FROM ses WHERE side = 'a' GROUP BY 1) SELECT count(*) AS n_sessions, round(avg(CASE WHEN known >= 1 THEN 1.0 ELSE 0 END), 6) AS match_rate, round(avg(CASE WHEN known = 1 THEN 1.0 ELSE 0 END), 6) AS unique_match_rate FROM ses LEFT JOIN k ON k.path = ses.path WHERE side = 'b' AND n_events >= 3")
def _(spark, d):
    return R.session_exposure(*_sides(spark, d))


@query("trajectory_match", "+t AS (SELECT learner_id, any_value(side) AS side, count(*) AS n, string_agg(path, ' | ' ORDER BY start_us, session_id) AS way FROM ses GROUP BY 1) SELECT count(*) AS n_learners, round(avg(CASE WHEN way IN (SELECT way FROM t WHERE side = 'a') THEN 1.0 ELSE 0 END), 6) AS match_rate FROM t WHERE side = 'b' AND n >= 2")
def _(spark, d):
    return R.trajectory_match(*_sides(spark, d))


@query("duration_histogram", "+e AS (SELECT min(duration_s) AS lo, max(duration_s) AS hi FROM ses) SELECT side, CAST(least(29, floor((duration_s - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n FROM ses CROSS JOIN e GROUP BY 1, 2")
def _(spark, d):
    a, b = _sides(spark, d)
    return R.shared_histogram(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))), "duration_s", "side")


@query("unique_sessions", "SELECT session_id FROM ses WHERE path IN (SELECT path FROM ses GROUP BY 1 HAVING count(*) = 1)")
def _(spark, d):
    return R.rarest(ses(spark, d)).select("session_id")


@query("recall_by_kind", "SELECT d.source AS kind, count(*) AS n, round(avg(CASE WHEN d.doc_id % 17 >= 9 THEN 1.0 ELSE 0 END), 6) AS recall FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = d.doc_id GROUP BY 1", "")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("kind"))
    bad = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").select("doc_id")
    return R.recall_by(docs.join(bad, "doc_id", "left_semi"), docs.filter("doc_id % 17 >= 9"), "doc_id", "kind")


@query("unknown_predictions", "SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'de'", "")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang <> 'de'")
    return R.unknown_ids(spark.read.parquet(f"{d}/labels.parquet"), docs, "doc_id")


@query("closest_learner", f"+{_LF}, f AS (SELECT learner_id, CAST(learner_id AS BIGINT) % 10 < 3 AS b, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 5) AS {c}" for c in _LC) + " FROM lf) SELECT z.learner_id, round(sqrt(min(" + " + ".join(f"(z.{c} - f.{c}) * (z.{c} - f.{c})" for c in _LC) + ")), 5) AS distance FROM f z CROSS JOIN f WHERE z.b AND NOT f.b GROUP BY 1")
def _(spark, d):
    """Distances of one half's learners to the closest of all learners of the other, unclipped."""
    z = P.standardize(P.learner_features(ses(spark, d), events(spark, d), _TYPES), "learner_id", clip=None)
    b = F.col("learner_id").cast("bigint") % 10 < 3
    return R.closest(z.filter(b), z.filter(~b), "learner_id")


@query("assigned_profiles")
def _(spark, d):
    return K.fit_clusters(seq(spark, d), 2, _TYPES, seed=7, least=1)[1]


@query("generate_profiles")
def _(spark, d):
    return K.fit_profiles(seq(spark, d), 2, _TYPES, seed=7, least=1).generate(300, seed=3)


@query("scaled_lengths", "+l AS (SELECT n_events AS len, count(*) AS n FROM ses GROUP BY 1) SELECT CAST(greatest(1, round_even(len * 1.5, 0)) AS INTEGER) AS len, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1")
def _(spark, d):
    return G.scale_lengths(G.fit(seq(spark, d))["lengths"], 1.5)


@query("push_later", "+o AS (SELECT session_id, learner_id, start_us, end_us + 86400000000 AS end_us FROM ses), p AS (SELECT *, lag(end_us) OVER (PARTITION BY learner_id ORDER BY start_us, session_id) AS pe FROM o) SELECT session_id, CAST(start_us + sum(CASE WHEN start_us <= pe THEN pe + 1000000 - start_us ELSE 0 END) OVER (PARTITION BY learner_id ORDER BY start_us, session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_us FROM p")
def _(spark, d):
    s = ses(spark, d).select("session_id", "learner_id", F.unix_micros("start_time").alias("start_us"), (F.unix_micros("end_time") + F.lit(86_400_000_000)).alias("end_us"))
    return G.push_later(s).select("session_id", F.col("start_us").cast("bigint").alias("start_us"))


_MAP = I.Mapping({"learner_id": I.Spec("user_id", hash_salt="s"), "timestamp": I.Spec("at", format="%Y-%m-%d %H:%M:%S", timezone="UTC"), "activity_id": I.Spec("thing"), "event_type": I.Spec("event_type"), "event_id": I.Spec("event_id"), "score": I.Spec("value")}, metadata=("props",))


def _raw(spark, d):
    """The clickstream as raw text with faults: every 50th time is unreadable, every 70th type missing, every 90th id repeated."""
    t = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    at = F.when(i % 50 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return t.select(i.alias("__row"), F.when(i % 90 == 0, i + 1).otherwise(i).cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), at.alias("at"), F.lit("thing").alias("thing"), F.when(i % 70 == 0, " ").otherwise(F.col("event_type")).alias("event_type"), "value", "props")


@query("ingest_report", None)
def _(spark, d):
    return I.ingest(_raw(spark, d), _MAP)[1]


@query("ingest_events")
def _(spark, d):
    return I.ingest(_raw(spark, d), _MAP)[0].select("event_id", "learner_id", F.unix_micros("timestamp").alias("us"), "event_type")


_RAW = "r AS (SELECT event_id AS n, CAST(CASE WHEN event_id % 90 = 0 THEN event_id + 1 ELSE event_id END AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, ts, event_id % 50 = 0 AS bad_t, event_id % 70 = 0 AS bad_e FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n) AS d FROM r WHERE NOT bad_t AND NOT bad_e)"
ORACLE_SQL["ingest_report"] = f"WITH {_RAW}, o AS (SELECT date_trunc('second', ts) < max(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM k WHERE d = 1), u AS (SELECT 'timestamp:invalid_timestamp' AS reason, count(*) AS n FROM r WHERE bad_t UNION ALL SELECT 'event_type:missing_required', count(*) FROM r WHERE bad_e UNION ALL SELECT 'duplicate_event_id', count(*) FROM k WHERE d > 1 UNION ALL SELECT 'out_of_order', count(*) FROM o WHERE late UNION ALL SELECT 'rows_read', count(*) FROM r UNION ALL SELECT 'rows_kept', count(*) FROM k WHERE d = 1 UNION ALL SELECT 'naive_timezone', count(*) FROM k WHERE d = 1) SELECT * FROM u WHERE n > 0"


@query("integrity", "+f AS (SELECT CASE WHEN CAST(event_id AS BIGINT) % 97 = 0 THEN '0' ELSE event_id END AS event_id, learner_id, session_id FROM seq), w AS (SELECT *, CAST(split_part(session_id, ':s', 2) AS BIGINT) % 5 AS k FROM ses) SELECT 'duplicate_event_id' AS rule, CAST((SELECT count(*) FROM (SELECT 1 FROM f GROUP BY event_id HAVING count(*) > 1)) AS BIGINT) AS n UNION ALL SELECT 'duplicate_session_id', 0 UNION ALL SELECT 'negative_duration', count(CASE WHEN k = 1 AND end_us - 3600000000 < start_us THEN 1 END) FROM w UNION ALL SELECT 'wrong_duration', count(CASE WHEN k = 1 THEN 1 END) FROM w UNION ALL SELECT 'empty_sequence', count(CASE WHEN k = 2 THEN 1 END) FROM w UNION ALL SELECT 'unknown_session', count(CASE WHEN k = 4 THEN 1 END) FROM w UNION ALL SELECT 'wrong_n_events', count(CASE WHEN k = 3 THEN 1 END) FROM w UNION ALL SELECT 'wrong_learner', count(CASE WHEN k = 0 THEN 1 END) FROM w")
def _(spark, d):
    """Faults put in by number: one id for every 97th event; ends, tokens, sizes and learners of some sessions wrong, others left out."""
    s = seq(spark, d)
    held = S.sessions(s).withColumn("k", F.substring_index("session_id", ":s", -1).cast("bigint") % 5)
    wrong = held.withColumn("end_time", F.when(F.col("k") == 1, F.col("end_time") - F.expr("interval 1 hour")).otherwise(F.col("end_time"))).withColumn("event_sequence", F.when(F.col("k") == 2, F.array().cast("array<string>")).otherwise(F.col("event_sequence")))
    wrong = wrong.withColumn("n_events", F.when(F.col("k") == 3, F.col("n_events") + 1).otherwise(F.col("n_events"))).withColumn("learner_id", F.when(F.col("k") == 0, F.lit("nobody")).otherwise(F.col("learner_id"))).filter("k <> 4")
    broken = s.withColumn("event_id", F.when(F.col("event_id").cast("bigint") % 97 == 0, "0").otherwise(F.col("event_id")))
    return spark.createDataFrame(sorted(log.check(broken, wrong).items()), "rule string, n bigint")


_HEX = "CAST(('0x' || substr(sha256('{\"event_id\":\"' || event_id || '\",\"event_type\":\"' || event_type || '\",\"learner_id\":\"' || learner_id || '\"}'), 1, 12)) AS BIGINT)"


@query("fingerprint", f"SELECT count(*) AS n_rows, CAST(sum({_HEX}) AS BIGINT) AS hash_sum, bit_xor({_HEX}) AS hash_xor FROM ev")
def _(spark, d):
    return log.fingerprint(events(spark, d).select("event_id", "learner_id", "event_type"))


@query("remap_ids", f"+l AS (SELECT DISTINCT learner_id FROM ev) SELECT learner_id, 'L' || lpad(CAST(row_number() OVER (ORDER BY {_u(13, chr(39) + 'remap' + chr(39), 'learner_id')}, learner_id) AS VARCHAR), 6, '0') AS new_id FROM l")
def _(spark, d):
    return I.remap_ids(events(spark, d), 13)


@query("normalized_types", "SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'other' END AS event_type, count(*) AS n FROM ev GROUP BY 1")
def _(spark, d):
    return I.normalize_types(events(spark, d), log.KNOWN_TYPES, "other").groupBy("event_type").agg(F.count("*").alias("n"))
