"""Queries of generators, injected anomalies, annotations and comparisons, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.operators import annotations as N
from tidemark.operators import compare as X
from tidemark.operators import controls as L
from tidemark.operators import generate as G
from tidemark.operators import injection as J
from tidemark.operators import profile as P
from tidemark.operators import sequences as Q
from tidemark.operators import validation as V
from tidemark.plans import queries as B
from tidemark.plans.queries import ORACLE_SQL, _u, query

#: Sessions that are generated, and their seed.
SESSIONS, SEED = 500, 11
_LEN = "lt AS (SELECT len, sum(n) OVER (ORDER BY len) / sum(n) OVER () AS cum FROM (SELECT n_events AS len, count(*) AS n FROM ses GROUP BY 1))"
_SK = f"sk AS (SELECT i, (SELECT min(len) FROM lt WHERE cum > {_u(SEED, chr(39) + 'length' + chr(39), 'CAST(i AS VARCHAR)')}) AS len FROM generate_series(0, {SESSIONS - 1}) AS t(i))"
_TK = "tk AS (SELECT token, sum(n) OVER (ORDER BY token) / sum(n) OVER () AS cum FROM (SELECT token, count(*) AS n FROM seq GROUP BY 1))"
_NAME = "'S' || lpad(CAST(i AS VARCHAR), 6, '0')"


def _chain(order: int) -> str:
    """CTEs up to ``path``(session_id, pos, token): a chain that falls back to shorter contexts, and to none."""
    w = "(PARTITION BY session_id ORDER BY ts, event_id)"
    every = []
    for k in range(1, order + 1):
        pads = " || chr(31) || ".join(f"coalesce(lag(token, {j}) OVER {w}, '<start>')" for j in range(k, 0, -1))
        every.append(f"SELECT {pads} AS context, token FROM seq")
    tc = f"tc AS (SELECT context, token, sum(n) OVER (PARTITION BY context ORDER BY token) / sum(n) OVER (PARTITION BY context) AS cum FROM (SELECT context, token, count(*) AS n FROM ({' UNION ALL '.join(every)}) GROUP BY 1, 2))"
    u = _u(SEED, "'token'", "CAST(i AS VARCHAR)", "CAST(pos + 1 AS VARCHAR)")
    joins = "".join(f" LEFT JOIN tc t{k} ON t{k}.context = array_to_string(list_slice(path, -{k}, -1), chr(31)) AND t{k}.cum > u" for k in range(order, 0, -1))
    chosen = ", ".join(f"arg_min(t{k}.token, t{k}.cum)" for k in range(order, 0, -1))
    walk = f"walk AS (SELECT i, len, CAST(0 AS BIGINT) AS pos, list_value({', '.join(['$S$'] * order)}) AS path FROM sk UNION ALL SELECT i, any_value(len), any_value(pos) + 1, list_append(any_value(path), coalesce({chosen}, arg_min(tk.token, tk.cum))) FROM (SELECT *, {u} AS u FROM walk WHERE pos < len){joins} LEFT JOIN tk ON tk.cum > u GROUP BY i)".replace("$S$", "'<start>'")
    return f"{_LEN}, {_SK}, {_TK}, {tc}, {walk}, path AS (SELECT {_NAME} AS session_id, pos, path[-1] AS token FROM walk WHERE pos > 0)"


_RECURSIVE = B._BASE.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE_SQL["generate_independent"] = f"{B._BASE}, {_LEN}, {_SK}, {_TK} SELECT {_NAME} AS session_id, CAST(pos AS INTEGER) AS pos, (SELECT arg_min(token, cum) FROM tk WHERE cum > {_u(SEED, chr(39) + 'token' + chr(39), 'CAST(i AS VARCHAR)', 'CAST(pos AS VARCHAR)')}) AS token FROM (SELECT i, unnest(generate_series(1, len)) AS pos FROM sk)"
ORACLE_SQL["generate_markov"] = f"{_RECURSIVE}, {_chain(1)} SELECT session_id, CAST(pos AS INTEGER) AS pos, token FROM path"
ORACLE_SQL["generate_markov_3"] = f"{_RECURSIVE}, {_chain(3)} SELECT session_id, CAST(pos AS INTEGER) AS pos, token FROM path"
_POINTS = "gp AS (SELECT token, (lead(us) OVER (PARTITION BY session_id ORDER BY ts, event_id) - us) / 1e6 AS x FROM seq), pl AS (SELECT token, list(x ORDER BY x) AS l FROM (SELECT token, x FROM gp UNION ALL SELECT '*', x FROM gp) WHERE x IS NOT NULL GROUP BY 1), pt AS (SELECT token, CASE WHEN len(l) <= 1000 THEN l ELSE list_transform(range(0, 1000), lambda i: l[1 + CAST(round_even(i * ((len(l) - 1) / 999.0::DOUBLE), 0) AS BIGINT)]) END AS p FROM pl)"
_GAP_U = _u(SEED, "'gap'", "'point'", "path.session_id", "CAST(pos AS VARCHAR)")
ORACLE_SQL["generate_semi_markov"] = f"{_RECURSIVE}, {_chain(1)}, {_POINTS}, dr AS (SELECT session_id, pos, path.token, greatest(0.001, coalesce(p[1 + CAST(floor({_GAP_U} * len(p)) AS BIGINT)], 60.0)) AS g FROM path LEFT JOIN pt ON pt.token = CASE WHEN path.token IN (SELECT token FROM pt) THEN path.token ELSE '*' END) SELECT session_id, CAST(pos AS INTEGER) AS pos, token, round(coalesce(sum(g) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS at_s FROM dr"

_SPELL = "string_agg(CASE token WHEN 'click' THEN 'a' WHEN 'error' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'signup' THEN 'd' ELSE 'e' END, '' ORDER BY ts, event_id)"
ORACLE_SQL["metric_nn_distance_p05"] = f"{B._BASE}, sp AS (SELECT session_id, any_value(side) AS side, {_SPELL} AS t FROM seq GROUP BY 1), a AS (SELECT DISTINCT t FROM (SELECT t FROM sp WHERE side = 'a' ORDER BY {_u(1, chr(39) + 'real' + chr(39), 'session_id')}, session_id LIMIT 1000)), b AS (SELECT session_id, t FROM sp WHERE side = 'b' ORDER BY {_u(1, chr(39) + 'synthetic' + chr(39), 'session_id')}, session_id LIMIT 200) SELECT round(quantile_cont(d, 0.05), 6) AS value FROM (SELECT b.session_id, min(levenshtein(a.t, b.t) / CAST(greatest(length(a.t), length(b.t)) AS DOUBLE)) AS d FROM b CROSS JOIN a GROUP BY 1)"

_PADS = [bytes(x ^ p for x in b"s".ljust(64, b"\0")).hex().upper() for p in (0x36, 0x5C)]
_HMAC = f"'h_' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(user_id)))), 1, 32)"
ORACLE_SQL["ingest_events"] = f"WITH {B._RAW} SELECT event_id, {_HMAC} AS learner_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS us, event_type FROM k WHERE d = 1"
assert hashlib.sha256  # the SQL above is HMAC-SHA256 written out


def _families(family: str, a: str, b: str) -> str:
    return f"+{B._GAPS}, w AS (SELECT token, gap_s AS x FROM gp UNION ALL SELECT '*', gap_s FROM gp) SELECT token, count(*) AS n, round({a}, 6) AS a, round({b}, 6) AS b FROM w WHERE x IS NOT NULL GROUP BY 1"


_FAMILIES = {
    "lognormal": ("avg(CASE WHEN x > 0 THEN ln(x) END)", "stddev_pop(CASE WHEN x > 0 THEN ln(x) END)"),
    "gamma": ("avg(x) * avg(x) / var_pop(x)", "var_pop(x) / avg(x)"),
    "exponential": ("avg(x)", "CAST(NULL AS DOUBLE)"),
    "constant": ("median(x)", "CAST(NULL AS DOUBLE)"),
}


def _gap_query(family: str):
    def run(spark, d):
        made = G.fit_gaps(B.seq(spark, d), family)
        return made.select(F.coalesce("token", F.lit("*")).alias("token"), "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))

    return run


for _family, (_a, _b) in _FAMILIES.items():
    query(f"gaps_{_family}", _families(_family, _a, _b))(_gap_query(_family))


@query("gaps_empirical", f"+{_POINTS} SELECT token, len(p) AS n_points, round(list_sum(p), 3) AS total, round(p[1], 6) AS lowest, round(p[-1], 6) AS highest FROM pt")
def _(spark, d):
    made = G.fit_gaps(B.seq(spark, d))
    total = F.aggregate("points", F.lit(0.0), lambda t, x: t + x)
    return made.select(F.coalesce("token", F.lit("*")).alias("token"), F.size("points").cast("bigint").alias("n_points"), F.round(total, 3).alias("total"), F.round(F.get("points", F.lit(0)), 6).alias("lowest"), F.round(F.element_at("points", -1), 6).alias("highest"))


@query("lengths_poisson", "+m AS (SELECT avg(n_events) - 1 AS r FROM ses) SELECT k + 1 AS len, round(exp(k * ln(r) - r - lgamma(k + 1)), 9) AS weight FROM m CROSS JOIN generate_series(0, 9) AS t(k)")
def _(spark, d):
    return G.fit_lengths(B.seq(spark, d), "poisson").filter("len <= 10").select("len", F.round("n", 9).alias("weight"))


@query("controlled_lengths", "SELECT CAST(greatest(1, round_even(n_events * 1.5, 0)) AS BIGINT) AS len, count(*) AS n FROM ses GROUP BY 1")
def _(spark, d):
    return L.apply(G.fit_named("markov", B.seq(spark, d)), {"session_length": {"scale": 1.5}})["lengths"]


@query("controlled_tokens", "SELECT token, CAST(count(*) * CASE token WHEN 'view' THEN 2 ELSE 1 END AS DOUBLE) AS n FROM seq WHERE token <> 'error' GROUP BY 1")
def _(spark, d):
    return L.apply(G.fit_named("markov", B.seq(spark, d)), {"event_weights": {"view": 2, "error": 0}})["tokens"].select("token", F.col("n").cast("double").alias("n"))


#: Two kinds of anomalies, of which the first needs three events.
_SPECS = [{"type": "abnormal_timing", "rate": 0.05, "factor": 0.1, "min_events": 3}, {"type": "inactivity", "rate": 0.05, "gap_s": 7200}]
_POOL = f"pool AS (SELECT session_id, n_events, row_number() OVER (ORDER BY {_u(7, chr(39) + 'anomaly' + chr(39), 'session_id')}, session_id) AS rank FROM ses), qt AS (SELECT CAST(round_even(count(*) * 0.05, 0) AS BIGINT) AS q, count(*) AS n FROM pool), one AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM pool WHERE n_events >= 3), c1 AS (SELECT session_id, rank FROM one WHERE k <= (SELECT q FROM qt)), e1 AS (SELECT CASE WHEN (SELECT count(*) FROM c1) < q THEN n ELSE (SELECT max(rank) FROM c1) END AS stop FROM qt), two AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM pool WHERE n_events >= 2 AND rank > (SELECT stop FROM e1)), c2 AS (SELECT session_id FROM two WHERE k <= (SELECT q FROM qt))"


@query("injected_sessions", f"+{_POOL} SELECT session_id, 'abnormal_timing' AS kind FROM c1 UNION ALL SELECT session_id, 'inactivity' FROM c2")
def _(spark, d):
    s = B.seq(spark, d)
    wanted = J.requests(_SPECS)
    chosen, _ = J.choose(s, wanted, J.context_of(s), 7)
    return chosen.select("session_id", F.get(F.array(*(F.lit(r.kind) for r in wanted)), F.col("request")).alias("kind"))


@query("injected_annotations", f"+{_POOL} SELECT 'session' AS level, 'abnormal_timing' AS type, 'unusual_valid' AS category, count(*) AS n FROM c1 UNION ALL SELECT 'session', 'inactivity', 'unusual_valid', count(*) FROM c2 UNION ALL SELECT 'event', 'abnormal_timing', 'unusual_valid', CAST(sum(n_events - 1) AS BIGINT) FROM c1 JOIN ses USING (session_id) UNION ALL SELECT 'event', 'inactivity', 'unusual_valid', count(*) FROM c2")
def _(spark, d):
    _, truth, _ = J.inject(B.seq(spark, d), _SPECS, seed=7)
    return N.summary(truth)


@query("injected_events", "SELECT count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, count(DISTINCT learner_id) AS n_learners, 0::BIGINT AS n_overlaps FROM seq")
def _(spark, d):
    """What an injection that adds no event leaves as it was, and that no two sessions of a learner overlap."""
    from pyspark.sql import Window

    events, _, _ = J.inject(B.seq(spark, d), _SPECS, seed=7)
    spans = events.groupBy("learner_id", "session_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"), F.count("*").alias("n"))
    later = spans.withColumn("over", F.col("a") <= F.lag("z").over(Window.partitionBy("learner_id").orderBy("a", "session_id")))
    return later.agg(F.sum("n").alias("n_events"), F.count("*").alias("n_sessions"), F.count_distinct("learner_id").alias("n_learners"), F.coalesce(F.sum(F.col("over").cast("bigint")), F.lit(0)).alias("n_overlaps"))


_OWN = f"{B._PICK.replace('0.1', '0.05').replace(_u(7, chr(39) + 'anomaly' + chr(39), 'session_id'), _u(9, chr(39) + 'anomaly' + chr(39), 'session_id'))}, z AS (SELECT s.*, q.n_events, {B._POS} FROM seq s JOIN q ON q.session_id = s.session_id), o AS (SELECT session_id, list_sort(list(DISTINCT token)) AS own FROM z GROUP BY 1), v AS (SELECT list_sort(list(DISTINCT token)) AS every FROM seq), f AS (SELECT session_id, CASE WHEN len(own) >= 2 THEN own ELSE every END AS pool FROM o CROSS JOIN v), g AS (SELECT session_id, pool, pool[1 + CAST(floor({_u(5, chr(39) + 'first' + chr(39), 'session_id')} * len(pool)) AS BIGINT)] AS a FROM f), h AS (SELECT session_id, a, list_filter(pool, lambda x: x <> a) AS rest FROM g), ab AS (SELECT session_id, a, rest[1 + CAST(floor({_u(5, chr(39) + 'second' + chr(39), 'session_id')} * len(rest)) AS BIGINT)] AS b FROM h)"


@query("anomaly_repetition", f"+{_OWN} SELECT z.session_id, token, CAST(us + CASE WHEN r > p THEN 12 * 5000000 ELSE 0 END AS BIGINT) AS new_us, false AS inserted FROM z UNION ALL SELECT z.session_id, CASE WHEN k % 2 = 1 THEN a ELSE b END, CAST(us + k * 5000000 AS BIGINT), true FROM z JOIN ab ON ab.session_id = z.session_id CROSS JOIN generate_series(1, 12) AS t(k) WHERE r = p")
def _(spark, d):
    """Two tokens of the session, or of the vocabulary where it has one, to and fro after a drawn event."""
    s = B.seq(spark, d)
    chosen = G.anomaly_quota(s, 0.05, 9)
    own = s.join(chosen, "session_id").groupBy("session_id").agg(F.array_sort(F.collect_set("token")).alias("own"))
    rows = s.join(chosen, "session_id").join(own, "session_id")
    kind = J.ANOMALIES["repetition"]
    made = kind.rewrite(rows, dict(kind.defaults), J.context_of(s), 5)
    return made.select("session_id", "token", F.col("__us").cast("bigint").alias("new_us"), F.col("__affected").alias("inserted"))


def _flags(spark, d):
    """Labelled documents as annotations: those of bad quality are anomalies, of two kinds."""
    t = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").select(F.col("doc_id").cast("string").alias("id"), "toxic").dropDuplicates(["id"])
    toxic = F.col("toxic") == 1
    return N.rows(t, "event", "anomaly", F.when(toxic, "toxic").otherwise("poor"), category=F.when(toxic, "invalid_workflow").otherwise("unusual_valid"))


_FLAGS = "f AS (SELECT doc_id, any_value(toxic) AS toxic FROM labels WHERE quality = 0 GROUP BY doc_id)"


@query("annotation_summary", f"WITH {_FLAGS} SELECT 'event' AS level, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS type, CASE WHEN toxic = 1 THEN 'invalid_workflow' ELSE 'unusual_valid' END AS category, count(*) AS n FROM f GROUP BY 1, 2, 3", "")
def _(spark, d):
    return N.summary(_flags(spark, d))


@query("annotation_filter", f"WITH {_FLAGS} SELECT CAST(doc_id AS VARCHAR) AS id FROM f WHERE toxic = 1", "")
def _(spark, d):
    return N.anomalous_ids(_flags(spark, d), "event", kind="toxic", category="invalid_workflow")


@query("annotation_remap", f"WITH {_FLAGS} SELECT 'event' AS level, 'd' || CAST(doc_id AS VARCHAR) AS id FROM f", "")
def _(spark, d):
    to = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("old"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("new"))
    return N.remap(_flags(spark, d), {"event": to}).select("level", "id")


@query("annotation_unknown", f"WITH {_FLAGS} SELECT CAST(doc_id AS VARCHAR) AS id FROM f WHERE doc_id % 3 = 0", "")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("event_id"), F.lit("l").alias("learner_id"), F.lit(None).cast("string").alias("session_id"))
    return N.unknown(_flags(spark, d), docs).select("id")


@query("predecessors", "+f AS (SELECT token, coalesce(lag(token) OVER (PARTITION BY session_id ORDER BY ts, event_id), '<start>') AS label FROM seq) " + B._ranked("SELECT token, label, count(*) AS n FROM f GROUP BY 1, 2", 5, "token"))
def _(spark, d):
    return Q.predecessors(B.seq(spark, d))


def _two(group: str, key: str, table: str) -> str:
    return f"SELECT {key} AS key, na / ta AS share_a, nb / tb AS share_b FROM (SELECT *, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM (SELECT {group} AS key, CAST(count(CASE WHEN side = 'a' THEN 1 END) AS DOUBLE) AS na, CAST(count(CASE WHEN side = 'b' THEN 1 END) AS DOUBLE) AS nb FROM {table} GROUP BY 1))"


_SHARES = "SELECT key, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(share_b - share_a, 6) AS gap FROM ({0})"


@query("compare_lengths", _SHARES.format(_two("CASE WHEN n_events >= 30 THEN '30+' ELSE CAST(n_events AS VARCHAR) END", "key", "ses")))
def _(spark, d):
    return X.lengths(B.halves(spark, d))


@query("compare_hours", _SHARES.format("SELECT CAST(i AS VARCHAR) AS key, coalesce(share_a, 0) AS share_a, coalesce(share_b, 0) AS share_b FROM generate_series(0, 23) AS t(i) LEFT JOIN (" + _two("hour(start_ts)", "key", "ses") + ") x ON x.key = i"))
def _(spark, d):
    return X.hours(B.halves(spark, d))


@query("compare_weekdays", _SHARES.format("SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][i] AS key, coalesce(share_a, 0) AS share_a, coalesce(share_b, 0) AS share_b FROM generate_series(1, 7) AS t(i) LEFT JOIN (" + _two("isodow(start_ts)", "key", "ses") + ") x ON x.key = i"))
def _(spark, d):
    return X.weekdays(B.halves(spark, d))


@query("compare_tokens", f"+{B._GAPS}, m AS (SELECT token, round(median(CASE WHEN side = 'a' THEN gap_s END), 4) AS dwell_a, round(median(CASE WHEN side = 'b' THEN gap_s END), 4) AS dwell_b FROM gp GROUP BY 1) SELECT s.*, m.dwell_a, m.dwell_b FROM (" + _SHARES.format(_two("token", "key", "seq")) + ") s LEFT JOIN m ON m.token = s.key")
def _(spark, d):
    return X.tokens(B.halves(spark, d))


@query("compare_transitions", f"+{B._grams(2)}, x AS (" + _two("ngram", "key", "(SELECT * FROM g WHERE ngram IS NOT NULL)") + ") SELECT key, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(share_b - share_a, 6) AS gap FROM x ORDER BY abs(round(share_b - share_a, 12)) DESC, key LIMIT 10")
def _(spark, d):
    return X.transitions(B.halves(spark, d), 10)


@query("compare_groups", "+t AS (SELECT course_id AS label, side, event_type, CAST(count(*) AS DOUBLE) AS n FROM seq GROUP BY 1, 2, 3), p AS (SELECT label, event_type, sum(CASE WHEN side = 'a' THEN n ELSE 0 END) AS na, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS nb FROM t GROUP BY 1, 2), v AS (SELECT label, round(sum(abs(na / ta - nb / tb)) / 2, 6) AS event_type_tvd FROM (SELECT *, sum(na) OVER (PARTITION BY label) AS ta, sum(nb) OVER (PARTITION BY label) AS tb FROM p) GROUP BY 1), s AS (SELECT course_id AS label, count(CASE WHEN side = 'a' THEN 1 END) AS sessions_a, count(CASE WHEN side = 'b' THEN 1 END) AS sessions_b FROM ses GROUP BY 1) SELECT s.*, v.event_type_tvd FROM s JOIN v ON v.label = s.label")
def _(spark, d):
    s = B.halves(spark, d).withColumn("label", F.col("course_id"))
    return X.groups(s).select("label", "sessions_a", "sessions_b", "event_type_tvd")


_MIX = "t AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, 'events' AS what FROM ev UNION ALL SELECT isodow(start_ts) - 1, hour(start_ts), 'sessions' FROM ses)"


@query("temporal_hours", f"+{_MIX} SELECT CAST(i AS INTEGER) AS hour, count(CASE WHEN what = 'events' THEN 1 END) AS n_events, count(CASE WHEN what = 'sessions' THEN 1 END) AS n_sessions FROM generate_series(0, 23) AS g(i) LEFT JOIN t ON t.hour = i GROUP BY 1")
def _(spark, d):
    return P.by_clock(B.events(spark, d), B.ses(spark, d), "hour")


@query("temporal_weekdays", f"+{_MIX} SELECT CAST(i AS INTEGER) AS weekday, count(CASE WHEN what = 'events' THEN 1 END) AS n_events, count(CASE WHEN what = 'sessions' THEN 1 END) AS n_sessions FROM generate_series(0, 6) AS g(i) LEFT JOIN t ON t.weekday = i GROUP BY 1")
def _(spark, d):
    return P.by_clock(B.events(spark, d), B.ses(spark, d), "weekday")


@query("temporal_days", "SELECT CAST(CAST(start_ts AS DATE) AS VARCHAR) AS day, count(*) AS n_sessions FROM ses GROUP BY 1")
def _(spark, d):
    return P.daily(B.ses(spark, d)).select(F.col("day").cast("string").alias("day"), "n_sessions")


@query("peak_hour", "SELECT CAST(arg_min(h, -n * 100 + h) AS INTEGER) AS peak_hour FROM (SELECT hour(ts) AS h, count(*) AS n FROM ev GROUP BY 1)")
def _(spark, d):
    return P.peak_hour(P.by_clock(B.events(spark, d), B.ses(spark, d), "hour"))


@query("group_bigrams", f"+b AS (SELECT course_id AS label, token || ' -> ' || lead(token) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS bigram FROM seq), c AS (SELECT label, bigram, count(*) AS n FROM b WHERE bigram IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY n DESC, bigram) AS rank FROM c) SELECT label, bigram, n, round(n / total, 6) AS share, rank FROM r WHERE rank <= 5")
def _(spark, d):
    return P.top_bigrams(B.seq(spark, d).withColumn("label", F.col("course_id")))


@query("group_durations", f"SELECT course_id AS label, {B._describe('duration_s')} FROM ses GROUP BY 1")
def _(spark, d):
    return P.describe(B.ses(spark, d).withColumn("label", F.col("course_id")), "duration_s", "label")


@query("omitted_groups", "SELECT CAST(learner_id AS VARCHAR) AS label, count(*) AS n_sessions FROM ses GROUP BY 1 HAVING count(*) < 30")
def _(spark, d):
    return P.omitted(B.ses(spark, d).withColumn("label", F.col("learner_id")), 30)


@query("metadata_groups", "+m AS (SELECT session_id, json_extract_string(props, '$.k') AS k, count(*) AS n, min((s.ts, s.event_id)) AS first FROM seq s JOIN events e ON CAST(e.event_id AS VARCHAR) = s.event_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS x FROM m WHERE k IS NOT NULL) SELECT k AS label, count(*) AS n_sessions FROM r WHERE x = 1 GROUP BY 1")
def _(spark, d):
    """Sessions by the commonest value of a metadata key, the first seen on ties."""
    s = B.seq(spark, d).withColumn("metadata", F.create_map(F.lit("k"), F.substring("activity_id", 2, 20)))
    return P.metadata_label(s, "k").groupBy("label").agg(F.count("*").alias("n_sessions"))


@query("transition_scores", f"+{B._trans(1)}, tr AS (SELECT context, token, count(*) AS n FROM c WHERE side = 'a' GROUP BY 1, 2), tt AS (SELECT context, sum(n) AS n FROM tr GROUP BY 1), v AS (SELECT count(DISTINCT token) + 1 AS v FROM tr), y AS (SELECT session_id, coalesce(lag(token) OVER (PARTITION BY session_id ORDER BY ts, event_id), '<start>') AS context, token FROM seq WHERE side = 'b') SELECT session_id, round(avg(-ln((coalesce(tr.n, 0) + 1) / (coalesce(tt.n, 0) + v))), 6) AS score FROM y CROSS JOIN v LEFT JOIN tr ON tr.context = y.context AND tr.token = y.token LEFT JOIN tt ON tt.context = y.context GROUP BY 1")
def _(spark, d):
    s = B.halves(spark, d)
    return Q.transition_scores(s.filter("side = 'a'"), s.filter("side = 'b'"))


@query("top_types", "+f AS (SELECT activity_id AS label, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, label LIMIT 20) SELECT label, n, round(n / (SELECT count(*) FROM ev), 6) AS share FROM f")
def _(spark, d):
    return P.top_shares(B.events(spark, d), "activity_id")


@query("gap_histogram", f"+{B._GAPS}, x AS (SELECT greatest(gap_s, 0.001) AS x FROM gp WHERE gap_s IS NOT NULL), e AS (SELECT log10(min(x)) AS lo, log10(max(x)) AS hi FROM x) SELECT CAST(least(39, floor((log10(x) - lo) / (hi - lo) * 40)) AS INTEGER) AS bin, count(*) AS n FROM x CROSS JOIN e GROUP BY 1")
def _(spark, d):
    return P.log_histogram(P.gaps(B.seq(spark, d)), "gap_s")


@query("detection_by_annotation", f"WITH {_FLAGS}, s AS (SELECT doc_id, doc_id % 17 / 17.0 >= 0.5 AS hit FROM documents) SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS kind, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS recall FROM f JOIN s USING (doc_id) GROUP BY 1", "")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    log_ = docs.select(F.col("doc_id").cast("string").alias("event_id"), F.lit("l").alias("learner_id"), F.lit(None).cast("string").alias("session_id"))
    scores = docs.select(F.col("doc_id").cast("string").alias("id"), ((F.col("doc_id") % 17) / 17.0).alias("score"))
    known = _flags(spark, d).join(docs.select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi").select(*N.COLUMNS)
    return V.evaluate(log_, known, scores, level="event")["by_type"].select("kind", "n", "recall")
