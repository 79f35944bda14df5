"""The registered queries of this subpackage: operators with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, contamination, lmscore, neardup, pii, quality, reputation, sharding, storage, tokenshards, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lmscore.score(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_backed_off", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_path(spark, "token-shards")
    tokenshards.write(_table(spark, sf_dir, "documents"), folder, path=VOCABULARY, pattern=tokenshards.POSSESSIVE, key=b"training order 1")
    return tokenshards.read(spark, folder, packed=True)


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.by_bytes(_table(spark, sf_dir, "documents"), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return reputation.judge(_table(spark, sf_dir, "pages"), outcomes)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("error")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_occurrences(docs, _table(spark, sf_dir, "benchmark")).drop("text")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), contamination.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.size("pii_kinds").cast("bigint").alias("n_values"), F.concat_ws(",", "pii_kinds").alias("kinds"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scores, op2_byte_bpe, op3_quality_rules, op4_token_shards, op5_byte_shards, op6_url_reputation, op7_near_duplicates, op8_warc_segments, op9_decontamination, op10_pii_pseudonyms)
}

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
 p AS (SELECT doc_id, i, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u), c1 AS (SELECT t, count(*) AS n FROM u GROUP BY t), m1 AS (SELECT doc_id, t, count(*) AS n FROM u GROUP BY doc_id, t),
 c2 AS (SELECT b, t, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, t), m2 AS (SELECT doc_id, b, t, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY doc_id, b, t),
 o1 AS (SELECT m1.doc_id, m1.t, c1.n - m1.n AS n FROM m1 JOIN c1 USING (t)), o2 AS (SELECT m2.doc_id, m2.b, m2.t, c2.n - m2.n AS n FROM m2 JOIN c2 USING (b, t)),
 z AS (SELECT doc_id, greatest(1, (SELECT count(*) FROM u) - len(w)) AS size FROM d),
 s AS (SELECT p.doc_id, p.b, o2.n AS n2, cx.n AS nc, ln((CASE WHEN own.n > 0 THEN own.n ELSE 0.4 END) / z.size) AS one FROM p JOIN z USING (doc_id) JOIN o1 own ON own.doc_id = p.doc_id AND own.t = p.t
  LEFT JOIN o1 cx ON cx.doc_id = p.doc_id AND cx.t = p.b LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.b = p.b AND o2.t = p.t),
 g AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN b IS NOT NULL AND n2 = 0 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN b IS NULL THEN one WHEN n2 > 0 THEN ln(n2 / greatest(1.0, nc)) ELSE ln(0.4) + one END) AS v FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n_words, CAST(coalesce(g.k, 0) AS BIGINT) AS n_backed_off, round(coalesce(v, 0), 6) AS log_score, round(coalesce(v / g.n, 0), 6) AS mean_log_score FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

#: Fixed rounds stand for the operator's stop; both end at the same sixth digit.
_OP3 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, list_slice(w, i, i + 4) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
 m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[!?]')) AS n_marks FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
 s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [100 * n_symbols / nullif(word_chars, 0), 100 * n_dup_lines / nullif(n_lines, 0), 100 * n_repeat_words / nullif(n_words, 0), abs(word_chars / nullif(n_words, 0) - 6), 100 * n_upper / nullif(word_chars, 0), 100 * n_marks / nullif(n_words, 0)] AS q FROM m),
 v AS (SELECT *, list_transform(range(1, 7), lambda j: CASE WHEN q[j] <= [1, 5, 2, 3, 10, 2][j] THEN 1 WHEN q[j] >= [5, 30, 10, 6, 30, 20][j] THEN -1 ELSE 0 END) AS votes FROM s),
 p AS (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes),
 em AS (SELECT 0 AS round, votes, n, (len(list_filter(votes, lambda x: x = 1)) + 0.5::DOUBLE) / (len(list_filter(votes, lambda x: x = 1)) + 3 * len(list_filter(votes, lambda x: x = -1)) + 1) AS post FROM p
  UNION ALL SELECT any_value(round) + 1, votes, any_value(n), 1 / (1 + exp(any_value(ln((bad + 1) / (good + 1))) + sum(ln((b + 1) / (bad + 3)) - ln((a + 1) / (good + 3))))) FROM
   (SELECT *, sum(n * post) OVER (PARTITION BY j, x) AS a, sum(n * (1 - post)) OVER (PARTITION BY j, x) AS b, sum(n * post) OVER (PARTITION BY j) AS good, sum(n * (1 - post)) OVER (PARTITION BY j) AS bad
    FROM (SELECT round, votes, n, post, unnest(votes) AS x, generate_subscripts(votes, 1) AS j FROM em WHERE round < 100)) GROUP BY votes)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND post >= 0.5 AS kept, round(post, 6) AS posterior FROM v JOIN em ON em.votes = v.votes AND em.round = 100"""

#: The checksum is taken by half bytes, the low one first, from a table made by its rule.
_OP5 = r"""WITH k AS (SELECT list(list_reduce(list_concat([i], range(4)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(16) r(i)),
 d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(coalesce(text, '')) AS h FROM documents),
 b AS (SELECT doc_id, size, list_transform(string_split(h, ''), lambda x: CAST(instr('0123456789ABCDEF', x) - 1 AS BIGINT)) AS h FROM d),
 n AS (SELECT doc_id, size, list_transform(range(size - 8), lambda i: [h[2 * i + 2], h[2 * i + 1]]) AS h FROM b),
 c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(h)), lambda c, x: xor(c >> 4, tab[xor(c & 15, x) + 1]))) AS crc FROM n CROSS JOIN k),
 p AS (SELECT *, row_number() OVER w AS r, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, crc)),
 s AS (SELECT *, CAST(least(23, ((2 * byte + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, r - min(r) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

#: All pairs that share a shingle; for small tables.
_OP7 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), un AS (SELECT t, min(doc_id) AS u, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d GROUP BY t),
 sh AS (SELECT u, list_slice(w, i, i + 4) AS s, count(*) AS f FROM (SELECT u, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM un WHERE len(w) > 0) GROUP BY 1, 2),
 z AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM un), df AS (SELECT s, count(*) AS k FROM sh GROUP BY s),
 wt AS (SELECT u, sh.s, f * (round((1 + 0.25 * ln(n / k) / ln(n + 1)) * 1048576) / 1048576) AS w FROM sh JOIN df ON df.s = sh.s CROSS JOIN z), al AS (SELECT u, sum(w) AS w FROM wt GROUP BY u),
 pr AS (SELECT a.u AS a, b.u AS b, sum(least(a.w, b.w)) AS c FROM wt a JOIN wt b ON b.s = a.s AND a.u < b.u GROUP BY 1, 2),
 e AS (SELECT pr.a, pr.b FROM pr JOIN al x ON x.u = pr.a JOIN al y ON y.u = pr.b WHERE c / (x.w + y.w - c) >= 0.8 - 1e-9), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT u, u AS v FROM un UNION SELECT r.u, l.b FROM r JOIN l ON l.a = r.v), c AS (SELECT u, min(v) AS class_id FROM r GROUP BY u)
SELECT d.doc_id, c.class_id FROM d JOIN un ON un.t = d.t JOIN c ON c.u = un.u"""

_OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
 f AS (SELECT g, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY g)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.g AS payload_digest, CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN f.first < d.page_id THEN f.first END AS refers_to FROM d LEFT JOIN f ON f.g = d.g AND d.n >= 100"""

_OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
 bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM bi),
 ks AS (SELECT DISTINCT k FROM win),
 di AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
 g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM di),
 h AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON win.k = g.k AND win.g = g.g),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def _strength_sql(table: str) -> str:
    """Prior strength of a level in SQL, as in reputation._strength."""
    return f"""(SELECT 1 / least(0.5, greatest(0.001, CASE WHEN m < 2 OR n <= m THEN 0.5 WHEN bt + (sz - 1) * wi > 0 THEN (bt - wi) / (bt + (sz - 1) * wi) ELSE 0 END)) - 1 FROM (SELECT m, n, (npp - n * (b / n) * (b / n)) / nullif(m - 1, 0) AS bt, (b - npp) / nullif(n - m, 0) AS wi, (n - nn / n) / nullif(m - 1, 0) AS sz FROM (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(n * n) AS DOUBLE) AS nn, sum(b * b / CAST(n AS DOUBLE)) AS npp FROM {table} WHERE n > 0)))"""


_OP6 = f"""WITH u AS (SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
 h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM u LEFT JOIN l ON l.doc_id = u.page_id WHERE host <> '' GROUP BY host),
 h AS (SELECT *, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain FROM h0),
 d AS (SELECT domain, sum(n) AS n, sum(b) AS b, regexp_extract(domain, '[^.]*$') AS suffix FROM h GROUP BY domain), s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY suffix),
 k AS (SELECT {_strength_sql("h")} AS kh, {_strength_sql("d")} AS kd, {_strength_sql("s")} AS ks, (SELECT (sum(b) + 0.5) / (sum(n) + 1) FROM s) AS root),
 sm AS (SELECT suffix, (b + ks * root) / (n + ks) AS above FROM s CROSS JOIN k), dm AS (SELECT domain, (b + kd * above) / (n + kd) AS above FROM d JOIN sm ON sm.suffix = d.suffix CROSS JOIN k),
 p AS (SELECT host, (b + kh * above) / (n + kh) AS mean, n + kh AS total FROM h JOIN dm ON dm.domain = h.domain CROSS JOIN k),
 bl AS (SELECT host FROM p WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > 0.3),
 r AS (SELECT * FROM (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')) t(verdict, rule, rh, rp)),
 f AS (SELECT u.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC, r.rule) AS x FROM u JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN bl.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.x = 1 LEFT JOIN bl ON bl.host = u.host"""

#: Tokens, permutations and pseudonyms are not expressible; those queries are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {"op1_lm_scores": _OP1, "op3_quality_rules": _OP3, "op5_byte_shards": _OP5, "op7_near_duplicates": _OP7, "op6_url_reputation": _OP6, "op8_warc_segments": _OP8, "op9_decontamination": _OP9}
