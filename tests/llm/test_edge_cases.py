"""Every operator, query and stage on nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest

from tests.llm.helpers import sentence
from tidemark.llm import bpe, contamination, lmscore, neardup, pii, quality, queries, reputation, sharding, storage, tokenshards, warc

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Names that operators give their results, beside the columns of documents.
CLASH = "class_id string, n_words string, text_crc32 string, shard string, slot string, size string, kept string, posterior string, items string, n_hit string, n_tokens string, ids_sha256 string, pii_kinds string, host string, path string, rule string, verdict string, block string, unit string, digest string, label string, payload_digest string, record_type string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows():
    import random

    rng = random.Random(6)
    long = [sentence(rng, 150_000), "q" * 1_200_000, "\n" * 300_000 + " end", "1 " * 200_000]
    plain = [sentence(rng, 40) for _ in range(12)]
    texts = [None, None, "", "", " \t\n", *long, *plain, plain[0], plain[0]]
    made = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return [*made, made[5], made[9], made[9], made[0], (None, None, None, None, None), (None, plain[1], None, None, None), (None, plain[1], None, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    clash = [c.split(" ")[0] for c in CLASH.split(", ")]
    full = spark.createDataFrame([(*r, *("?" for _ in clash)) for r in rows()], f"{DOCS}, {CLASH}")
    pages = full.selectExpr("doc_id AS page_id", "if(doc_id % 2 = 0, repeat('u', 100000), text) AS url", "text AS html", *clash)
    return {"documents": full, "pages": pages, "benchmark": spark.createDataFrame([(1, rows()[9][1]), (2, None), (3, "")], "item_id bigint, text string"), "outcomes": spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "page_id bigint, bad int")}


def shards(spark, docs):
    folder = storage.new_path(spark, "edge")
    stored = storage.materialize(docs, "edge")
    tokenshards.write(stored, folder, path=PATH, pattern=PATTERN, key=b"k", rows=500)
    return tokenshards.read(spark, folder, rows=500) if stored.count() else spark.createDataFrame([], "doc_id bigint")


def archives(spark, pages):
    folder = storage.new_path(spark, "edge")
    warc.write(pages, folder)
    return warc.read(spark, folder)


OPERATORS = {
    "lmscore": lambda s, t: lmscore.score(t["documents"], block_bytes=1 << 20),
    "bpe": lambda s, t: bpe.round_trip(t["documents"].filter("text is null or length(text) < 1000000"), PATH, PATTERN),
    "quality": lambda s, t: quality.judge(t["documents"], keep=t["documents"].columns),
    "sharding": lambda s, t: sharding.by_bytes(t["documents"], 5),
    "reputation": lambda s, t: reputation.judge(t["pages"], t["outcomes"]),
    "neardup": lambda s, t: neardup.classes(t["documents"], block_bytes=1 << 20),
    "warc": lambda s, t: archives(s, t["pages"]),
    "contamination": lambda s, t: contamination.find_occurrences(t["documents"], t["benchmark"]),
    "pii": lambda s, t: pii.pseudonymize(t["documents"], key=b"k"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(spark, tables, name):
    got = OPERATORS[name](spark, tables).toPandas()
    key = "page_id" if "page_id" in got else "doc_id"
    source = [r for r in rows() if name != "bpe" or len(r[1] or "") < 1_000_000]
    count = lambda ids: collections.Counter(None if i is None or i != i else int(i) for i in ids)
    assert count(got[key]) == count(r[0] for r in source)
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    same = got.drop_duplicates(subset=[c for c in got.columns if c not in ("slot", "shard", "items", "votes", "pii_kinds")])
    assert name in ("lmscore", "sharding") or len(same) <= len({r[:2] for r in source})  # repeated rows are judged alike


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, tables, name):
    none = {k: v.limit(0) for k, v in tables.items()}
    assert OPERATORS[name](spark, none).count() == 0
    assert OPERATORS[name](spark, none | {"benchmark": tables["benchmark"], "outcomes": tables["outcomes"]}).count() == 0


def test_token_shards(spark, tables):
    docs = tables["documents"].filter("text is null or length(text) < 500000")
    source = [r for r in rows() if len(r[1] or "") < 500_000]
    first = collections.Counter(r["doc_id"] for r in shards(spark, docs).filter("seq_no = 0").collect())
    assert first == collections.Counter(r[0] for r in source)
    assert shards(spark, docs.limit(0)).count() == 0


def test_group_of_equal_rows_is_laid_out_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.createDataFrame([(None, "same")] * 500 + [(i, "x" * i) for i in range(40)], "doc_id bigint, text string")
    got = sharding.by_bytes(docs, 6).toPandas()
    assert len(got) == 540 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got.groupby("shard")["size"].sum() - got["size"].sum() / 6).abs().max() <= got["size"].max()


def test_rules_that_tie_and_posteriors_at_the_threshold():
    assert quality.fit([((0, 0), 5)])[(0, 0)] == pytest.approx(0.5, abs=0.2)
    assert quality.fit([]) == {}


def test_registered_domains_from_a_table(spark):
    hosts = spark.createDataFrame([("a.b.shop.example",), ("user@x.co.uk:80",), ("y.gov.test.uk",), ("uk",)], "host string")
    plain = {r["host"]: r["domain"] for r in reputation.with_domain(hosts).collect()}
    assert plain == {"a.b.shop.example": "shop.example", "user@x.co.uk:80": "x.co.uk", "y.gov.test.uk": "test.uk", "uk": "uk"}
    known = spark.createDataFrame([("shop.example",), ("gov.test.uk",), ("test.uk",)], "suffix string")
    listed = {r["host"]: r["domain"] for r in reputation.with_domain(hosts, known).collect()}
    assert listed == {"a.b.shop.example": "b.shop.example", "user@x.co.uk:80": "co.uk", "y.gov.test.uk": "y.gov.test.uk", "uk": "uk"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The five tables of the queries, with the awkward rows."""
    at = tmp_path_factory.mktemp("edge")
    own = [r for r in rows() if len(r[1] or "") < 100_000 and r[0] is not None]
    spark.createDataFrame(own, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], f"http://h{r[0] % 3}.example.com/en/7" if r[0] % 2 else None, r[1]) for r in own], "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, own[-3][1]), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), own


#: Columns that the contracts name, in their order; more may follow.
CONTRACT = {
    "op2": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6": "page_id bigint, host string, path string, rule string, verdict string",
    "op8": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_keep_their_contract(spark, folder, name):
    at, own = folder
    got = queries.QUERIES[name](spark, at)
    types = dict(got.dtypes)
    for column in CONTRACT.get(name.split("_")[0], "").split(", "):
        if column:
            assert types[column.split(" ")[0]] == column.split(" ")[1]
    found = got.collect()
    key = "page_id" if "page_id" in types else "doc_id"
    once = [r for r in found if name != "op4_token_shards" or r["seq_no"] == 0]
    assert collections.Counter(r[key] for r in once) == collections.Counter(r[0] for r in own)
    if name.startswith("op5"):
        assert {r["law"] for r in found} == {"bytes"} and all(0 <= r["shard"] < 24 and r["grown_shard"] is None for r in found)
    if name.startswith("op9"):
        assert all((r["n_items"] == 0) == (r["items_sha256"] == hashlib.sha256(b"").hexdigest()) for r in found) and any(r["contaminated"] for r in found)
    if name.startswith("op6"):
        assert all((r["verdict"], r["rule"]) == ("allow", "example.com/en/7") for r in found if r["host"])


def test_pipeline_on_awkward_and_empty_tables(spark, folder, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at, own = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "n_chars AS Kept", "lang AS pii_kinds")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, at)
        assert name == corpus_pipeline.STAGES[-1][0] or made.columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
        docs = storage.materialize(made, "edge-stage")
    left = [r["doc_id"] for r in docs.collect()]
    assert len(left) == len(set(left)) and set(left) <= {r[0] for r in own if len((r[1] or "").split()) >= 10}


def test_a_stage_deletes_what_the_one_before_left(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    judged = corpus_pipeline.quality_rules(spark, docs, at)
    chained = corpus_pipeline.decontamination(spark, judged, at)  # not stored: it still reads the scratch table
    assert chained.count() >= 0
    judged = corpus_pipeline.quality_rules(spark, docs, at)
    stored = storage.materialize(judged, "edge")
    corpus_pipeline.decontamination(spark, stored, at)
    assert stored.count() >= 0
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        judged.count()


def test_scratch_is_deleted_and_a_cluster_needs_a_shared_folder(spark):
    made = storage.materialize(spark.range(3), "gone")
    files = made.inputFiles()
    assert files and all("/tidemark/" in f for f in files)
    storage.forget(made)
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        spark.read.parquet(files[0]).count()

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            applicationId, master = "app", "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Cluster)
