"""Shards, token shards, archives and URL filters."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import SCHEMA, documents
from tidemark.llm import reputation, sharding, storage, tokenshards, warc

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    got = sharding.by_bytes(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", shard int"), 7, part_bytes=1000).collect()
    own = sorted(((i is not None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in got) == own
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    total, most = sum(s for _, s, _ in own), max(s for _, s, _ in own)
    assert sorted(by) == list(range(7))
    last = -1
    for k in sorted(by):
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r["size"] for r in by[k]) - total / 7) <= most
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(by[k], key=lambda r: r["slot"])]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    assert sharding.by_bytes(spark.createDataFrame([], SCHEMA), 3).collect() == []
    assert {r["shard"] for r in sharding.by_bytes(spark.createDataFrame([(1, None, "x")], SCHEMA), 3).collect()} == {1}


def test_token_shards_hold_every_sequence_once(spark):
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    folder = storage.new_path(spark, "t")
    docs = storage.materialize(spark.createDataFrame(rows, SCHEMA), "docs")
    total = tokenshards.write(docs, folder, path=PATH, pattern=PATTERN, key=b"k", length=16, rows=50)
    got = tokenshards.read(spark, folder, length=16, rows=50).collect()
    assert sorted(r["slot"] for r in got) == list(range(total))
    assert all(r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 47 for r in got)
    own = tokenshards.encoding(PATH, PATTERN)
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*own.encode_ordinary(t or ""), 50256]
        for n in range(0, len(ids), 16):
            want[(i, n // 16, tuple(ids[n : n + 16]))] += 1
    assert collections.Counter((r["doc_id"], r["seq_no"], tuple(r["ids"])) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u2").tobytes()) == r["ids_crc32"] for r in got)
    raw = tokenshards.read(spark, folder, length=16, rows=50, packed=True).collect()
    assert {r["slot"]: bytes(r["ids"]) for r in raw} == {r["slot"]: np.array(r["ids"], "<u2").tobytes() for r in got}
    later = tokenshards.read(spark, folder, length=16, rows=50, from_slot=123).collect()
    assert sorted(r["slot"] for r in later) == list(range(123, total))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"])]
    assert order != sorted(order, key=lambda x: (x is None, x))
    assert tokenshards.write(spark.createDataFrame([], SCHEMA), storage.new_path(spark, "t"), path=PATH, pattern=PATTERN, key=b"k") == 0


def test_large_vocabularies_take_four_bytes(spark, tmp_path):
    import base64

    pieces = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    assert (tokenshards.id_type(PATH, PATTERN), tokenshards.id_type(str(path), PATTERN)) == ("<u2", "<u4")
    rows = [(i, "ÿ" * (i % 7) + " x", "en") for i in range(40)]
    folder = storage.new_path(spark, "t")
    total = tokenshards.write(spark.createDataFrame(rows, SCHEMA), folder, path=str(path), pattern=PATTERN, key=b"k", length=4, rows=9)
    got = tokenshards.read(spark, folder, length=4, rows=9, kind="<u4").collect()
    own = tokenshards.encoding(str(path), PATTERN)
    ids = {i: [*own.encode_ordinary(t), len(pieces)] for i, t, _ in rows}
    assert len(got) == total and max(x for r in got for x in r["ids"]) == len(pieces) == 65_792
    assert all(r["ids"] == ids[r["doc_id"]][4 * r["seq_no"] : 4 * r["seq_no"] + 4] for r in got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


PAGES = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(2)
    big = "".join(chr(rng.choice([65, 228, 0x6F22, 10, 13])) for _ in range(60_000))
    rows = [(9, "http://a/9", big), (3, "http://a/3", big), (4, None, None), (5, "x", ""), (6, "http://a/6\r\n", "short"), (7, "y", "short"), (1, "u", "z" * 100), (2, "v", "z" * 100), (8, "w", "é" * 49), (10, "w", "é" * 49)]
    return rows + [(20 + i, f"http://b/{i}", "<p>" + "t" * i * 700) for i in range(60)] + [(9, "http://a/9", big), (11, "0\r\n\r\n", "0\r\n\r\n")]


def test_archives_round_trip(spark):
    rows = pages()
    folder = storage.new_path(spark, "w")
    warc.write(spark.createDataFrame([(*r, "k") for r in rows], PAGES + ", key string"), folder, records_each=13)
    got = warc.read(spark, folder, payload=True).collect()
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = collections.Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        copy = first.get(body, i) < i
        want[(i, "revisit" if copy else "response", len(body), hashlib.sha256(body).hexdigest(), first[body] if copy else None, None if copy else body)] += 1
    assert collections.Counter((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    found = warc.read_records(spark, folder)
    assert found.filter("kind = 'continuation'").count() > 5


def test_damaged_segments_are_reported(spark):
    folder = storage.new_path(spark, "w")
    warc.write(spark.createDataFrame([r for r in pages() if r[0] == 3], PAGES), folder)
    found = warc.read_records(spark, folder)
    number = found.filter("segment is not null").agg({"segment": "max"}).first()[0]
    said = lambda df: [r["error"] for r in warc.reassemble(df).collect()]
    assert said(found) == [None]
    assert said(found.filter("segment <> 2")) == ["segments are missing or differ"]
    assert said(found.filter(f"segment <> {number}")) == ["the last segment is missing"]
    assert said(found.withColumn("total", found["total"] + 1)) == ["the total length differs"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


def test_url_rules_and_reputation(spark):
    urls = [
        ("http://WWW.Example.COM/en/7x?q", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://example.com/en/8#f", "example.com", "/en/8", "com/en/", "block"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("x://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
        ("x://a.net/de/", "a.net", "/de/", "net/de/", "allow"),
        ("x://b.org/es", "b.org", "/es", None, "allow"),
        ("x://h?u://v/en/", "h", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a\nb://C.com\n/en/\n?", "c.com\n", "/en/\n", None, "allow"),
    ]
    rows = [(i, u) for i, (u, *_) in enumerate(urls)] + [(100 + i, f"http://bad.spam.example.org/{i}") for i in range(40)] + [(200 + i, f"http://good.example.org/{i}") for i in range(40)]
    labels = [(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(30)] + [(100, 0), (9999, 1)]
    got = {r["page_id"]: r for r in reputation.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), i
    assert all(got[i]["verdict"] == "block" for i in range(100, 140))
    assert all(got[i]["verdict"] == "allow" for i in range(200, 240))
    none = reputation.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([], "page_id bigint, bad int"))
    assert none.filter("verdict = 'block' and rule is null").count() == 0
    assert reputation.judge(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect() == []


def test_possessive_pattern_cuts_alike():
    slow, fast = tokenshards.encoding(PATH, PATTERN), tokenshards.encoding(PATH, tokenshards.POSSESSIVE)
    rng = random.Random(8)
    alphabet = list(" \t\n\r\x1c\x85\xa0'stremvld1½Ⅷé漢🙂́") + ["'re", " 's", "'ll"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert slow.encode_ordinary(text) == fast.encode_ordinary(text)
