"""Encoding, rules, decontamination and pseudonyms against brute force."""

from __future__ import annotations

import base64
import collections
import datetime
import hashlib
import pickle
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tests.llm.helpers import SCHEMA, documents, sentence
from tidemark.llm import bpe, contamination, feistel, pii, quality
from tidemark.llm import textkernel as K

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_ngrams_agree_with_split():
    rng = random.Random(3)
    texts = ["", "a", " b ", "one two three four five six", None, sentence(rng, 400_000), "end"]
    body, offsets = K.text_buffers(pa.array(texts))
    w = K.words(body, offsets)
    plain = [(r, x) for r, t in enumerate(texts) for x in (t or "").split()]
    assert w.row.tolist() == [r for r, _ in plain]
    by_word = collections.defaultdict(set)
    for (_, x), h in zip(plain, w.hash.tolist(), strict=True):
        by_word[x].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    h, row = K.ngrams(w, 5, short=True)
    assert np.bincount(row, minlength=7).tolist() == [0, 1, 1, 2, 0, 400_000 - 4, 1]
    d, r, c = K.distinct_in_rows(np.array([5, 7, 5, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert sorted(zip(r.tolist(), d.tolist(), c.tolist(), strict=True)) == [(0, 5, 2), (0, 7, 1), (1, 5, 1)]


def test_codec_is_the_library(library):
    codec = bpe.codec(PATH, PATTERN)
    rng = random.Random(5)
    alphabet = list(" \t\n\r\x1c\x85\xa0\u2003​'stremvlda1²½Ⅷé漢🙂́") + ["'re", " 's", "ſ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts += [t for _, t, _ in documents() if t] + ["<|endoftext|>", "don't we'll"]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_round_trip_query(spark, library):
    rows = documents()
    got = bpe.round_trip(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", N_TOKENS string"), PATH, PATTERN).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_verdicts(spark):
    rows = documents() + [(900 + i, "### " * 3 + sentence(random.Random(i), 40).replace(" ", "### ").upper(), "en") for i in range(20)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", kept int")
    got = quality.judge(docs, keep=["doc_id", "kept"]).collect()
    assert collections.Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in got) == collections.Counter((i, *measures(t)) for i, t, _ in rows)
    patterns = collections.Counter(tuple(r["votes"]) for r in got)
    post = quality.fit(list(patterns.items()))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["posterior"] == pytest.approx(post[tuple(r["votes"])])
        assert r["kept"] == (not r["base_failed"] and post[tuple(r["votes"])] >= 0.5)
    assert not any(r["kept"] for r in got if (r["doc_id"] or 0) >= 900)
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None)
    assert quality.judge(spark.createDataFrame([], SCHEMA), keep=["doc_id"]).collect() == []
    assert quality.keep_good(spark.createDataFrame([], SCHEMA)).collect() == []


def test_em_recovers_rule_accuracy():
    rng = random.Random(9)
    right = [0.9, 0.8, 0.95, 0.7]
    counts, truth = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in right)
        counts[votes] += 1
        truth[votes][good] += 1
    post = quality.fit(list(counts.items()))
    agree = sum(truth[v][p >= 0.5] for v, p in post.items()) / 20_000
    best = sum(max(t) for t in truth.values()) / 20_000
    assert agree > best - 0.01


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, window=10):
    words, hit, found = low(text), set(), set()
    for name, body in items:
        seq = low(body)
        for i in range(max(1, len(seq) - window + 1) if seq else 0):
            pattern = seq[i : i + window]
            for j in range(len(words) - len(pattern) + 1):
                if words[j : j + len(pattern)] == pattern:
                    hit.update(range(j, j + len(pattern)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("table_bytes", [32 << 20, 700])
def test_contamination_against_brute_force(spark, table_bytes):
    rng = random.Random(4)
    small = [x.split("omicron")[0] for x in ("a b", "b a b")] + ["a b a b a b a b a b a"]
    items = [(i, sentence(rng, n)) for i, n in enumerate([25, 12, 10, 9, 30])] + [(20, small[0]), (3, "Ünï -- CODE"), (7, None), (8, "..."), (9, small[2]), (10, small[2])]
    rows = [r for r in documents(60) if len(r[1] or "") < 20_000]
    for i in range(30):
        take = low(items[i % 5][1])
        cut = rng.randint(0, 3)
        rows.append((500 + i, sentence(rng, 15) + ", " + " / ".join(take[cut : cut + 12]).upper() + "! " + sentence(rng, rng.randint(0, 5)), "en"))
    rows += [(600, "A-B a b?ünï_code", "de"), (601, "a b " * 30, "en"), (602, "b a " * 9, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", items string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination.find_occurrences(docs, bench, table_bytes=table_bytes)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == collections.Counter((i, *(tuple(x) if isinstance(x, list) else x for x in brute_hits(t, items))) for i, t, _ in rows)
    with pytest.raises(ValueError):
        contamination.find_occurrences(docs, bench, most_bytes=10)
    if table_bytes > 1000:
        assert contamination.find_occurrences(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
        assert contamination.drop_contaminated(docs, bench).columns == docs.columns


def test_tables_stay_in_proportion_to_the_benchmark(monkeypatch):
    rng = random.Random(14)
    texts = [sentence(rng, 200) for _ in range(1500)]
    size = sum(map(len, texts))
    made = contamination.Matcher([str(i) for i in range(len(texts))], pa.array(texts), 10)
    assert len(pickle.dumps(made)) < 12 * size
    monkeypatch.setattr(contamination, "COMPARED", 7)  # a bucket larger than what is compared at once
    items = ["a b c d", "a x c d", "a b c d", "b b c d"] + [f"a b {i} c d" for i in range(20)]
    own = contamination.Matcher([str(i) for i in range(len(items))], pa.array(items), 4)
    docs = pa.array(["z a b c d a b 7 c d", "a x c d" * 2, "b 3 c d", None])
    body, offsets = K.text_buffers(docs)
    w = K.words(body, offsets, contamination.WORD_BYTES, lower=True)
    cover, found = np.zeros(len(w.hash) + 1, np.int64), {}
    own.search(w, body, cover, found)
    hit = np.cumsum(cover[:-1]) > 0
    for r, t in enumerate(docs.to_pylist()):
        n, n_hit, names = brute_hits(t, list(enumerate(items)), 4)
        assert (int((w.row == r).sum()), int(hit[w.row == r].sum()), sorted(found.get(r, ()))) == (n, n_hit, names)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000])
def test_permutation_is_one(n):
    assert sorted(feistel.permute(np.arange(n), n, b"k").tolist()) == list(range(n))
    assert sorted(feistel.permute_number(i, n, b"k") for i in range(n)) == list(range(n))


def test_pseudonyms_keep_format_and_links(spark):
    key = b"secret"
    values = {
        "card": ["4041894974608795", "4041 8949 7460 8795"], "phone": ["+1 (017) 555-7713", "212-555-0199"], "ip": ["233.254.104.120", "1.43.173.185"],
        "date": ["2024-02-29", "29.02.2024", "02/29/2024", "2024/02/29", "25/12/2024"], "email": ["Jo.34@mail7.example.com", "a1" * 90 + "@b.c"], "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "0a" * 700],
        "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    }
    for kind, texts in values.items():
        for v in texts:
            new, kinds = pii.rewrite(f"x {v}, y", key)
            assert kinds == [kind], (kind, v, new)
            made = new[2:-3]
            assert made != v
            again, more = pii.rewrite(f"x {made}, y", key)
            assert more == [kind]
            assert [re.sub("[0-9]+" if kind == "ip" else "[0-9a-f]" if kind == "secret" else "[0-9]", "#", re.sub("[a-z]", "#", x) if kind == "email" else x) for x in (made, v)] == [re.sub("[0-9]+" if kind == "ip" else "[0-9a-f]" if kind == "secret" else "[0-9]", "#", re.sub("[a-z]", "#", x) if kind == "email" else x) for x in (made, v)]
    plain = lambda v: re.sub("[ -]", "", pii.rewrite(v, key)[0])
    assert plain("4041894974608795") == plain("4041 8949 7460 8795")
    for same in ("4041894974608796", "2023-02-29", "300.1.1.1", "000-12-3456", "version 3.0.", "DE89370400440532013001", None, ""):
        assert pii.rewrite(same, key) == (same, [])
    rows = [(1, "call +1 (017) 555-7713 or 4041894974608795", "en"), (2, "4041894974608795!!", "en"), (3, None, "en"), (4, "", "en"), (5, "card 4041894974608795 " * 2000, "en")]
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), key=key).collect()}
    card = pii.rewrite("4041894974608795", key)[0]
    assert got[2]["text"] == card + "!!" and card in got[1]["text"] and got[1]["pii_kinds"] == ["card", "phone"]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == f"card {card} " * 2000
    assert pii.pseudonymize(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "lang", "pii_kinds"]


def test_pseudonyms_are_one_to_one():
    days = [f"19{y:02d}-01-{d:02d}" for y in range(100) for d in range(1, 32)]
    assert len({pii.pseudonym("date", x, b"k") for x in days}) == len(days)
    octets = [f"10.0.{a}.{b}" for a in range(40) for b in range(50)]
    assert len({pii.pseudonym("ip", x, b"k") for x in octets}) == 2000


def made_values(rng):
    """Values of all kinds, valid and not, and what an own reading of each says."""
    digits = lambda n: [rng.randrange(10) for _ in range(n)]
    join = lambda d: "".join(map(str, d))

    def doubled(d):
        return sum(x if (len(d) - i) % 2 else sum(map(int, str(2 * x))) for i, x in enumerate(d))

    d = digits(rng.choice([13, 15, 16, 19]))
    d[-1] = (d[-1] - doubled(d)) % 10 if rng.random() < 0.7 else d[-1]
    yield "card", join(d), doubled(d) % 10 == 0 and len(set(d)) > 1
    tail, check = join(digits(18)), rng.randrange(2, 99)
    good = 98 - int(tail + "131400") % 97  # D and E are 13 and 14
    number = f"DE{good if rng.random() < 0.7 else check:02d}{tail}"
    yield "iban", number, int(tail + "1314" + number[2:4]) % 97 == 1
    y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 14), rng.randrange(1, 33)
    try:
        real = bool(datetime.date(y, m, d))
    except ValueError:
        real = False
    yield "date", f"{y}-{m:02d}-{d:02d}", real
    yield "date", f"{d:02d}.{m:02d}.{y}", real
    octets = [rng.randrange(300) for _ in range(4)]
    yield "ip", ".".join(map(str, octets)), max(octets) < 256
    area, group, serial = rng.choice([0, 666, 900, 123, 899]), rng.choice([0, 7]), rng.choice([0, 4321])
    yield "ssn", f"{area:03d}-{group:02d}-{serial:04d}", area in (123, 899) and group > 0 and serial > 0
    yield "secret", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 64, 200]))) + "a1", True
    yield "email", f"{rng.choice(['jo', 'a.b', 'x' * 80])}{rng.randrange(99)}@host.example", True
    yield "phone", f"{join(digits(3))}-{join(digits(3))}-{join(digits(4))}", True


def test_values_against_an_own_reading(spark):
    """Tables of values between words: what is valid is replaced by its pseudonym, which is valid in turn, and nothing else is touched."""
    rng, key = random.Random(21), b"k"
    rows, want = [], {}
    for i in range(150):
        found = [x for x in made_values(rng) if not (x[0] == "secret" and len(x[1]) < 32)]
        rng.shuffle(found)
        rows.append((i, " ; ".join(f"w{j}x {v} q" for j, (_, v, _) in enumerate(found)), "en"))
        want[i] = [(kind, v, valid) for kind, v, valid in found]
    for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), key=key).collect():
        parts = [x.split(" ")[1] for x in r["text"].split(" ; ")]
        assert r["pii_kinds"] == sorted(k for k, _, valid in want[r["doc_id"]] if valid)
        for new, (kind, v, valid) in zip(parts, want[r["doc_id"]], strict=True):
            assert new == (pii.pseudonym(kind, v, key) if valid else v), (kind, v, valid)
            if valid:
                assert len(new) == len(v) or kind == "ip"
                assert pii.rewrite(f"w {new} q", key)[1] == [kind]
    slashed = [f"{d:02d}/{m:02d}/20{y:02d}" for y in range(30) for m in range(1, 13) for d in range(1, 29)]
    assert len({pii.pseudonym("date", x, key) for x in slashed}) == len(slashed)


def test_key_is_drawn_or_set(spark):
    drawn = pii.session_key(spark)
    assert drawn == pii.session_key(spark) and len(drawn) == 32
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.session_key(spark) == b"own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_values_beside_other_groups_are_replaced():
    key = b"k"
    for kind, v, texts in [
        ("card", "4111 1111 1111 1111", ["{} 12/27", "{} 123", "12 {}", "1 2 3 5 {}"]),
        ("card", "4111111111111111", ["{} 7 items", "no 7 {}"]),
        ("iban", "AT61 1904 3002 3457 3201", ["{} BIC", "{} EUR", "{} BANK AG", "AB12 {}"]),
    ]:
        new = pii.pseudonym(kind, v, key)
        for t in texts:
            assert pii.rewrite(t.format(v), key) == (t.format(new), [kind]), t
    assert pii.rewrite("4111 1111 1111 1112 12/27", key) == ("4111 1111 1111 1112 12/27", [])
