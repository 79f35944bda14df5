"""Scores and near-duplicates over a whole corpus, and the pipeline, against brute force."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, documents, sentence
from tidemark.llm import gramcounts as G
from tidemark.llm import lmscore, neardup


def brute_scores(rows, held_out, order=2):
    docs = [(t or "").split() for _, t, _ in rows]
    grams = lambda d: collections.Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    whole = collections.Counter()
    for d in docs:
        whole.update(grams(d))
    out = []
    for (i, _, _), d in zip(rows, docs, strict=True):
        mine = grams(d) if held_out else collections.Counter()
        size = max(1, sum(map(len, docs)) - (len(d) if held_out else 0))

        def word(gram):
            n = whole[gram] - mine[gram]
            if len(gram) == 1:
                return (n or 0.4) / size
            return n / max(1, whole[gram[:-1]] - mine[gram[:-1]]) if n else 0.4 * word(gram[1:])

        score, backed = 0.0, 0
        for k in range(len(d)):
            longest = tuple(d[max(0, k - order + 1) : k + 1])
            score += math.log(word(longest))
            backed += len(longest) > 1 and whole[longest] == mine[longest]
        out.append((i, len(d), backed, round(score, 5)))
    return collections.Counter(out)


@pytest.mark.parametrize(("held_out", "order"), [(True, 2), (False, 2), (True, 1), (True, 5)])
def test_scores_against_brute_force(spark, held_out, order):
    rows = [r for r in documents() if "\x1c" not in (r[1] or "")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], SCHEMA + ", log_score double")
    counted = lambda got: collections.Counter((r["doc_id"], r["n_words"], r["n_backed_off"], round(r["log_score"], 5)) for r in got)
    assert counted(lmscore.score(docs, held_out=held_out, order=order, block_bytes=20_000).collect()) == brute_scores(rows, held_out, order)
    assert lmscore.score(spark.createDataFrame([], SCHEMA)).collect() == []
    apart = [r for r in rows[:125] if r[0] is not None]
    assert counted(lmscore.score_joined(spark.createDataFrame(apart, SCHEMA), held_out=held_out, order=order).collect()) == brute_scores(apart, held_out, order)


def test_consistent_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    wb[:200] = wa[100:] * rng.choice([1.0, 2.0], 200)
    a, b = (h[:300], wa), (h[100:], wb)
    marks = neardup.samples(np.concatenate([a[0], b[0]]), np.concatenate([wa, wb]), np.array([0, 300]), 3000)
    order = lambda x: (x[0][np.argsort(x[0])], x[1][np.argsort(x[0])])
    assert (marks[0] == marks[1]).mean() == pytest.approx(neardup.similarity(order(a), order(b)), abs=0.03)


def shingles(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Class of each text by all pairs, and the pairs near the threshold."""
    texts = sorted({t or "" for _, t, _ in rows})
    sets = {t: shingles(t) for t in texts}
    df = collections.Counter(s for c in sets.values() for s in c)
    n = len(texts)
    weight = {t: {s: f * (1 + 0.25 * math.log(n / df[s]) / math.log(n + 1)) for s, f in c.items()} for t, c in sets.items()}
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        shared = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
        whole = sum(weight[a].values()) + sum(weight[b].values()) - shared
        if shared and shared / whole >= 0.8:
            up[root(a)] = root(b)
    by_id = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            by_id[i].add(t or "")
    for ts in by_id.values():
        first = next(iter(ts))
        for t in ts:
            up[root(t)] = root(first)
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[root(t or "")].append(i)
    return collections.Counter((i, min(ids[root(t or "")], default=None)) for i, t, _ in rows)


def family(rng, first, size, base=None):
    words = (base or sentence(rng, rng.randint(60, 150))).split()
    out = [(first, " ".join(words), "en")]
    for k in range(1, size):
        own = list(words)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        out.append((first + k, " ".join(own) + " " * rng.randint(0, 1), "en"))
    return out


def corpus():
    rng = random.Random(11)
    rows = [r for r in documents(60) if len(r[1] or "") < 20_000]
    for f in range(12):
        rows += family(rng, 1000 + 50 * f, rng.randint(2, 12))
    base = sentence(rng, 120)
    rows += family(rng, 3000, 60, base)
    passage = sentence(rng, 100)
    for k in range(40):  # many unlike texts around one passage, some of them alike
        rows.append((4000 + k, passage + " " + sentence(rng, 60), "en"))
    rows += [(4100 + k, t + " tail", l) for k, (_, t, l) in enumerate(rows[-40:-30])]
    drift = sentence(rng, 200).split()
    for k in range(15):  # a chain: neighbours are alike, the ends are not
        rows.append((5000 + k, " ".join(drift), "en"))
        drift[k * 12 + 3] = f"drift{k}"
        drift[k * 12 + 9] = f"drift{k}x"
    return [*rows, (6000, rows[5][1], "en"), (6000, "another text of the same id", "en")]


def test_classes_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA + ", class_id string")
    got = neardup.classes(docs, block_bytes=20_000).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(rows)
    copies = [(9000 - i, rows[-30][1] if i % 2 else rows[-29][1], "en") for i in range(400)]  # copies with larger ids share blocks with the first
    again = neardup.classes(spark.createDataFrame(copies, SCHEMA), block_bytes=2000).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in again) == brute_classes(copies)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute_classes(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def sampled_group(pairs, common=600, own=120, single=78, seed=3):
    """Units around one passage: a unit is like its partner (about 0.82) and unlike all others (about 0.6)."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    passage, made = draw(common), []
    for _ in range(pairs):
        both = draw(own)
        made += [np.sort(np.concatenate([passage, both, draw(single)])) for _ in range(2)]
    order = rng.permutation(len(made))
    made = {int(u): h for u, h in zip(order, made, strict=True)}
    w = np.ones(common + own + single)
    marks = {u: neardup.samples(h, w, np.array([0])) for u, h in made.items()}
    rows = [(u, neardup.band_keys(marks[u])[0].tolist(), marks[u].tobytes(), G.squeeze(G.deltas(h), w)) for u, h in made.items()]
    keys = {u: set(enumerate(k)) for u, k, _, _ in rows}
    return rows, [(int(order[2 * i]), int(order[2 * i + 1])) for i in range(pairs)], keys


def lost_pairs(spark, group):
    """Partners that share a band bucket and that no links connect."""
    rows, pairs, keys = group
    label = {r[0]: r[0] for r in rows}
    for x, y in neardup.links(spark.createDataFrame(rows, neardup.UNITS)).select("a", "b").collect():
        low, high = sorted((label[x], label[y]))
        label = {u: low if v == high else v for u, v in label.items()}
    return [p for p in pairs if keys[p[0]] & keys[p[1]] and label[p[0]] != label[p[1]]]


def test_pairs_within_a_group_of_unlike_units_are_linked(spark):
    assert lost_pairs(spark, sampled_group(400)) == []


def test_pairs_across_parts_of_a_bucket_are_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 40)
    assert lost_pairs(spark, sampled_group(400)) == []


def test_alike_units_with_few_equal_samples_are_verified():
    """Of pairs at a similarity of 0.8 that share a band, some agree in fewer than 32 of 48 samples."""
    rng = np.random.default_rng(11)
    w, few = np.ones(900), 0
    for _ in range(4000):
        h = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
        own = [np.sort(h[:900]), np.sort(h[100:])]
        marks = [neardup.samples(x, w, np.array([0])) for x in own]
        bands = [k[0].tolist() for k in map(neardup.band_keys, marks)]
        band = next((i for i, (x, y) in enumerate(zip(*bands, strict=True)) if x == y), None)
        if band is None or (marks[0] == marks[1]).mean() >= 0.65:
            continue
        few += 1
        cell = {"unit": [1, 2], "band": [band] * 2, "low": [0] * 2, "high": [0] * 2, "part": [0] * 2, "settled": [False] * 2, "sample": [m.tobytes() for m in marks], "vector": [G.squeeze(G.deltas(x), w) for x in own]}
        assert neardup._linked(pa.table(cell), 0.8).to_pydict() == {"a": [1], "b": [2]}
        break
    assert few


def test_pipeline_against_its_parts(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    from tests.llm.test_text_operators import brute_hits, measures
    from tidemark.llm import pii, quality

    rng = random.Random(12)
    rows = [(i, t, "en", "s", len(t or "")) for i, t, _ in family(rng, 0, 6) + family(rng, 100, 4) + [(50 + k, sentence(rng, 70), "en") for k in range(40)]]
    rows += [(200, "### " * 50, "en", "s", 1), (201, None, "en", "s", None), (202, sentence(rng, 50) + " card 4041894974608795", "de", "s", 9), (203, "short", "en", "s", 5)]
    item = sentence(rng, 20)
    rows += [(204, sentence(rng, 40) + " " + item, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{tmp_path}/documents.parquet"), keep=["doc_id"]).collect()}
    assert all(not judged[i] for i, t, *_ in rows if measures(t)[0] < 10)
    left = [(i, t, l) for i, t, l, *_ in rows if judged[i]]
    first = {c for _, c in brute_classes(left)}
    left = [(i, t) for i, t, _ in left if i in first and not brute_hits(t, [(1, item)])[1]]
    want = {i: hashlib.sha256(pii.rewrite(t, pii.session_key(spark))[0].encode()).hexdigest() for i, t in left}
    assert {i: d for i, (_, d) in got.items()} == want
    assert 202 in got and 204 not in got and 200 not in got and 1 not in got and 0 in got
