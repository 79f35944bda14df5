"""Near-duplicate classes by improved consistent weighted sampling.

1. Equal texts are one unit.
2. Document frequencies of five-word shingles are counted over all units; a
   shingle weighs its frequency in the text times 1 + smooth * ln(N / df) / ln(N + 1).
3. A unit of which less than the threshold's share of weight lies in shingles
   that another unit has too can have no partner, and is done.
4. The others are sampled: 48 consistent weighted samples (Gamma variates read
   from quantile tables of 2**16 steps), in 12 bands of 4.
5. In each band bucket every member is compared to the smallest one by weighted
   Jaccard similarity.  Where that fails, the member is compared by samples to
   all others of the bucket, and likely pairs are verified in the same task,
   until links connect them.  Large buckets are dealt into parts, and a task
   compares a part with itself or with another.  Only links leave a task, fewer
   than it has members.
6. Verified pairs join units into classes; the class id is the smallest id.

A unit can miss its class if it agrees with it in no band (0.17 % for a single
partner at a similarity of 0.8, fewer above).

Defined results: texts of fewer words than a shingle are one shingle; a null
text is taken as empty, and texts without words only equal each other; a very long
text is a block by itself at worst; repeated rows are one member and come back as
often as they were; rows of one id belong together; a null id is never chosen as
class id unless all are null; other columns are left out, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gramcounts as G
from tidemark.llm import textkernel as K
from tidemark.llm.storage import forget, materialize

U = np.uint64
WORDS, THRESHOLD, SMOOTH = 5, 0.8, 0.25
BANDS, BAND_ROWS = 12, 4
SAMPLES = BANDS * BAND_ROWS
BLOCK_BYTES = 2 << 20
#: Samples alike from which a pair is verified in a mixed bucket; members of such a bucket in one part; pairs verified at once.
LIKELY, PART, ASKED = 0.5, 4096, 1024
#: Texts without an id get numbers from here on, above all ids.
NAMELESS = 1 << 62
UNITS = "unit bigint, bands array<bigint>, sample binary, vector binary"
_UNITS = pa.schema([("unit", pa.int64()), ("bands", pa.list_(pa.int64())), ("sample", pa.binary()), ("vector", pa.binary())])


@functools.cache
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Values of a Gamma(2, 1) variate, and their logarithms, at the middles of 2**16 equal steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, start: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples, as 32-bit marks of (shingle, level): a row for each set, which begin at ``start``."""
    gamma, log_gamma = _quantiles()
    log_w = (np.round(np.log(weight) * (1 << 16)) / (1 << 16)).astype(np.float32)  # the last bits of log() vary with the place in an array
    low32 = U(0xFFFFFFFF)
    out = np.empty((len(start), count), np.uint32)
    for k in range(count):
        x = K.mix64(h ^ U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r, log_c = gamma[x & U(0xFFFF)], log_gamma[(x >> U(16)) & U(0xFFFF)]
        beta = ((x >> U(32)) & U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta + np.float32(1))
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U)
        mark = K.mix64(x + level.astype(np.int64).astype(U) * U(0xD6E8FEB86659FD93)) & low32
        out[:, k] = np.minimum.reduceat(rank << U(32) | mark, start) & low32
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    parts = sample.astype(U).reshape(len(sample), -1, BAND_ROWS)
    keys = K.fold([parts[:, :, i] for i in range(BAND_ROWS)])
    return K.mix64(keys + np.arange(keys.shape[1], dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


class _Block:
    """Distinct shingles of a block's units, in order of units."""

    def __init__(self, left: pa.Table, right: pa.Table, words: int):
        wanted = {k for keys in right.column("keys").to_pylist() if keys for k in keys}
        take = []
        for i, d in enumerate(zip(left.column("unit").to_pylist(), left.column("digest").to_pylist(), strict=True)):
            mark = f"{d[0]}|{d[1]}"
            if mark in wanted:
                wanted.discard(mark)  # a repeated row comes once, a copy with another id not at all
                take.append(i)
        own = left.take(pa.array(take, pa.int64()))
        self.unit = own.column("unit").to_numpy()
        body, offsets = K.text_buffers(own.column("text"))
        h, row = K.ngrams(K.words(body, offsets), words, short=True)
        self.h, self.row, self.tf = K.distinct_in_rows(h, row)
        self.distinct, self.number, self.count = np.unique(self.h, return_inverse=True, return_counts=True)


def _weights(df: np.ndarray, tf: np.ndarray, units: int, smooth: float) -> np.ndarray:
    """In steps of 2**-20, so that a shingle weighs the same wherever it is computed."""
    return tf * (np.round((1 + smooth * np.log(units / df) / np.log(units + 1)) * (1 << 20)) / (1 << 20))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, w = G.unsqueeze(blob, "<u8", "<f8")
    return np.cumsum(d), w


def sampled_units(docs: DataFrame, firsts: DataFrame, *, blocks: int, words: int, threshold: float, smooth: float) -> DataFrame:
    """Units that may have a partner, with band keys, samples and weighted shingles."""
    place = ["unit", "digest"]
    blocked = docs.select(G.block_of(*place, blocks=blocks).alias("block"), *place, "text")
    null = lambda kind: F.lit(None).cast(kind)
    known = firsts.groupBy(G.block_of(*place, blocks=blocks).alias("block")).agg(F.collect_list(F.concat_ws("|", F.col("unit").cast("string"), F.col("digest"))).alias("keys"))
    known = known.select("block", F.lit(-1).alias("kind"), null("int").alias("bucket"), null("binary").alias("blob"), "keys")
    units = max(1, firsts.count())

    def grams(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        b = _Block(left, right, words)
        return [(b.distinct, b.count)]

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left, right, words)
        (counts,) = G.answers(right, 1)
        df = counts[b.number] if len(b.h) else np.zeros(0, np.int64)
        w = _weights(df, b.tf, units, smooth)
        n = len(b.unit)
        shared, whole = np.bincount(b.row, weights=np.where(df > 1, w, 0), minlength=n), np.bincount(b.row, weights=w, minlength=n)
        chosen = (whole > 0) & (shared >= (threshold - 1e-9) * whole)
        keep = chosen[b.row] if len(b.row) else np.zeros(0, bool)
        h, w, row = b.h[keep], w[keep], b.row[keep]
        order = np.lexsort((h, row))
        h, w, row = h[order], w[order], row[order]
        ids = b.unit[chosen]
        if not len(ids):
            return _UNITS.empty_table()
        start = np.flatnonzero(np.diff(row, prepend=-1))
        marks = samples(h, w, start)
        ends = np.append(start[1:], len(h))
        vectors = [G.squeeze(G.deltas(h[a:z]), w[a:z]) for a, z in zip(start.tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(ids), pa.array(list(band_keys(marks)), pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(vectors, pa.binary())], schema=_UNITS)

    found = G.exchange(blocked, known, grams, blocks)
    return blocked.groupBy("block").cogroup(known.unionByName(found).groupBy("block")).applyInArrow(sample, UNITS)


def _verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with ``near``: whether they reach the threshold."""
    vectors = units.select("unit", "vector")
    both = pairs.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(_unpacked(x), _unpacked(y)) >= threshold - 1e-9 for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return both.mapInArrow(run, "a bigint, b bigint, near boolean")


def _linked(rows: pa.Table, threshold: float) -> pa.Table:
    """Links (a, b) of a mixed bucket's part, or between two of its parts: every pair with an open member is verified here if its samples make it likely.

    A pair that links found so far connect, or that meets in an earlier band,
    needs no look; settled members are connected by their leader.  So a task
    gives fewer links than it has members, however many pairs it compares.
    """
    rows = rows.sort_by("unit")
    unit, band = rows.column("unit").to_numpy(), rows.column("band")[0].as_py()
    settled = np.asarray(rows.column("settled").to_pylist(), bool)
    part = rows.column("part").to_numpy()
    across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    marks = np.frombuffer(b"".join(rows.column("sample").to_pylist()), np.uint32).reshape(len(unit), -1)
    own = [_unpacked(v) for v in rows.column("vector").to_pylist()]
    weight = np.concatenate([w for _, w in own])
    start = np.cumsum([0] + [len(w) for _, w in own])
    total = np.add.reduceat(weight, start[:-1])
    distinct, number = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
    del own
    mine = np.zeros(len(distinct))
    group = np.where(settled, -1, np.arange(len(unit)))
    a, b = [], []
    for i in np.flatnonzero(~settled).tolist():
        same = marks == marks[i]
        ask = (same.mean(axis=1) >= LIKELY) & (group != group[i]) & (settled | (np.arange(len(unit)) > i))
        at = np.flatnonzero(ask & (part != part[i]) if across else ask)
        at = at[~same[at, : band * BAND_ROWS].reshape(len(at), band, BAND_ROWS).all(axis=2).any(axis=1)]
        whole = slice(start[i], start[i + 1])
        mine[number[whole]] = weight[whole]
        for some in np.split(at, range(ASKED, len(at), ASKED)):
            if not len(some):
                continue
            n = start[some + 1] - start[some]
            ends = np.cumsum(n)
            flat = np.arange(ends[-1]) + np.repeat(start[some] - (ends - n), n)
            shared = np.add.reduceat(np.minimum(mine[number[flat]], weight[flat]), ends - n)
            for j in some[shared / (total[i] + total[some] - shared) >= threshold - 1e-9].tolist():
                if group[j] != group[i]:
                    a.append(int(min(unit[i], unit[j])))
                    b.append(int(max(unit[i], unit[j])))
                    group[group == group[j]] = group[i]
        mine[number[whole]] = 0
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linking(threshold: float):
    return lambda rows: _linked(rows, threshold)


def links(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified pairs of units that join the classes."""
    members = units.select("unit", F.posexplode("bands").alias("band", "key"))
    leaders = members.groupBy("band", "key").agg(F.min("unit").alias("a"), F.count("*").alias("n")).filter("n > 1")
    led = materialize(members.join(leaders, ["band", "key"]), "neardup-led")
    first = materialize(_verified(led.filter("a <> unit").select("a", F.col("unit").alias("b")).distinct(), units, threshold), "neardup-first")
    found = first.filter("near").select("a", "b")
    open_ = materialize(led.join(first.filter("not near").select("a", F.col("b").alias("unit")), ["a", "unit"], "left_semi").select("band", "key", "unit", "n"), "neardup-open")
    mixed = open_.select("band", "key").distinct()
    state = led.join(mixed, ["band", "key"], "left_semi").select("band", "key", "unit", "n").join(open_.select("band", "key", "unit", F.lit(True).alias("open")), ["band", "key", "unit"], "left")
    # each part meets itself and each other part in a task of its own
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = state.select("band", "key", "unit", F.col("open").isNull().alias("settled"), parts.alias("parts"), F.pmod(F.xxhash64("unit", F.lit(0)), parts).cast("int").alias("part"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = met.select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "unit", "settled").join(units.select("unit", "sample", "vector"), "unit")
    linked = cells.groupBy("band", "key", "low", "high").applyInArrow(_linking(threshold), "a bigint, b bigint").distinct()
    made = materialize(found.unionByName(linked), "neardup-links")
    for scratch in (led, first, open_):
        forget(scratch)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(unit, label): the smallest unit that pairs connect each one with; minima and pointer jumps until nothing changes."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "neardup-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("unit"), F.least("a", "m").alias("label")), "neardup-labels")
    while True:
        around = both.join(labels.select(F.col("unit").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(around.select(F.col("a").alias("unit"), "m"), "unit").select("unit", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("unit").alias("label"), F.col("label").alias("higher"))
        new = materialize(step.join(jump, "label", "left").select("unit", "old", F.least("label", F.coalesce("higher", "label")).alias("label")), "neardup-labels")
        done = new.filter("old <> label").limit(1).count() == 0
        forget(labels)
        labels = new.select("unit", "label")
        if done:
            forget(both)
            return labels


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with its columns: that of the smallest id, once if it is repeated.

    Rows without an id stay where no row with an id is in their class, once for each text.
    """
    found = materialize(classes(docs, doc_id=doc_id, text=text, **options), "neardup-classes")
    first = found.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    first = materialize(first.select(F.col("doc_id").alias(doc_id), "n"), "neardup-keep")
    release(docs.sparkSession)
    # a merge join at every size: the ids kept grow with the input, so they are never sent to every executor
    kept = docs.join(first.select(doc_id).hint("merge"), doc_id, "left_semi")
    again = first.filter("n > 1").select(doc_id)
    if again.limit(1).count():
        kept = kept.join(again, doc_id, "left_anti").unionByName(kept.join(again, doc_id, "left_semi").dropDuplicates([doc_id]))
    if found.filter("class_id is null").limit(1).count():
        nameless = docs.filter(F.col(doc_id).isNull())
        named = docs.filter(F.col(doc_id).isNotNull()).select(text)
        kept = kept.unionByName(nameless.join(named, text, "left_anti").dropDuplicates([text]))
    return kept.select(*docs.columns)


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, smooth: float = SMOOTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.encode(body, "UTF-8"), 256), 1, 32)
    own = docs.select(F.col(doc_id).cast("bigint").alias("id"), body.alias("text"), digest.alias("digest"))
    number = F.coalesce(F.col("id"), F.xxhash64("digest").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))
    rows = materialize(own.select("id", "digest", number.alias("unit")), "neardup-rows")
    firsts = materialize(rows.groupBy("digest").agg(F.min("unit").alias("unit")), "neardup-firsts")
    blocks = G.blocks_for(docs, block_bytes)
    texts = own.select(number.alias("unit"), "digest", "text")
    units = materialize(sampled_units(texts, firsts, blocks=blocks, words=words, threshold=threshold, smooth=smooth), "neardup-units")
    release(spark)
    first = firsts.withColumnRenamed("unit", "first")
    pairs = rows.select("unit", "digest").distinct()
    several = pairs.join(pairs.groupBy("unit").count().filter("count > 1").select("unit"), "unit").join(first, "digest")
    same_id = several.join(several.groupBy("unit").agg(F.min("first").alias("a")), "unit").filter("a <> first").select("a", F.col("first").alias("b"))
    linked = links(units, threshold)
    forget(units)
    labels = components(linked.unionByName(same_id))
    forget(linked)
    joined = rows.join(first, "digest").join(labels.withColumnRenamed("unit", "first"), "first", "left")
    chosen = F.coalesce("label", "first")
    return joined.select(F.col("id").alias("doc_id"), F.when(chosen < NAMELESS, chosen).alias("class_id"))
