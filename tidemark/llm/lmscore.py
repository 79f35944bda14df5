"""Stupid-backoff language-model scores of documents.

Count tables of the n-grams of each order, partitioned by hash, are counted over
all documents and joined to the n-grams of each block of documents; the scores of
a document's words are summed.  A word scores the count of its longest n-gram
over that of the n-gram's context; where that n-gram is unseen, 0.4 times its
score by one word less, down to 0.4 over the number of words.  By default a
document's own n-grams are taken off the counts, so that it is scored by the rest
of the corpus.

``score`` moves the n-grams of a block packed and sorted (gramcounts.py);
``score_joined`` is the same in rows, one for each n-gram, and serves as its test
and for small tables: its shuffles take 16 bytes and more for each n-gram.

N-grams are compared by 64-bit hash; two of n distinct ones agree with a
probability below n / 2**64 for each look-up.

Defined results: null and blank texts have no words and the score 0; a very long
text is a block by itself at worst; repeated rows are documents of their own;
rows equal in id and text share a block; other columns are left out, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import gramcounts as G
from tidemark.llm import textkernel as K

BACKOFF, ORDER = 0.4, 2
#: A word, for Java's expressions: as textkernel.NON_SPACE.
WORD = "[^\\x20\\x09-\\x0D]+"
SCORES = "doc_id bigint, n_words bigint, n_backed_off bigint, log_score double, mean_log_score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])


class _Block:
    """Words of a block's texts and, for each order, the words that end an n-gram, distinct hashes and each one's number."""

    def __init__(self, texts: pa.Array, order: int):
        body, offsets = K.text_buffers(texts)
        self.words = w = K.words(body, offsets)
        self.at, self.hash, self.number, self.count = [], [], [], []
        for n in range(1, order + 1):
            at = np.flatnonzero(w.row[n - 1 :] == w.row[: max(0, len(w.row) - n + 1)]) + n - 1
            h = w.hash if n == 1 else K.fold([w.hash[at - i] for i in range(n)]) if len(at) else np.zeros(0, K.U)
            distinct, number, count = np.unique(h, return_inverse=True, return_counts=True)
            for kept, x in ((self.at, at), (self.hash, distinct), (self.number, number), (self.count, count)):
                kept.append(x)

    def own(self, kind: int) -> np.ndarray:
        """How often the n-gram of each occurrence is in the same document."""
        key = self.words.row[self.at[kind]].astype(np.int64) * max(1, len(self.hash[kind])) + self.number[kind]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[back]


def _scores(block: _Block, total: int, counts: list[np.ndarray], held_out: bool, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word, and whether its longest n-gram was backed off."""
    w = block.words
    size = np.maximum((total - w.per_row()[w.row]) if held_out else np.full(len(w.row), total), 1)
    score, backed, context = np.zeros(len(w.row)), np.zeros(len(w.row), bool), np.zeros(0)
    for kind, at in enumerate(block.at):
        other = counts[kind][block.number[kind]] - (block.own(kind) if held_out else 0)
        if kind == 0:
            score = np.log(np.where(other > 0, other, backoff) / size)
        else:
            ratio = np.log(np.maximum(other, 1) / np.maximum(context[at - 1], 1))
            score[at] = np.where(other > 0, ratio, np.log(backoff) + score[at])
            backed[at] = other <= 0
        context = np.zeros(len(w.row))
        context[at] = other
    return score, backed


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, held_out: bool = True, backoff: float = BACKOFF, block_bytes: int = G.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backed_off, log_score (natural, summed) and mean_log_score of every document."""
    if order < 1:
        raise ValueError("order must be positive")
    blocks = G.blocks_for(docs, block_bytes)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("bigint"))).first()[0] or 0
    blocked = own.select(G.block_of("doc_id", F.xxhash64("text"), blocks=blocks).alias("block"), "doc_id", "text")

    def grams(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        b = _Block(left.column("text"), order)
        return list(zip(b.hash, b.count, strict=True))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left.column("text"), order)
        values, backed = _scores(b, total, G.answers(right, order), held_out, backoff)
        n = b.words.per_row()
        summed = np.bincount(b.words.row, weights=values, minlength=b.words.rows)
        mean = np.divide(summed, n, out=np.zeros(len(n)), where=n > 0)
        return pa.Table.from_arrays([left.column("doc_id"), pa.array(n), pa.array(np.bincount(b.words.row, weights=backed, minlength=b.words.rows).astype(np.int64)), pa.array(summed), pa.array(mean)], schema=_SCORES)

    found = G.exchange(blocked, G.no_keys(blocked), grams, blocks)
    return blocked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, SCORES)


def score_joined(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, held_out: bool = True, backoff: float = BACKOFF) -> DataFrame:
    """As score() for distinct ids, in rows: n-grams are exploded, counted by hash, joined to the counts and summed by document."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc"), words.alias("w"))
    total = own.agg(F.sum(F.size("w").cast("bigint"))).first()[0] or 0

    def gram(n: int) -> Column:
        return F.transform(F.sequence(F.lit(n), F.size("w")), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), *(F.get("w", i - 1 - k) for k in range(n))).alias("h")))

    parts = F.concat(*(F.when(F.size("w") >= n, gram(n)).otherwise(F.array().cast("array<struct<at:int,n:int,h:bigint>>")) for n in range(1, order + 1)))
    rows = own.select("doc", F.size("w").alias("size"), F.explode(parts).alias("g")).select("doc", "size", "g.*")
    counts = rows.groupBy("h").agg(F.count("*").alias("c"))
    mine = F.count("*").over(Window.partitionBy("doc", "h")) if held_out else F.lit(0)
    joined = rows.withColumn("mine", mine).join(counts, "h").select("doc", "size", "at", "n", (F.col("c") - F.col("mine")).alias("c"))
    at = joined.groupBy("doc", "size", "at").agg(*(F.max(F.when(F.col("n") == n, F.col("c"))).alias(f"c{n}") for n in range(1, order + 1)))
    near = Window.partitionBy("doc").orderBy("at")
    at = at.select("*", *(F.lag(f"c{n}").over(near).alias(f"before{n}") for n in range(1, order)))
    left = F.greatest(F.lit(1), F.lit(total) - (F.col("size") if held_out else F.lit(0)))
    made, backed = F.log(F.when(F.col("c1") > 0, F.col("c1")).otherwise(backoff) / left), F.lit(0)
    for n in range(2, order + 1):
        seen = F.log(F.col(f"c{n}") / F.greatest(F.lit(1), F.coalesce(f"before{n - 1}", F.lit(0))))
        made = F.when(F.col(f"c{n}") > 0, seen).when(F.col(f"c{n}").isNotNull(), F.log(F.lit(backoff)) + made).otherwise(made)
        backed = F.when(F.col(f"c{n}").isNotNull(), (F.col(f"c{n}") <= 0).cast("int")).otherwise(backed)
    summed = at.groupBy("doc").agg(F.count("*").alias("n_words"), F.sum(backed).cast("bigint").alias("n_backed_off"), F.sum(made).alias("log_score"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    out = own.select(F.col("doc")).join(summed, "doc", "left").select(F.col("doc").alias("doc_id"), zero("n_words", "bigint"), zero("n_backed_off", "bigint"), zero("log_score", "double"))
    return out.withColumn("mean_log_score", F.coalesce(F.try_divide("log_score", "n_words"), F.lit(0.0)))
