"""Benchmark decontamination by Wu-Manber search over words.

The symbols of the search are words, the patterns windows of ``window`` words
of the benchmark's items.  A block is two words; for every block the shift
table says how far the cursor may move, since no window can end before that.
Where the shift is zero, the bucket of the block's hash (and, inside it, the hash
of a window's first block) selects windows, and a direct comparison of the words'
bytes confirms an occurrence.  Many cursors advance in step, so that each move is
a vector operation.

Windows are places in the words of the items, kept as arrays: the tables take
about twelve times the bytes of the benchmark's text (stated by a test).  Their
size is checked before they are sent out; a larger benchmark is dealt into several
tables, which one scan of the documents searches in turn, one in memory at a time.

Defined results: null and empty texts have no words and no hit; a very long text is
searched whole; repeated rows are judged one by one; equal windows of several items
count for each; an empty benchmark hits nothing, and without documents there are no
rows; an item without a word has no window; an item of fewer words than ``window``
is one window; columns of ``docs`` beside the text pass through and those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as K
from tidemark.llm.arrowmap import add_columns

#: Fixed by the contract: letters and digits of ASCII, and all other code points.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
SEGMENT = 2048
#: Text of a benchmark in one table, and in all of them; pairs of positions and windows compared at once.
TABLE_BYTES, MOST_BYTES, COMPARED = 16 << 20, 1 << 30, 1 << 18

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _lowered(body: np.ndarray) -> bytes:
    return body.tobytes().lower()  # bytes.lower() touches A-Z alone


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for n numbers each."""
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


class Items:
    """Words of all items: lower-cased bytes, places, hashes and item of each word."""

    def __init__(self, texts: pa.Array):
        body, offsets = K.text_buffers(texts)
        w = K.words(body, offsets, WORD_BYTES, lower=True)
        self.low, self.hash, self.row, self.rows = _lowered(body), w.hash, w.row.astype(np.int32), w.rows
        self.start, self.end = w.start.astype(np.int32), w.end.astype(np.int32)

    def windows(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, first word of each) of the windows: ``length`` words, or all of a shorter item."""
        n = np.bincount(self.row, minlength=self.rows)
        first = np.cumsum(n) - n
        for k in range(1, length):
            if len(short := first[n == k]):
                yield k, short
        if len(self.row) >= length and len(whole := np.flatnonzero(self.row[: len(self.row) - length + 1] == self.row[length - 1 :])):
            yield length, whole


class Tables:
    """Shift table, buckets and windows of one length."""

    def __init__(self, items: Items, length: int, first: np.ndarray):
        self.length, self.block = length, min(2, length)
        key = K.fold([items.hash[first + i] for i in range(length)])
        self.key, one, same = np.unique(key, return_index=True, return_inverse=True)
        first_of = first[one].astype(np.int32)
        owners = np.unique(np.stack([same, items.row[first]]), axis=1)
        bits = max(12, int(4 * len(first_of)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        longest = min(length - self.block + 1, 255)
        self.shift = np.full(1 << bits, longest, np.uint8)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, (self._block(items.hash, first_of + j) & self.mask).astype(np.int64), np.uint8(min(length - 1 - j, longest)))
        bucket = self._bucket(items.hash, first_of + length - 1)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.first, number = bucket[order], first_of[order], np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        by = np.argsort(number[owners[0]], kind="stable")
        self.owner = owners[1][by].astype(np.int32)
        self.owner_at = np.searchsorted(number[owners[0]][by], np.arange(len(order) + 1))
        del self.key

    def _block(self, h: np.ndarray, at) -> np.ndarray:
        return K.fold([h[at - i] for i in range(self.block)])

    def _bucket(self, h: np.ndarray, last) -> np.ndarray:
        return K.fold([self._block(h, last), self._block(h, last - self.length + self.block)])

    def candidates(self, w: K.Words, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Last-word positions and window numbers whose word hashes all agree, some at a time."""
        m = self.length
        first = w.first_of_row()
        begin, stop = first[:-1] + m - 1, first[1:]
        keep = begin < stop
        begin, stop = begin[keep], stop[keep]
        pieces = -(-(stop - begin) // SEGMENT)
        owner = np.repeat(np.arange(len(begin)), pieces)
        at = begin[owner] + _spread(np.zeros(len(pieces), np.int64), pieces) * SEGMENT
        end = np.minimum(at + SEGMENT, stop[owner])
        stops = []
        while len(at):
            move = self.shift[(self._block(w.hash, at) & self.mask).astype(np.int64)]
            zero = move == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(move, 1)
            alive = at < end
            at, end = at[alive], end[alive]
        if not stops:
            return
        at = np.concatenate(stops)
        bucket = self._bucket(w.hash, at)
        low, high = np.searchsorted(self.bucket, bucket, "left"), np.searchsorted(self.bucket, bucket, "right")
        at, low, n = at[low < high], low[low < high], (high - low)[low < high]
        while len(at):
            take = np.minimum(n, COMPARED)
            some = max(1, int(np.searchsorted(np.cumsum(take), COMPARED, "right")))
            pos, window = np.repeat(at[:some], take[:some]), _spread(low[:some], take[:some])
            for i in range(m):
                same = w.hash[pos - m + 1 + i] == items.hash[self.first[window] + i]
                pos, window = pos[same], window[same]
            if len(pos):
                yield pos, window
            left = n[:some] > take[:some]
            at = np.concatenate([at[:some][left], at[some:]])
            low, n = np.concatenate([(low + take)[:some][left], low[some:]]), np.concatenate([(n - take)[:some][left], n[some:]])


class Matcher:
    """Windows of some items, as Wu-Manber tables by length."""

    def __init__(self, names: list[str], texts: pa.Array, window: int):
        self.names, self.items = names, Items(texts)
        self.tables = [Tables(self.items, k, first) for k, first in self.items.windows(window)]

    def search(self, w: K.Words, body: np.ndarray, cover: np.ndarray, found: dict[int, set[str]]) -> None:
        """Add occurrences to ``cover`` (1 at a first word, -1 behind a last one) and their items to ``found``, by row."""
        own, low = self.items, None
        for t in self.tables:
            for last, which in t.candidates(w, own):
                low = low if low is not None else _lowered(body)
                first = last - t.length + 1
                seen: dict[tuple[int, bytes], bool] = {}
                hit = np.zeros(len(last), bool)
                for k, (f, z, n) in enumerate(zip(first.tolist(), last.tolist(), which.tolist(), strict=True)):
                    key = (n, low[w.start[f] : w.end[z]])
                    if key not in seen:
                        o = int(t.first[n])
                        seen[key] = all(low[w.start[f + i] : w.end[f + i]] == own.low[own.start[o + i] : own.end[o + i]] for i in range(t.length))
                    if seen[key]:
                        hit[k] = True
                        found.setdefault(int(w.row[f]), set()).update(self.names[i] for i in t.owner[t.owner_at[n] : t.owner_at[n + 1]])
                np.add.at(cover, first[hit], 1)
                np.add.at(cover, last[hit] + 1, -1)


def _judged(column: pa.Array, parts: list[Broadcast]) -> list:
    body, offsets = K.text_buffers(column)
    w = K.words(body, offsets, WORD_BYTES, lower=True)
    cover, found = np.zeros(len(w.hash) + 1, np.int64), {}
    for part in parts:
        part.value.search(w, body, cover, found)
        if len(parts) > 1:
            part.__dict__.pop("_value", None)  # read again from the executor's file when it is next in turn
    hit = np.cumsum(cover[:-1]) > 0
    return [w.per_row(), np.bincount(w.row[hit], minlength=w.rows).astype(np.int64), [sorted(found.get(r, ())) for r in range(w.rows)]]


def find_occurrences(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, table_bytes: int = TABLE_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit and items (sorted strings) for each row.

    The benchmark is a set of tests of bounded size: its bytes are counted, and
    above ``most_bytes`` it is refused.
    """
    spark = docs.sparkSession
    size = int(benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0)
    if size > most_bytes:
        raise ValueError(f"a benchmark of {size} bytes is above the bound of {most_bytes}")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text")).filter("text is not null")
    n = max(1, -(-size // table_bytes))
    parts = []
    for k in range(n):
        own = (items if n == 1 else items.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == k)).toArrow()
        parts.append(spark.sparkContext.broadcast(Matcher(own.column("name").to_pylist(), own.column("text").combine_chunks(), window)))
    return add_columns(docs, text, FIELDS, lambda column: _judged(column, parts), most=4 << 20 if n == 1 else 32 << 20)


def items_digest(items) -> F.Column:
    """SHA-256 of the comma-joined item ids."""
    return F.sha2(F.concat_ws(",", items), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns."""
    return find_occurrences(docs, benchmark, **options).filter("n_hit = 0").select(*docs.columns)
