"""Words and word n-grams of Arrow text columns as 64-bit hashes, in NumPy.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums
of the whole buffer and passed through a finaliser, so that its cost is a few
vector operations per byte and independent of where the word stands.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_SPAN = 1 << 20

WHITESPACE = bytes(range(9, 14)) + b" "


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base & (2**64 - 1), U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SPAN * 2
    while size < n + 1:
        size *= 2
    return _powers(size)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of some texts: byte spans, hashes, and row of each word (ascending)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    rows: int

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def first_of_row(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.rows + 1))


@functools.cache
def tables(word_bytes: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the byte value that is hashed."""
    member = np.zeros(256, bool)
    member[list(word_bytes)] = True
    value = np.arange(256, dtype=np.uint16)
    if lower:
        value[65:91] += 32
    return member, (value + 1).astype(U)


NON_SPACE = bytes(b for b in range(256) if b not in WHITESPACE)


def words(body: np.ndarray, offsets: np.ndarray, word_bytes: bytes = NON_SPACE, lower: bool = False) -> Words:
    """All maximal runs of ``word_bytes`` that lie in one text."""
    member, value = tables(word_bytes, lower)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(body)
    inner = offsets[1:-1]
    while at < n:
        stop = min(n, at + _SPAN)
        if stop < n:  # cut where no word is cut
            gap = np.flatnonzero(~member[body[at:stop]])
            if len(gap) and gap[-1] > 0:
                stop = at + int(gap[-1])
            else:
                while stop < n and member[body[stop]]:
                    stop += 1
        piece = body[at:stop]
        inside = member[piece]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = inner[np.searchsorted(inner, at) : np.searchsorted(inner, stop)] - at
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        power, inverse = _powers_for(len(piece))
        total = value[piece]
        total *= power[: len(piece)]
        np.cumsum(total, out=total)
        h = total[end - 1]
        h -= np.where(start > 0, total[start - 1], U(0))
        h *= inverse[start]
        parts.append((start + at, end + at, mix64(h)))
        at = stop
    start, end, h = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64 if i < 2 else U) for i in range(3))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, h, row, len(offsets) - 1)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of word hashes."""
    total = np.full(hashes[0].shape, 0x51ED270B7F3A92C5 + len(hashes), U)
    for h in hashes:
        total = (total + h) * U(_STEP)
    return mix64(total)


def ngrams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram; ``short``: a text of fewer words is one gram by itself."""
    m = len(w.hash)
    if m >= n:
        whole = np.flatnonzero(w.row[: m - n + 1] == w.row[n - 1 :])
        out = [(fold([w.hash[whole + i] for i in range(n)]), w.row[whole])]
    else:
        out = []
    if short:
        count, first = w.per_row(), w.first_of_row()
        for k in range(1, n):
            rows = np.flatnonzero(count == k)
            if len(rows):
                out.append((fold([w.hash[first[rows] + i] for i in range(k)]), rows))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def distinct_in_rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs ordered by row, and how often each occurs."""
    pair = mix64(h + mix64(row.astype(U) * U(_BASE) + U(1)))
    order = np.argsort(pair)
    pair = pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pair)))
    at = order[first]
    back = np.argsort(row[at], kind="stable")
    at = at[back]
    return h[at], row[at], count[back]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of about ``most`` bytes of text at most, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
