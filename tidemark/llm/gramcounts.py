"""Global counts of word n-grams, exchanged between blocks of documents and hash buckets.

Documents are dealt into blocks.  A block sends each hash bucket the distinct
n-gram hashes that fall into it, sorted and delta-coded, with its own counts;
the bucket, which holds that part of the count table, sums over the blocks and
answers each with the global counts in the order asked.  So an n-gram moves
once for each block that has it, however often it occurs, and no key can be
hot.  Blocks and buckets grow with the input, a part's memory does not.  A
block sends nothing to buckets of which it has no n-gram, so there are never
more messages than distinct n-grams of the blocks: the messages shrink down to
single rows as the input grows, and their number stays in proportion to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import parts_for

U = np.uint64
BLOCK_BYTES = 4 << 20
RIGHT = "block int, kind int, bucket int, blob binary, keys array<string>"
_RIGHT = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("keys", pa.list_(pa.string()))])

Grams = Callable[[pa.Table, pa.Table], list[tuple[np.ndarray, np.ndarray]]]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length and of fixed kinds, bytes of equal weight together."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(a) for a in arrays))


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(_unplanes(raw[at : at + n * s], k))
        at += n * s
    return out


def deltas(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=U(0))


def block_of(*keys: str | Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def blocks_for(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return parts_for(docs, block_bytes)


def _bounds(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's slice of the sorted hashes begins; bucket k has the k-th part of the hash range."""
    edges = np.array([((k << 64) + buckets - 1) // buckets for k in range(1, buckets)], dtype=U)  # one number a bucket, as in any shuffle
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def _answer(rows: pa.Table) -> pa.Table:
    out = []
    kinds = rows.column("kind").to_numpy()
    blocks, blobs = rows.column("block").to_pylist(), rows.column("blob").to_pylist()
    bucket = rows.column("bucket")[0].as_py()
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind).tolist()
        parts = [unsqueeze(blobs[i], "<u8", "<u4") for i in own]
        h = np.concatenate([np.cumsum(p[0]) for p in parts])
        _, back = np.unique(h, return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)) if len(h) else np.zeros(0)
        seen = count[back].astype(np.uint64)
        at = 0
        for i, p in zip(own, parts, strict=True):
            out.append((blocks[i], kind, bucket, squeeze(seen[at : at + len(p[0])]), None))
            at += len(p[0])
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_RIGHT)], schema=_RIGHT)


def exchange(blocked: DataFrame, known: DataFrame, grams: Grams, buckets: int) -> DataFrame:
    """Answers for each block, as rows of RIGHT.

    ``grams`` gets the rows of a block and of ``known`` and returns, for each
    kind, the block's sorted distinct hashes and their counts.
    """

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for kind, (h, count) in enumerate(grams(left, right)):
            cut = _bounds(h, buckets)
            for bucket in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[bucket], cut[bucket + 1])
                out.append((key[0].as_py(), kind, bucket, squeeze(deltas(h[part]), count[part].astype(np.uint32)), None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_RIGHT)], schema=_RIGHT)

    asked = blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(ask, RIGHT)
    return asked.groupBy("bucket").applyInArrow(_answer, RIGHT)


def answers(right: pa.Table, kinds: int) -> list[np.ndarray]:
    """For each kind the global counts in the order asked, from the rows of one block."""
    kind, bucket, blob = (right.column(c).to_pylist() for c in ("kind", "bucket", "blob"))
    parts: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    for k, _, i in sorted((k, b, i) for i, (k, b) in enumerate(zip(kind, bucket, strict=True)) if k is not None and k >= 0):
        parts[k].append(unsqueeze(blob[i], "<u8")[0])
    return [np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in parts]


def no_keys(blocked: DataFrame) -> DataFrame:
    """An empty right side."""
    return blocked.sparkSession.createDataFrame([], RIGHT)

