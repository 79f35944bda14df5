"""Training-order materialisation of token ids as fixed-stride binary shards.

Every text is encoded, closed by an end mark and cut into sequences of
``length`` ids.  The sequences are numbered without gaps (rows of the
partitions before, then order inside the partition), a keyed Feistel
permutation with cycle-walking gives each its global slot, and shard k holds
the slots from k * rows on, one record of ``stride`` bytes after the other.
A reader finds slot s at byte (s mod rows) * stride of shard s div rows.

A record is: document id (int64), number of the sequence in its document
(uint32), ids used (uint16), then ``length`` ids (uint16, or uint32 where the
vocabulary needs it, padded with zeros) and one newline, all little-endian.
Shards are dealt out by range: part p of P gets the shards from p * S / P on, so
a part's files follow each other in training order; slots are uniform, so the
ranges are known without a sample of the rows.  Shards are written through Spark's
text sink, whose line end is that newline, so commit, retry and any file system
work as for all tables.

Defined results: null and empty texts are one sequence with the end mark alone; a
very long text is cut into sequences like any other; a null id is written as the
smallest int64; repeated rows are kept; other columns are left out, whatever their
names; an empty table writes no shard.
"""

from __future__ import annotations

import array
import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.feistel import permute
from tidemark.llm.storage import parts_for
from tidemark.llm.textkernel import slices

#: The same cuts as the tokenizer's published pattern (tested), with possessive repeats and the commonest case first.
POSSESSIVE = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
HEAD = np.dtype([("doc", "<i8"), ("seq", "<u4"), ("n", "<u2")])
NO_ID = -(1 << 63)
#: Records of a shard: 17 MB of 256 ids of two bytes.
ROWS = 1 << 15
#: Records that a reader unpacks at once.
PIECE = 1 << 12


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def id_type(path: str, pattern: str) -> str:
    """Two bytes for an id where the end mark, the largest one, fits in."""
    return "<u2" if encoding(path, pattern).max_token_value + 1 < 1 << 16 else "<u4"


def _ids(own: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return np.frombuffer(array.array("I", own.encode_ordinary(text or "")), np.uint32)


def record_type(length: int, kind: str = "<u2") -> np.dtype:
    return np.dtype([("head", HEAD), ("ids", kind, (length,)), ("end", "u1")])


def _records(doc: np.ndarray, texts: list[str | None], length: int, own: tiktoken.Encoding, kind: str) -> np.ndarray:
    """Records of some documents."""
    end = own.max_token_value + 1
    ids = [np.append(_ids(own, t), end).astype(kind) for t in texts]
    pieces = np.array([-(-len(x) // length) for x in ids], np.int64)
    out = np.zeros(int(pieces.sum()), record_type(length, kind))
    owner = np.repeat(np.arange(len(ids)), pieces)
    first = np.cumsum(pieces) - pieces
    out["head"]["doc"] = doc[owner]
    out["head"]["seq"] = np.arange(len(owner)) - first[owner]
    out["end"] = 10
    for i, x in enumerate(ids):
        rows = out["ids"][first[i] : first[i] + pieces[i]]
        full = np.zeros(rows.shape[0] * length, kind)
        full[: len(x)] = x
        rows[:] = full.reshape(-1, length)
        n = out["head"]["n"][first[i] : first[i] + pieces[i]]
        n[:] = length
        n[-1] = len(x) - (pieces[i] - 1) * length
    return out


def write(docs: DataFrame, folder: str, *, path: str, pattern: str, key: bytes, length: int = 256, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 4 << 20) -> int:
    """Write all sequences below ``folder``; returns their number.

    ``docs`` is read twice and must give equal partitions both times, as scans
    of files do; the second pass counts again and fails if they differ.
    """
    kind = id_type(path, pattern)
    source = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = encoding(path, pattern), 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                n += sum(len(own.encode_ordinary(t or "")) // length + 1 for t in piece.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = {r["part"]: r["n"] for r in source.select("text").mapInArrow(count, "part int, n bigint").collect()}  # one row for each partition
    total = sum(counts.values())
    if total == 0:
        return 0
    starts, at = {}, 0
    for part in sorted(counts):
        starts[part], at = at, at + counts[part]
    shared = docs.sparkSession.sparkContext.broadcast((starts, counts))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoding(path, pattern), TaskContext.get().partitionId()
        start, most = shared.value[0].get(part, 0), shared.value[1].get(part, 0)
        done = 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                made = _records(piece.column("doc").to_numpy(), piece.column("text").to_pylist(), length, own, kind)
                slot = permute(np.arange(start + done, start + done + len(made)), total, key)
                done += len(made)
                size = made.dtype.itemsize - 1
                body = np.ascontiguousarray(made.view(np.uint8).reshape(len(made), -1)[:, :size])
                offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * size)
                payload = pa.Array.from_buffers(pa.binary(), len(made), [None, offsets.buffers()[1], pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(slot // rows, pa.int64()), pa.array(slot, pa.int64()), payload], names=["shard", "slot", "record"])
        if done != most:
            raise RuntimeError("the input was dealt into other partitions than before; store it first")

    shards = -(-total // rows)
    made = source.mapInArrow(number, "shard bigint, slot bigint, record binary")
    parts = min(shards, parts_for(docs, part_bytes))
    place = (F.col("shard") * F.lit(parts) / F.lit(shards)).cast("int")
    dealt = made.repartitionById(parts, place).sortWithinPartitions("shard", "slot")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return total


def read(spark: SparkSession, folder: str, *, length: int = 256, rows: int = ROWS, from_slot: int = 0, kind: str = "<u2", packed: bool = False) -> DataFrame:
    """Records from a slot on: doc_id, seq_no, n_tokens, ids, ids_crc32, slot, shard and byte_offset.

    ``packed``: the ids as the bytes that are stored, little-endian and without padding.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.col("shard").cast("bigint").alias("shard"), "content")
    wanted = files.filter(F.col("shard") >= from_slot // rows)
    layout, width = record_type(length, kind), np.dtype(kind).itemsize

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                whole = np.frombuffer(body.as_buffer(), layout)
                first = max(0, from_slot - shard * rows)
                for at in range(first, len(whole), PIECE):
                    own = whole[at : at + PIECE]
                    place, n = np.arange(at, at + len(own)), own["head"]["n"].astype(np.int64)
                    values, ends = own["ids"][np.arange(length) < n[:, None]], np.append(0, np.cumsum(n)).astype(np.int32)
                    if packed:
                        ids = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends * width), pa.py_buffer(values)])
                    else:
                        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
                    doc = own["head"]["doc"]
                    raw = memoryview(np.ascontiguousarray(own)).cast("B")
                    begin = (np.arange(len(own)) * layout.itemsize + HEAD.itemsize).tolist()
                    check = [zlib.crc32(raw[a : a + width * k]) for a, k in zip(begin, n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc.astype(np.int64), mask=doc == NO_ID), pa.array(own["head"]["seq"].astype(np.int64)), pa.array(n), ids, pa.array(check, pa.int64()), pa.array(shard * rows + place, pa.int64()), pa.array(np.full(len(own), shard), pa.int64()), pa.array(place * layout.itemsize, pa.int64())],
                        names=["doc_id", "seq_no", "n_tokens", "ids", "ids_crc32", "slot", "shard", "byte_offset"],
                    )

    return wanted.mapInArrow(parse, f"doc_id bigint, seq_no bigint, n_tokens bigint, ids {'binary' if packed else 'array<int>'}, ids_crc32 bigint, slot bigint, shard bigint, byte_offset bigint")
