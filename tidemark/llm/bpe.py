"""Byte-level BPE with a rank file, run by a sentencepiece model built from it.

The vocabulary's byte strings are written as pieces of a sentencepiece BPE
model, every byte standing for one printable code point, with the negative rank
as score and an identity normaliser; the piece number is the rank.  Texts are
cut by the tokenizer's pattern, each pre-token is encoded by itself, and ids
are decoded by the inverse map.

Defined results: a null text is encoded as the empty one (no ids); rows and
columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.arrowmap import add_columns

#: Code points U+0100 to U+01FF stand for the bytes 0 to 255.
_FIRST = 0x100
_BYTE_TO_CHAR = {b: chr(_FIRST + b) for b in range(256)}
CACHE_ENTRIES = 1 << 17
CACHE_CHARS = 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def mapped(raw: bytes) -> str:
    """One code point for each byte."""
    return "".join(map(_BYTE_TO_CHAR.__getitem__, raw))


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; ``vocabulary`` is in order of rank.

    Field numbers are those of the public model format: pieces 1 (piece 1,
    score 2, type 3), trainer 2 (model type 3, id of unk 40, bos 41, eos 42,
    pad 43), normaliser 3 (name 1, dummy prefix 3, extra spaces 4, escape 5).
    """
    out = []
    for rank, raw in enumerate(vocabulary):
        score = np.float32(-rank).tobytes()
        out.append(_field(1, _field(1, mapped(raw).encode()) + b"\x15" + score + _number(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _number(3, 2)))
    minus_one = (1 << 64) - 1
    trainer = _number(3, 2) + _number(40, len(vocabulary)) + b"".join(_number(i, minus_one) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file (base64 and rank on each line) in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = sorted((int(r), base64.b64decode(b)) for b, r in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [b for _, b in ranks]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.rank = {b: i for i, b in enumerate(vocabulary)}
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocabulary))
        self.known: dict[str, tuple[int, ...]] = {}
        length = np.array([len(b) for b in vocabulary] or [0], np.int64)
        self.length, self.start = length, np.cumsum(length) - length
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    def _learn(self, new: list[str]) -> None:
        """Encode pre-tokens; whole ones of the vocabulary are taken as they are, the others merged."""
        raw = [x.encode() for x in new]
        rest = [i for i, b in enumerate(raw) if b not in self.rank]
        merged = self.pieces.encode([mapped(raw[i]) for i in rest], out_type=int, num_threads=1) if rest else []
        known = self.known
        for i, b in enumerate(raw):
            if b in self.rank:
                known[new[i]] = (self.rank[b],)
        for i, ids in zip(rest, merged, strict=True):
            known[new[i]] = tuple(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian uint32."""
        out = []
        for text in texts:
            cut = self.find(text) if text else []
            known = self.known
            new = [x for x in set(cut) if x not in known]
            if new:
                if len(known) + len(new) > CACHE_ENTRIES:
                    known.clear()
                    new = list(set(cut))
                self._learn(new)
            ids: list[int] = []
            for x in cut:
                ids += known[x]
            out.append(np.array(ids, "<u4"))
            for x in new:
                if len(x) > CACHE_CHARS:
                    del known[x]
            if len(known) > CACHE_ENTRIES:
                known.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, joined."""
        if not len(ids):
            return b""
        n = self.length[ids]
        total = int(n.sum())
        at = np.arange(total) + np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        return self.bytes[at].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, kept by the Python worker."""
    return Codec(read_ranks(path), pattern)


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids (array of long) of each text."""
    field = T.StructField(ids, T.ArrayType(T.IntegerType()))

    def work(column: pa.Array) -> list:
        made = codec(path, pattern).encode(column.to_pylist())
        offsets = np.cumsum([0, *map(len, made)]).astype(np.int32)
        values = np.concatenate(made).astype(np.int32) if made else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

    return add_columns(docs, text, [field], work, most=1 << 20)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the number of tokens and the digests of the ids and of the bytes decoded from them."""

    def work(column: pa.Array) -> list:
        own = codec(path, pattern)
        made = own.encode(column.to_pylist())
        return [[len(x) for x in made], [hashlib.sha256(x.tobytes()).hexdigest() for x in made], [hashlib.sha256(own.decode(x)).hexdigest() for x in made]]

    out = add_columns(docs, text, FIELDS, work, most=1 << 20)
    return out if keep_text else out.drop(text)
