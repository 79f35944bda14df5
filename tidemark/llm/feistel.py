"""Keyed permutations of {0, ..., n - 1}: Feistel rounds with cycle-walking."""

from __future__ import annotations

import hashlib

import numpy as np

from tidemark.llm.textkernel import mix64

ROUNDS = 8


def round_keys(key: bytes, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(key, digest_size=8, person=b"round%011d" % i).digest(), "little") for i in range(rounds)]


def _half(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def permute(index: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """Slots of the indices; a bijection of range(n) for n up to 2**62.

    The Feistel network works on the smallest even number of bits that holds
    n - 1, fewer than 4 n values, so a walk back into the range is short.
    """
    half = np.uint64(_half(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(k) for k in round_keys(key)]
    out = index.astype(np.uint64)
    rest = np.arange(len(out))
    while len(rest):
        left, right = out[rest] >> half, out[rest] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        x = left << half | right
        out[rest] = x
        rest = rest[x >= np.uint64(n)]
    return out.astype(np.int64)


def permute_number(x: int, n: int, key: bytes) -> int:
    """As permute() for one number of any size, with a cryptographic round function."""
    if n < 2:
        return x
    half = _half(n)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            body = bytes([i]) + right.to_bytes(size, "little")
            got = b"".join(hashlib.blake2b(body, key=key[:64], salt=j.to_bytes(16, "little")).digest() for j in range(-(-size // 64)))
            left, right = right, left ^ (int.from_bytes(got[:size], "little") & mask)
        x = left << half | right
        if x < n:
            return x
