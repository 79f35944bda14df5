"""Seeded uniforms that do not depend on partitions or order: digits of a hash of labelled parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def uniform(seed: int, *parts: Column | str) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of SHA-256."""
    text = F.concat_ws(SEPARATOR, F.lit(str(seed)), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def derive_seed(seed: int, *labels: str) -> int:
    """63 bits for a named part of a run."""
    path = SEPARATOR.join([str(seed), *labels])
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> 1


def pick(cumulative: Column, u: Column) -> Column:
    """The first entry of a cumulative array<struct<cum,token>> whose cum exceeds u."""
    return F.element_at(F.filter(cumulative, lambda x: x["cum"] > u), 1)["token"]
