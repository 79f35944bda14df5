"""Contiguous shards of equal bytes, in DataFrame functions alone.

Rows that are equal in key, size and checksum are counted as one group, so that no
key can be hot.  Groups are put in order of their key by range partitions and
stored; the bytes and rows of each partition give its global offset, a running sum
inside the partition gives each group's, and the global byte range is cut at equal
targets.  A row goes where its middle byte falls, so a shard misses its share by at
most half of the row at either end.

Defined results: a null text has no bytes; a very long text is one row of its size;
null keys come first; rows of a group are interchangeable, and come back as many as
they were; other columns are left out, whatever their names; an empty table gives no
rows; with more shards than rows some stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, parts_for

#: Bytes that a row takes besides its text, fixed by the contract.
OVERHEAD = 8
PART_BYTES = 32 << 20
#: Rows of a group that are laid out at once.
RUN = 1 << 12


def by_bytes(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """key, size, text_crc32, shard and slot (its place in the shard, from 0) of every row."""
    parts = parts_for(docs, part_bytes)
    body = F.coalesce(F.col(text), F.lit(""))
    order = ["key", "size", "crc"]
    sized = docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc"))
    groups = sized.groupBy(*order).agg(F.count("*").alias("n"))
    stored = materialize(groups.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sharding")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"))
    total = totals.agg(F.sum("bytes")).first()[0] or 0
    earlier = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumn("bytes1", F.coalesce(F.sum(F.col("size") * F.col("n")).over(earlier), F.lit(0))).withColumn("rows1", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one row of offsets for each range partition of 32 MB; the planner decides whether it is sent or sorted
    begun = placed.join(offsets, "part").select(*order, "n", (F.col("byte0") + F.col("bytes1")).alias("byte"), (F.col("row0") + F.col("rows1")).alias("rank"))
    runs = begun.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))).alias("from"))
    each = runs.select("*", F.explode(F.sequence("from", F.least(F.col("n") - 1, F.col("from") + RUN - 1))).alias("nth"))
    ranked = each.select(
        *order,
        (F.col("rank") + F.col("nth")).alias("rank"),
        F.expr(f"least({shards - 1}, (cast(2 * (byte + nth * size) + size AS decimal(20, 0)) * {shards}) div (2 * {max(total, 1)}L))").cast("int").alias("shard"),
    )
    starts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # one row for each shard at most
    return ranked.join(F.broadcast(starts), "shard").select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
    )
