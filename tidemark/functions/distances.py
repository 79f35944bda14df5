"""Distances between two samples held in one frame with a column ``side`` ('a' or 'b'): no outer joins, one group-by each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import cumulate


def whole() -> Window:
    """All rows; only used over distinct values or groups."""
    return Window.partitionBy()



def _shares(frame: DataFrame, key: str) -> DataFrame:
    """p and q of each category."""
    n = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = frame.groupBy(key).agg(n("a").alias("na"), n("b").alias("nb"))
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole())), F.lit(0.0))
    return counts.select(key, "na", "nb", part("na").alias("p"), part("nb").alias("q"))


def _jsd(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (term(p) + term(q)) / 2


def total_variation(frame: DataFrame, key: str) -> DataFrame:
    return _shares(frame, key).agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("value"))


def jensen_shannon(frame: DataFrame, key: str) -> DataFrame:
    """In bits, between 0 and 1."""
    return _shares(frame, key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(_jsd(F.col("p"), F.col("q"))))), 6).alias("value"))


def _steps(frame: DataFrame, value: str) -> DataFrame:
    """Both distribution functions at each distinct value, summed up in slices of the values' order."""
    n = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = frame.groupBy(F.col(value).alias("x")).agg(n("a").alias("na"), n("b").alias("nb"))
    share = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_total"))
    return cumulate(counts.filter("x is not null"), "x", ["na", "nb"]).select("x", share("na").alias("fa"), share("nb").alias("fb"), "next")


def ks(frame: DataFrame, value: str) -> DataFrame:
    return _steps(frame, value).agg(F.round(F.max(F.abs(F.col("fa") - F.col("fb"))), 6).alias("value"))


def wasserstein1(frame: DataFrame, value: str) -> DataFrame:
    return _steps(frame, value).agg(F.round(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("x"))), 4).alias("value"))


def transition_jsd(frame: DataFrame) -> DataFrame:
    """Divergence of each state's next tokens, weighted by the real ('a') mass; a state absent from 'b' counts 1."""
    n = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = frame.groupBy("context", "token").agg(n("a").alias("na"), n("b").alias("nb"))
    w = Window.partitionBy("context")
    rows = counts.select("context", "na", "nb", F.sum("na").over(w).alias("ta"), F.sum("nb").over(w).alias("tb")).filter("ta > 0")
    own = _jsd(F.col("na") / F.col("ta"), F.coalesce(F.try_divide("nb", "tb"), F.lit(0.0)))
    states = rows.groupBy("context", "ta", "tb").agg(F.sum(own).alias("d")).withColumn("d", F.when(F.col("tb") == 0, 1.0).otherwise(F.col("d")))
    return states.agg(F.round(F.sum(F.col("d") * F.col("ta")) / F.sum("ta"), 6).alias("value"))


def _letter(number: Column) -> Column:
    """A code point of its own for each number from 1 to a million, in UTF-8: the planes from U+10000 on."""
    point = number + F.lit(0x10000)
    byte = lambda lead, shift, mask: F.lpad(F.hex((F.shiftright(point, shift).bitwiseAND(F.lit(mask))).bitwiseOR(F.lit(lead))), 2, "0")
    return F.decode(F.unhex(F.concat(byte(0xF0, 18, 0x07), byte(0x80, 12, 0x3F), byte(0x80, 6, 0x3F), byte(0x80, 0, 0x3F))), "UTF-8")


def edit_distance(a: Column, b: Column) -> Column:
    """Normalised edit distance of two token arrays; each token of the two is one code point of the private planes."""
    known = F.array_distinct(F.concat(a, b))
    text = lambda s: F.array_join(F.transform(s, lambda t: _letter(F.array_position(known, t))), "")
    return F.coalesce(F.try_divide(F.levenshtein(text(a), text(b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))
