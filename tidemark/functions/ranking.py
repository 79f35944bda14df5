"""Gapless ranks of a whole table by a hash, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal slices of [0, 1); the table of their sizes is all that one task sees.
SLICES = 4096


def seeded_rank(rows: DataFrame, u: Column, tie: str, name: str = "rank") -> DataFrame:
    """Rows with their rank (from 1) by the uniform ``u``, ties by ``tie``.

    Slices of u are ranked in parallel; the sum of the sizes of those below is
    added.  u must not depend on the order of rows, as rows are read twice.
    """
    placed = rows.withColumn("__u", u).withColumn("__slice", F.floor(F.col("__u") * SLICES).cast("int"))
    sizes = placed.groupBy("__slice").agg(F.count("*").alias("__n"))
    below = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__slice", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy("__u", tie))
    return placed.withColumn(name, inside).join(F.broadcast(offsets), "__slice").withColumn(name, F.col(name) + F.col("__below")).drop("__u", "__slice", "__below")


def _slice(x: Column) -> Column:
    """A whole number that never falls where ``x`` rises: 32 slices for each power of two."""
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1e308))) * 32) + 40_000
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def cumulate(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``counts``, a row for each distinct ``value`` (of a group ``by``), with <sum>_before, <sum>_total and ``next``.

    Values are summed up inside slices of their order; one task sees no more than
    a slice, and the sums of all slices, of which there are at most 170,000.
    """
    placed = counts.withColumn("__x", F.col(value).cast("double")).withColumn("__slice", _slice(F.col("__x")))
    slices = placed.groupBy(*by, "__slice").agg(F.min("__x").alias("__low"), *(F.sum(c).alias(f"__{c}") for c in sums))
    order, whole = Window.partitionBy(*by).orderBy("__slice"), Window.partitionBy(*by)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = slices.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__slice").alias("__at"), F.lead("__low").over(order).alias("__follows"), *(zero(f"__{c}", below).alias(f"__b_{c}") for c in sums), *(F.sum(f"__{c}").over(whole).alias(f"{c}_total") for c in sums))
    inside = Window.partitionBy(*by, "__slice").orderBy("__x")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.select("*", F.lead("__x").over(inside).alias("__near"), *(zero(c, earlier).alias(f"__i_{c}") for c in sums))
    same = F.col("__slice") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    made = ranked.join(offsets, same)
    return made.select(*counts.columns, F.coalesce("__near", "__follows").alias("next"), *((F.col(f"__i_{c}") + F.col(f"__b_{c}")).alias(f"{c}_before") for c in sums), *(f"{c}_total" for c in sums))


def _counted(frame: DataFrame, value: Column, by: tuple[str, ...]) -> DataFrame:
    rows = frame.select(*by, value.cast("double").alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    return cumulate(rows, "__v", ["__n"], by).withColumn("__z", F.col("__n_before") + F.col("__n"))


def quantiles(frame: DataFrame, value: Column, names: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles, linear between neighbours, of each group; a single row where there is none."""
    ranked, picks = _counted(frame, value, by), []
    for name, p in names.items():
        place = (F.col("__n_total") - 1) * p
        low = F.floor(place)
        at = lambda k: F.max(F.when((F.col("__n_before") <= k) & (k < F.col("__z")), F.col("__v")))
        first, second, part = at(low), at(F.ceil(place)), F.max(place - low)
        picks.append((first + (second - first) * part).alias(name))
    return ranked.groupBy(*by).agg(*picks)


def order_statistics(frame: DataFrame, value: Column, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, points): all values in order, or ``most`` evenly spaced ones at ranks rounded half to even."""
    ranked = _counted(frame, value, by)
    n = F.col("__n_total")
    step = F.when(n <= most, F.lit(1.0)).otherwise((n - 1) / F.lit(most - 1.0))
    last = F.least(n, F.lit(most)) - 1
    low = F.greatest(F.lit(0), F.floor((F.col("__n_before") - 1) / step)).cast("bigint")
    high = F.least(last, F.ceil((F.col("__z") + 1) / step)).cast("bigint")
    spread = ranked.select(*by, "__v", "__n_before", "__z", n.alias("n"), step.alias("__step"), F.explode(F.sequence(low, F.greatest(low, high))).alias("__i")).filter(F.col("__i") <= F.least(F.col("n"), F.lit(most)) - 1)
    rank = F.bround(F.col("__i") * F.col("__step"))
    hit = spread.filter((rank >= F.col("__n_before")) & (rank < F.col("__z")))
    return hit.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias("points"))
