"""When sessions may start: two small tables of weights, of days and of hours, in a time zone.

A timetable is relations, not settings: ``days(day, weight)`` and ``hours(hour,
weight)`` are DataFrames, made by ``opening`` from a plan, by ``learned`` from a log,
or by hand.  Draws and look-ups join their one-row digest to the rows at hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.randomness import pick, uniform

#: A timetable's days are sent to every executor: so many at most, a hundred years.
MOST_DAYS = 36_600
#: Sessions that a rush needs to be measured, and standard errors that its ratio may be off.
LEAST_IN_RUSH, ERRORS = 20, 3.0


class Timetable(NamedTuple):
    """Weighted days and hours; ``rushes(due, lead, boost)`` are the ones already in the weights, kept to be checked."""

    days: DataFrame
    hours: DataFrame
    rushes: DataFrame
    zone: str

    def digest(self) -> DataFrame:
        """One row: shares of days and hours in order, and those that are open."""
        up = lambda by: F.sum("weight").over(Window.orderBy(by)) / F.sum("weight").over(Window.partitionBy())
        packed = lambda table, by: table.select(F.struct(up(by).alias("cum"), F.col(by).alias("token")).alias("x"), F.when(F.col("weight") > 0, F.col(by)).alias("y")).agg(F.array_sort(F.collect_list("x")).alias(f"{by}s"), F.array_sort(F.collect_list("y")).alias(f"open_{by}s"))
        return packed(self.days, "day").join(packed(self.hours, "hour"), F.lit(True))

    def draw(self, rows: DataFrame, seed: int, *entity: str, name: str = "start_time") -> DataFrame:
        """``rows`` with a start: day and hour by weight, uniform inside the hour."""
        key = [F.col(c) for c in entity]
        day, hour = pick(F.col("days"), uniform(seed, "day", *key)), pick(F.col("hours"), uniform(seed, "hour", *key))
        at = F.unix_micros(day.cast("timestamp_ntz").cast("timestamp")) + hour * 3_600_000_000 + F.floor(uniform(seed, "within", *key) * 3_600_000_000)
        return rows.join(F.broadcast(self.digest()), F.lit(True)).select(*(rows[c] for c in rows.columns if c != name), F.to_utc_timestamp(F.timestamp_micros(at.cast("bigint")), self.zone).alias(name))

    def next_open(self, rows: DataFrame, moment: str, name: str) -> DataFrame:
        """``rows`` with the first time from ``moment`` on in an open hour of an open day; the moment itself if none is left.  The session's zone must be UTC."""
        local = F.from_utc_timestamp(F.col(moment), self.zone)
        today = F.to_date(local)
        slot = lambda day, hour: F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + hour * 3600)
        hour_left = F.get(F.filter("open_hours", lambda h: h >= F.hour(local)), F.lit(0))
        day_left = F.get(F.filter("open_days", lambda d: d > today), F.lit(0))
        here = F.when(F.array_contains("open_days", today) & hour_left.isNotNull(), F.greatest(slot(today, hour_left), local))
        first = F.coalesce(here, slot(day_left, F.get("open_hours", F.lit(0))))
        return rows.join(F.broadcast(self.digest()), F.lit(True)).select(*(rows[c] for c in rows.columns if c != name), F.coalesce(F.to_utc_timestamp(first, self.zone), F.col(moment)).alias(name))

    def check(self, sessions: DataFrame, tolerance: float = 0.2) -> DataFrame:
        """(control, target, measured, bound, status) of the starts of ``sessions``.

        'period' and 'closed' count starts outside the days (and the one after)
        or in closed hours; 'distribution' is the distance to the weights, which
        may be max(0.1, 0.75 sqrt(k / n)); a rush is measured by how far the
        starts a day in it, over those on other days, are from what the weights
        say.  Without starts, or too few in a rush, nothing is measurable.
        """
        local = F.from_utc_timestamp(F.col("start_time"), self.zone)
        starts = sessions.select(F.to_date(local).alias("day"), F.hour(local).alias("hour")).groupBy("day", "hour").agg(F.count("*").alias("n"))
        per_day, per_hour = (starts.groupBy(c).agg(F.sum("n").alias("n")) for c in ("day", "hour"))
        total = starts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        span = self.days.agg(F.min("day").alias("lo"), F.date_add(F.max("day"), 1).alias("hi"))
        zero = F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("measured")
        name = lambda control, target: [F.lit(control).alias("control"), F.lit(target).alias("target")]
        outside = per_day.join(F.broadcast(span), F.lit(True)).filter(~F.col("day").between(F.col("lo"), F.col("hi"))).agg(zero)
        closed = per_hour.join(F.broadcast(self.hours.filter("weight = 0")), "hour").agg(zero)
        closed = closed.join(self.hours.filter("weight = 0").limit(1).select(F.lit(1).alias("any")), F.lit(True))
        counted = [outside.select(*name("calendar", "period"), "measured", F.lit(0.0).alias("bound")), closed.select(*name("calendar.hours", "closed"), "measured", F.lit(0.0).alias("bound"))]
        by_weekday = lambda t, v: t.groupBy(F.weekday("day").alias("k")).agg(F.sum(v).cast("double").alias(v))
        spread = [
            _distance(self.hours.select(F.col("hour").alias("k"), "weight"), per_hour.select(F.col("hour").alias("k"), "n")).select(*name("calendar.hours", "distribution"), "measured", "bound"),
            _distance(by_weekday(self.days, "weight"), by_weekday(per_day, "n")).select(*name("calendar.weekdays", "distribution"), "measured", "bound"),
        ]
        status = F.when(F.col("n") == 0, "not_measurable").when(F.col("measured") <= F.col("bound"), "ok").otherwise("failed")
        made = counted[0].unionByName(counted[1]).unionByName(spread[0]).unionByName(spread[1]).join(total, F.lit(True)).withColumn("status", status).drop("n")
        return made.unionByName(self._rushes(per_day, tolerance)).withColumn("measured", F.round("measured", 6)).withColumn("bound", F.round("bound", 6))

    def _rushes(self, per_day: DataFrame, tolerance: float) -> DataFrame:
        days = self.days.join(per_day, "day", "left").select("day", "weight", F.coalesce("n", F.lit(0)).alias("n"))
        own = days.join(F.broadcast(self.rushes), F.lit(True)).withColumn("rush", F.col("day").between(F.expr("date_sub(due, lead)"), F.col("due")))
        of = lambda c, v: F.avg(F.when(c, F.col(v).cast("double")))
        rush, rest = F.col("rush"), ~F.col("rush") & (F.col("weight") > 0)
        sums = own.groupBy("due", "lead").agg(of(rush, "weight").alias("w1"), of(rest, "weight").alias("w0"), of(rush, "n").alias("r1"), of(rest, "n").alias("r0"), F.sum(F.when(rush, F.col("n"))).alias("n1"), F.sum(F.when(rest, F.col("n"))).alias("n0"))
        off = F.abs(F.try_divide(F.try_divide("r1", "r0"), F.try_divide("w1", "w0")) - 1)
        bound = F.greatest(F.lit(tolerance), ERRORS * F.sqrt(1 / F.greatest("n1", F.lit(1)) + 1 / F.greatest("n0", F.lit(1))))
        status = F.when(off.isNull() | (F.coalesce("n1", F.lit(0)) < LEAST_IN_RUSH), "not_measurable").when(off <= bound, "ok").otherwise("failed")
        return sums.select(F.lit("calendar.deadlines").alias("control"), F.col("due").cast("string").alias("target"), off.alias("measured"), bound.alias("bound"), status.alias("status"))


def _distance(weights: DataFrame, counts: DataFrame) -> DataFrame:
    """Total variation between weights and counts by ``k``, and its bound; one row."""
    both = weights.join(counts, "k", "left").select("weight", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy()))
    parts = both.select("n", F.abs(share("n") - share("weight")).alias("d"))
    return parts.agg((F.sum("d") / 2).alias("measured"), F.greatest(F.lit(0.1), 0.75 * F.sqrt(F.try_divide(F.count("*"), F.sum("n")))).alias("bound"))


def _checked(table: Timetable) -> Timetable:
    n = table.days.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    if not n["n"] or n["n"] > MOST_DAYS:
        raise ValueError(f"a timetable has 1 to {MOST_DAYS} days")
    if not (n["w"] or 0) > 0 or not (table.hours.agg(F.sum("weight")).first()[0] or 0) > 0:
        raise ValueError("no day or hour has a positive weight")
    return table


def _hours(spark: SparkSession, weights: Mapping[int, float] | None) -> DataFrame:
    if weights is not None and any(h not in range(24) or w < 0 for h, w in weights.items()):
        raise ValueError("hours are 0 to 23, weights not negative")
    weight = F.lit(1.0) if weights is None else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for h, w in weights.items() for x in (h, float(w)))), F.col("hour")), F.lit(0.0))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).withColumn("weight", weight)


def opening(spark: SparkSession, first: str, last: str, *, hours: Mapping[int, float] | None = None, week: Mapping[str, float] | None = None, special: Mapping[str, float] | None = None, rushes: Sequence[tuple[str, int, float]] = (), zone: str = "UTC") -> Timetable:
    """The days from ``first`` to ``last``.

    ``hours`` and ``week`` (Mon to Sun) give weights, those left out 0 where any
    is given and else 1; ``special`` replaces the weight of a day.  A rush (due,
    lead, boost) multiplies the days from ``lead`` before it to the due day.
    """
    if week is not None and not set(week) <= {"Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"}:
        raise ValueError("a week's days are Mon to Sun")
    table = lambda m, kind: F.create_map(*(F.lit(x) for k, w in m.items() for x in (k, float(w)))) if m else F.create_map().cast(f"map<{kind},double>")
    dues = spark.createDataFrame([(d, n, float(b)) for d, n, b in rushes], "due string, lead int, boost double").withColumn("due", F.col("due").cast("date"))
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    usual = F.coalesce(F.try_element_at(table(week or {}, "string"), F.date_format("day", "EEE")), F.lit(1.0 if week is None else 0.0))
    weighted = spine.select("day", F.coalesce(F.try_element_at(table(special or {}, "string"), F.col("day").cast("string")), usual).alias("weight"))
    near = weighted.join(dues, F.expr("day between date_sub(due, lead) and due"), "left").groupBy("day", "weight").agg(F.collect_list("boost").alias("boosts"))
    days = near.select("day", F.aggregate("boosts", F.col("weight"), lambda a, b: a * b).alias("weight"))
    return _checked(Timetable(days, _hours(spark, hours), dues, zone))


def from_counts(starts: DataFrame, zone: str = "UTC") -> Timetable:
    """Days and hours weighted by counts ``(day, hour, n)`` of starts."""
    counted = lambda name: starts.groupBy(name).agg(F.sum("n").cast("double").alias("weight"))
    spark = starts.sparkSession
    hours = _hours(spark, None).select("hour").join(counted("hour"), "hour", "left").select("hour", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return _checked(Timetable(counted("day"), hours, spark.createDataFrame([], "due date, lead int, boost double"), zone))


def learned(sessions: DataFrame, zone: str = "UTC") -> Timetable:
    """The days and hours in which the sessions of a log start."""
    local = F.from_utc_timestamp(F.col("start_time"), zone)
    return from_counts(sessions.groupBy(F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(F.count("*").alias("n")), zone)
