"""Timing, calendar, learner and group profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import quantiles
from tidemark.operators.sequences import density, in_session


def describe(frame: DataFrame, value: str | Column, *by: str) -> DataFrame:
    """Count, mean, population deviation, extremes and linear-interpolated quartiles; nulls if there is no value."""
    v = F.col(value) if isinstance(value, str) else value
    moments = frame.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"))
    ranked = quantiles(frame, v, {"p25": 0.25, "median": 0.5, "p75": 0.75}, by)
    ranked = ranked.select(*(F.col(c).alias(f"__{c}") for c in by), *(F.round(c, 4).alias(c) for c in ("p25", "median", "p75")))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return moments.join(ranked, same, "left").select(*by, "n", "mean", "std", "min", "p25", "median", "p75", "max")


def gaps(seq: DataFrame) -> DataFrame:
    """Seconds to the next event of the session, with the earlier token; the last event has none."""
    gap = (F.lead(F.unix_micros("timestamp")).over(in_session(seq)) - F.unix_micros("timestamp")) / 1e6
    return seq.select("session_id", "token", gap.alias("gap_s")).filter("gap_s is not null")


def entropy(frame: DataFrame, key: str) -> DataFrame:
    """Entropy in bits of the distribution of ``key``."""
    counts = frame.groupBy(key).agg(F.count("*").alias("n"))
    shares = counts.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    return shares.agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"))


def session_features(seq: DataFrame) -> DataFrame:
    per = seq.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("session_id"))
    bits = per.select("session_id", (F.col("n") / total).alias("p")).groupBy("session_id").agg(F.round(F.abs(F.sum(F.col("p") * F.log2("p"))), 6).alias("type_entropy"))
    made = seq.groupBy("session_id").agg(
        F.count("*").alias("length"),
        F.round((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 1e6, 6).alias("duration_s"),
        F.count_distinct("activity_id").alias("unique_activities"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
    )
    return made.join(bits, "session_id")


def learner_profiles(events: DataFrame, sessions: DataFrame) -> DataFrame:
    own = sessions.groupBy("learner_id").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.avg("n_events").alias("mean_length"), F.avg("duration_s").alias("mean_duration_s"))
    everyone = events.groupBy("learner_id").agg(F.count_distinct("course_id").alias("n_courses"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return everyone.join(own, "learner_id", "left").select("learner_id", zero(F.col("n_sessions")).alias("n_sessions"), zero(F.col("n_events")).alias("n_events"), F.round(zero(F.col("mean_length")), 6).alias("mean_length"), F.round(zero(F.col("mean_duration_s")), 4).alias("mean_duration_s"), "n_courses")


def corpus_features(events: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Events, sessions, learners and vocabulary from one aggregate; with first-order transition counts, their density too."""
    sizes = events.agg(F.count("*").alias("n_events"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("learner_id").alias("n_learners"), F.count_distinct("event_type").alias("vocabulary"))
    return sizes if counts is None else sizes.join(density(counts).select("density"), F.lit(True))


def local(ts: str | Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def heat_map(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events by weekday (Monday 0) and hour, all 168 cells."""
    cells = events.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    t = local("timestamp", zone)
    counts = events.groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(counts), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def weekly(events: DataFrame, sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Sessions, events and active learners of each week, from the Monday of the first session to the last session's week."""
    first = sessions.agg(F.min(F.to_date(local("start_time", zone))).alias("d")).select(F.date_sub("d", F.weekday("d")).alias("monday"))
    week = lambda d: (F.floor(F.datediff(d, "monday") / 7) + 1).cast("int").alias("week")
    held = sessions.join(F.broadcast(first), F.lit(True)).groupBy(week(F.to_date(local("start_time", zone)))).agg(F.count("*").alias("n_sessions"), F.count_distinct("learner_id").alias("n_learners"))
    seen = events.join(F.broadcast(first), F.lit(True)).groupBy(week(F.to_date(local("timestamp", zone)))).agg(F.count("*").alias("n_events"))
    spine = held.agg(F.max("week").alias("last")).select(F.explode(F.sequence(F.lit(1), "last")).alias("week"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(F.broadcast(held), "week", "left").join(F.broadcast(seen), "week", "left").select("week", zero("n_sessions"), zero("n_events"), zero("n_learners"))


def between_sessions(sessions: DataFrame) -> DataFrame:
    """Seconds from a learner's session to the next, at least 0."""
    w = Window.partitionBy("learner_id").orderBy("start_time", "session_id")
    gap = (F.unix_micros("start_time") - F.lag(F.unix_micros("end_time")).over(w)) / 1e6
    return sessions.select("learner_id", F.greatest(gap, F.lit(0.0)).alias("gap_s"), F.lag("end_time").over(w).isNotNull().alias("later")).filter("later").drop("later")


def deadline_effects(sessions: DataFrame, deadlines: Sequence[tuple[str, str]], days_before: int = 3, zone: str = "UTC") -> DataFrame:
    """Sessions a day in the days up to each deadline (named, ISO day), and on all other days observed."""
    day = F.to_date(local("start_time", zone))
    daily = sessions.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(F.broadcast(daily), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    named = F.array(*(F.struct(F.lit(k).alias("deadline"), F.lit(d).cast("date").alias("due")) for k, d in deadlines))
    rows = spine.select("day", "n", F.inline(named)).withColumn("near", F.col("day").between(F.date_sub("due", days_before), F.col("due")))
    mean = lambda c: F.avg(F.when(c, F.col("n")))
    made = rows.groupBy("deadline").agg(mean(F.col("near")).alias("a"), mean(~F.col("near")).alias("b"))
    return made.select("deadline", F.round("a", 6).alias("per_day_near"), F.round("b", 6).alias("per_day_else"), F.round(F.try_divide("a", "b"), 6).alias("ratio"))


def session_label(sessions: DataFrame, by: str, zone: str = "UTC", groups: DataFrame | None = None) -> DataFrame:
    """``sessions`` with a group label: course, weekday, hour, week, or learner_group of a table (learner_id, label)."""
    t = local("start_time", zone)
    if by == "learner_group":
        return sessions.join(groups.select("learner_id", "label"), "learner_id", "left").withColumn("label", F.coalesce("label", F.lit("(unassigned)")))
    if by == "week":
        first = sessions.agg(F.min(F.to_date(t)).alias("d")).select(F.date_sub("d", F.weekday("d")).alias("monday"))
        return sessions.join(F.broadcast(first), F.lit(True)).withColumn("label", (F.floor(F.datediff(F.to_date(t), "monday") / 7) + 1).cast("string")).drop("monday")
    labels = {"course": F.col("course_id"), "weekday": F.concat_ws("-", F.weekday(t) + 1, F.date_format(t, "EEE")), "hour": F.lpad(F.hour(t).cast("string"), 2, "0")}
    if by not in labels:
        raise ValueError(f"no group {by!r}: course, week, weekday, hour, learner_group, or metadata_label() for a key")
    label = labels[by]
    return sessions.withColumn("label", label)


def analyze_by(labelled: DataFrame, min_sessions: int = 1) -> DataFrame:
    """Per label, and over all (null): sessions, learners, events, mean length, and distance of the token mix to all; small groups are omitted."""
    stats = labelled.groupingSets([["label"], []], "label").agg(F.count("*").alias("n_sessions"), F.count_distinct("learner_id").alias("n_learners"), F.sum("n_events").alias("n_events"), F.round(F.avg("n_events"), 6).alias("mean_length"))
    tokens = labelled.select("label", F.explode("event_sequence").alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    per = tokens.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    whole = tokens.groupBy("token").agg(F.sum("n").alias("n")).select("token", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("q"))
    # half the sum of |p - q| is the sum of the positive differences, so tokens absent from a label need no row
    tvd = per.join(whole, "token").groupBy("label").agg(F.round(F.sum(F.greatest(F.col("p") - F.col("q"), F.lit(0.0))), 6).alias("tvd"))
    return stats.join(tvd, "label", "left").filter(F.col("label").isNull() | (F.col("n_sessions") >= min_sessions)).select(F.coalesce("label", F.lit("(all)")).alias("label"), "n_sessions", "n_learners", "n_events", "mean_length", F.coalesce("tvd", F.lit(0.0)).alias("tvd"))


def spans(seq: DataFrame) -> DataFrame:
    """(session_id, learner_id, n_events, duration_s): what learner_features() takes of sessions, without their events in order."""
    us = F.unix_micros("timestamp")
    length = F.when(F.count("timestamp") == F.count("*"), (F.max(us) - F.min(us)) / 1e6)
    return seq.filter("session_id is not null").groupBy("session_id", "learner_id").agg(F.count("*").alias("n_events"), length.alias("duration_s"))


def learner_features(sessions: DataFrame, events: DataFrame, vocabulary: Sequence[str], others: bool = False) -> DataFrame:
    """Session count, mean length, log mean duration, success (0.5 if unknown) and token shares of each learner; ``others`` adds the share of all other tokens."""
    own = sessions.groupBy("learner_id").agg(F.count("*").alias("n_sessions"), F.avg("n_events").alias("mean_length"), F.log1p(F.avg("duration_s")).alias("log_duration"))
    token = F.col("token") if "token" in events.columns else F.col("event_type")
    rest = [F.round(F.avg((~token.isin(*vocabulary)).cast("double")), 6).alias("share_(other)")] if others else []
    mix = events.groupBy("learner_id").agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.5)).alias("success_rate"), *(F.round(F.avg((token == v).cast("double")), 6).alias(f"share_{v}") for v in vocabulary), *rest)
    return own.join(mix, "learner_id").select("learner_id", "n_sessions", F.round("mean_length", 6).alias("mean_length"), F.round("log_duration", 6).alias("log_duration"), F.round("success_rate", 6).alias("success_rate"), *(f"`share_{v}`" for v in vocabulary), *(["`share_(other)`"] if others else []))


def standardize(features: DataFrame, key: str, clip: float | None = 3.0) -> DataFrame:
    """Population z-scores, clipped unless ``clip`` is None; a constant column is 0."""
    names = [c for c in features.columns if c != key]
    stats = features.agg(*(x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    free = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
    z = lambda c: free(c) if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), free(c)))
    return features.join(F.broadcast(stats), F.lit(True)).select(key, *(F.round(z(c), 5).alias(c) for c in names))


def resolve_zone(name: str) -> str:
    """The name, if it is a zone of the IANA database."""
    from zoneinfo import ZoneInfo

    try:
        return ZoneInfo(name).key
    except (KeyError, ValueError, OSError):
        raise ValueError(f"unknown time zone {name!r}") from None


def by_clock(events: DataFrame, sessions: DataFrame, part: str, zone: str = "UTC") -> DataFrame:
    """Events, and sessions by their start, of each ``hour`` or ``weekday`` (Monday 0)."""
    of, size = {"hour": (F.hour, 24), "weekday": (F.weekday, 7)}[part]
    at = lambda column: of(local(column, resolve_zone(zone)))
    mixed = events.select(at("timestamp").alias(part), F.lit("e").alias("what")).unionByName(sessions.select(at("start_time").alias(part), F.lit("s").alias("what")))
    n = lambda w: F.coalesce(F.sum((F.col("what") == w).cast("bigint")), F.lit(0))
    counts = mixed.groupBy(part).agg(n("e").alias("n_events"), n("s").alias("n_sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return events.sparkSession.range(size).select(F.col("id").cast("int").alias(part)).join(F.broadcast(counts), part, "left").select(part, zero("n_events"), zero("n_sessions"))


def peak_hour(hours: DataFrame) -> DataFrame:
    """The hour with most events, the lowest on ties."""
    return hours.agg(F.max_by("hour", F.struct("n_events", -F.col("hour"))).alias("peak_hour"))


def daily(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    return sessions.groupBy(F.to_date(local("start_time", zone)).alias("day")).agg(F.count("*").alias("n_sessions"))


def temporal_profile(events: DataFrame, sessions: DataFrame, zone: str = "UTC") -> dict[str, DataFrame]:
    """When there is activity: by hour and weekday, both together, by week and day, and the time between sessions."""
    hours = by_clock(events, sessions, "hour", zone)
    starts = sessions.withColumnRenamed("start_time", "timestamp")
    return {
        "hours": hours, "weekdays": by_clock(events, sessions, "weekday", zone), "heat_map": heat_map(starts, zone), "weekly": weekly(events, sessions, zone), "daily": daily(sessions, zone),
        "between": describe(between_sessions(sessions), "gap_s"), "peak": peak_hour(hours), "span": daily(sessions, zone).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")),
    }


def top_bigrams(labelled: DataFrame, top: int = 5) -> DataFrame:
    """(label, bigram, n, share, rank): the commonest pairs of each label."""
    pairs = labelled.select("label", F.col("token").alias("a"), F.lead("token").over(in_session(labelled)).alias("b")).filter("b is not null")
    counts = pairs.groupBy("label", F.concat_ws(" -> ", "a", "b").alias("bigram")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("label")
    ranked = counts.select("label", "bigram", "n", F.round(F.col("n") / F.sum("n").over(own), 6).alias("share"), F.row_number().over(own.orderBy(F.desc("n"), "bigram")).alias("rank"))
    return ranked.filter(F.col("rank") <= top)


def omitted(labelled: DataFrame, min_sessions: int) -> DataFrame:
    """The labels that analyze_by() leaves out, with their size."""
    return labelled.groupBy("label").agg(F.count("*").alias("n_sessions")).filter(F.col("n_sessions") < min_sessions)


def metadata_label(seq: DataFrame, key: str) -> DataFrame:
    """(session_id, label): the commonest value of a metadata key, the first seen on ties; sessions without one are left out."""
    value = F.try_element_at("metadata", F.lit(key))
    counts = seq.select("session_id", value.alias("label"), F.struct("timestamp", "event_id").alias("at")).filter("label is not null").groupBy("session_id", "label").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter("rank = 1").select("session_id", "label")


def top_shares(events: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(label, n, share) of the commonest values."""
    counts = events.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    return shared.orderBy(F.desc("n"), "label").limit(top)


def log_histogram(values: DataFrame, column: str, bins: int = 40, least: float = 1e-3) -> DataFrame:
    """(bin, n) in equal bins of the logarithm between the smallest and the largest value."""
    size = F.log10(F.greatest(F.col(column), F.lit(least)))
    ends = values.agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    place = F.floor(F.coalesce(F.try_divide(size - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)
    return values.join(F.broadcast(ends), F.lit(True)).groupBy(F.least(F.lit(bins - 1), place).cast("int").alias("bin")).agg(F.count("*").alias("n"))
