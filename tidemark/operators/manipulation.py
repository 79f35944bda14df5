"""Whether controls took effect, and anomalies that insert events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.randomness import uniform
from tidemark.operators.generate import unseen_pairs
from tidemark.operators.sequences import in_session

#: Tokens of a vocabulary whose pairs may be laid out.
MOST_TOKENS = 2_000


def _gaps(seq: DataFrame, after: bool) -> DataFrame:
    us = F.unix_micros("timestamp")
    return seq.select("session_id", "token", ((F.lead(us).over(in_session(seq)) - us) / 1e6).alias("gap_s"), F.lit(after).alias("after"))


def check_controls(baseline: DataFrame, controlled: DataFrame, weights: dict[str, float] | None = None, dwell: dict[str, float] | None = None, length: float | None = None, tolerance: float = 0.2) -> DataFrame:
    """(control, target, before, after, status) of two logs with sessions.

    Weights compare token shares: 0 means absent, others a move the right way.
    Dwell compares medians of the gap after a token ('*': any) and length the
    mean session, both to the factor within the tolerance.  What has nothing to
    compare is 'not_measurable'; a weight of 1 asks for nothing.
    """
    both = _gaps(baseline, False).unionByName(_gaps(controlled, True))
    old, new = ~F.col("after"), F.col("after")
    own = lambda side, token: side if token == "*" else side & (F.col("token") == token)
    weighed = [(t, w) for t, w in sorted((weights or {}).items()) if w != 1]
    timed = sorted((dwell or {}).items())
    total = lambda c: F.sum(c.cast("bigint"))
    sums = [total(old).alias("n_old"), total(new).alias("n_new")]
    sums += [total(side & F.col("gap_s").isNull()).alias(f"s_{name}") for side, name in ((old, "old"), (new, "new"))]
    for i, (token, _) in enumerate(weighed):
        sums += [total(own(old, token)).alias(f"w{i}_old"), total(own(new, token)).alias(f"w{i}_new")]
    for i, (token, _) in enumerate(timed):
        sums += [F.percentile(F.when(own(side, token), F.col("gap_s")), F.lit(0.5)).alias(f"t{i}_{name}") for side, name in ((old, "old"), (new, "new"))]

    def item(control: str, target: str, before: Column, after: Column, status: Column) -> Column:
        return F.struct(F.lit(control).alias("control"), F.lit(target).alias("target"), F.round(before, 6).alias("before"), F.round(after, 6).alias("after"), status.alias("status"))

    def ratio(control: str, target: str, before: Column, after: Column, factor: float) -> Column:
        near = F.abs(after / before / factor - 1) <= tolerance
        return item(control, target, before, after, F.when(before.isNull() | after.isNull() | (before <= 0), "not_measurable").when(near, "ok").otherwise("failed"))

    items = []
    for i, (token, w) in enumerate(weighed):
        b, c = (F.coalesce(F.try_divide(f"w{i}_{s}", f"n_{s}"), F.lit(0.0)) for s in ("old", "new"))
        right = F.when(c == 0, "ok").otherwise("failed") if w == 0 else F.when(b == 0, "not_measurable").when(c > b if w > 1 else c < b, "ok").otherwise("failed")
        items.append(item("event_weights", token, b, c, right))
    items += [ratio("dwell_scale", t, F.col(f"t{i}_old"), F.col(f"t{i}_new"), f) for i, (t, f) in enumerate(timed)]
    items += [ratio("session_length", "scale", F.try_divide("n_old", "s_old"), F.try_divide("n_new", "s_new"), length)] if length else []
    if not items:
        raise ValueError("no control to check")
    return both.agg(*sums).select(F.explode(F.array(*items)).alias("i")).select("i.*")


def _insert(seq: DataFrame, chosen: DataFrame, added: Column, gap_us: Column | int, seed: int) -> DataFrame:
    """The chosen sessions with ``added`` tokens after a drawn event, ``gap_us`` apart; later events move by all of it."""
    w = in_session(seq)
    place = F.floor(uniform(seed, "position", F.col("session_id")) * F.col("n_events")) + 1
    rows = seq.join(chosen, "session_id").withColumn("__r", F.row_number().over(w)).withColumn("__p", place).withColumn("__added", added)
    gap = F.lit(gap_us) if isinstance(gap_us, int) else gap_us
    us = F.unix_micros("timestamp")
    kept = rows.select("session_id", "event_id", "token", (us + F.when(F.col("__r") > F.col("__p"), gap * F.size("__added")).otherwise(F.lit(0))).cast("bigint").alias("new_us"), F.lit(False).alias("inserted"))
    fresh = rows.filter("__r = __p").select("session_id", "event_id", us.alias("__us"), gap.alias("__gap"), F.posexplode("__added").alias("__k", "token"))
    fresh = fresh.select("session_id", F.concat("event_id", F.lit("+"), F.col("__k") + 1).alias("event_id"), "token", (F.col("__us") + F.col("__gap") * (F.col("__k") + 1)).cast("bigint").alias("new_us"), F.lit(True).alias("inserted"))
    return kept.unionByName(fresh)


def event_frequency(seq: DataFrame, chosen: DataFrame, token: str, count: int = 20, window_s: int = 180, seed: int = 0) -> DataFrame:
    """(session_id, event_id, token, new_us, inserted): a burst of one token in each chosen session."""
    return _insert(seq, chosen, F.array_repeat(F.lit(token), count), window_s * 1_000_000 // count, seed)


def unexpected_transition(seq: DataFrame, chosen: DataFrame, gap_s: int = 60, seed: int = 0) -> DataFrame:
    """As event_frequency(), with a drawn pair of tokens that is never seen; sessions stay out where every pair is seen."""
    size = seq.select("token").distinct().limit(MOST_TOKENS + 1).count()
    if size > MOST_TOKENS:
        raise ValueError(f"pairs of more than {MOST_TOKENS} tokens are too many to lay out; name the transitions")
    order = F.row_number().over(Window.orderBy("src", "dst"))  # at most the square of MOST_TOKENS, and far fewer in use
    pairs = unseen_pairs(seq).select((order - 1).cast("bigint").alias("pair"), "src", "dst")
    n = pairs.agg(F.count("*").alias("n_pairs"))
    drawn = chosen.join(F.broadcast(n), F.lit(True)).withColumn("pair", F.floor(uniform(seed, "pair", F.col("session_id")) * F.col("n_pairs")))
    return _insert(seq, drawn.join(pairs, "pair").drop("pair", "n_pairs"), F.array("src", "dst"), gap_s * 1_000_000, seed)
