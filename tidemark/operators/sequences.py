"""Tokens in order: n-grams, transitions, graphs and flows, over events with session ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import quantiles

START, END = "<start>", "(end)"


def in_session(frame: DataFrame) -> Window:
    """A session is one learner's, so that rows dealt by learner need not be dealt again."""
    own = ["learner_id"] if "learner_id" in frame.columns else []
    return Window.partitionBy(*own, "session_id").orderBy("timestamp", "event_id")


def tokens(events: DataFrame, token: str = "event_type") -> DataFrame:
    """Session events with ``token``; the input of everything here."""
    return events.filter("session_id is not null").withColumn("token", F.col(token))


def ngrams(seq: DataFrame, n: int, *by: str) -> DataFrame:
    """Counts of contiguous n-grams, joined by ' > ', never across sessions."""
    w = in_session(seq)
    parts = [F.col("token"), *(F.lead("token", k).over(w) for k in range(1, n))]
    return seq.select(*by, F.struct(*(p.alias(f"t{i}") for i, p in enumerate(parts))).alias("g")).filter(F.col(f"g.t{n - 1}").isNotNull()).groupBy(*by, F.concat_ws(" > ", *(f"g.t{i}" for i in range(n))).alias("ngram")).agg(F.count("*").alias("n"))


def rare_ngrams(counts: DataFrame, max_count: int = 1) -> DataFrame:
    return counts.filter(F.col("n") <= max_count)


def transitions(seq: DataFrame, order: int = 1, separator: str = " > ") -> DataFrame:
    """(context, token, n); contexts are padded on the left, no end is added."""
    w = in_session(seq)
    context = F.concat_ws(separator, *(F.coalesce(F.lag("token", k).over(w), F.lit(START)) for k in range(order, 0, -1)))
    return seq.select(context.alias("context"), "token").groupBy("context", "token").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, alpha: float = 0.0) -> DataFrame:
    """Rows normalised; alpha > 0 adds alpha to every token of the vocabulary for each seen context."""
    if alpha == 0:
        return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context"))).select("context", "token", "p")
    vocabulary = counts.agg(F.array_sort(F.collect_set("token")).alias("v"))
    rows = counts.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("m"), F.sum("n").alias("total"))
    spread = rows.join(F.broadcast(vocabulary), F.lit(True)).select("context", "m", "total", F.size("v").alias("size"), F.explode("v").alias("token"))
    return spread.select("context", "token", ((F.coalesce(F.try_element_at("m", F.col("token")), F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("size"))).alias("p"))


def density(counts: DataFrame, order: int = 1) -> DataFrame:
    """Transitions, start count, vocabulary and density without contexts at the start."""
    begins = F.col("context").contains(START)
    return counts.agg(
        F.sum("n").alias("n_transitions"),
        F.sum(F.when(F.col("context") == " > ".join([START] * order), F.col("n"))).alias("n_starts"),
        F.count_distinct("token").alias("vocabulary"),
        F.round(F.sum((~begins).cast("double")) / F.pow(F.count_distinct("token"), F.lit(order + 1)), 6).alias("density"),
    )


def edges(seq: DataFrame) -> DataFrame:
    return ngrams(seq, 2).select(F.split("ngram", " > ")[0].alias("src"), F.split("ngram", " > ")[1].alias("dst"), "n")


def top_edges(graph: DataFrame, n: int = 10) -> DataFrame:
    return graph.orderBy(F.desc("n"), "src", "dst").limit(n)


def transition_matrix(seq: DataFrame, top: int = 12) -> DataFrame:
    """(src, dst, p): successors among the ``top`` most frequent tokens, shares of each row inside them."""
    frequent = seq.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top).select("token")
    inside = edges(seq).join(F.broadcast(frequent.select(F.col("token").alias("src"))), "src").join(F.broadcast(frequent.select(F.col("token").alias("dst"))), "dst")
    return inside.select("src", "dst", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6).alias("p"))


def self_loop_share(graph: DataFrame) -> DataFrame:
    return graph.agg(F.round(F.try_divide(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("share"))


def _top(frame: DataFrame, k: int, *by: str) -> DataFrame:
    """The k largest n of each group, ties by label."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "label"))
    return frame.withColumn("rank", rank).filter(F.col("rank") <= k)


def sankey(seq: DataFrame, steps: int = 4, top_n: int = 6) -> DataFrame:
    """(step, src, dst, n): flows between consecutive steps; small labels are 'other', an ended session is '(end)' once."""
    w = in_session(seq)
    placed = seq.select("session_id", "token", F.row_number().over(w).alias("step"), F.lead("token").over(w).isNull().alias("last")).filter(F.col("step") <= steps)
    ends = placed.filter(F.col("last") & (F.col("step") < steps)).select("session_id", F.lit(END).alias("token"), (F.col("step") + 1).alias("step"))
    kept = _top(placed.groupBy("step", F.col("token").alias("label")).agg(F.count("*").alias("n")), top_n, "step").select("step", F.col("label").alias("token"), F.lit(True).alias("kept"))
    named = placed.join(F.broadcast(kept), ["step", "token"], "left").select("session_id", "step", F.when(F.col("kept").isNotNull(), F.col("token")).otherwise("other").alias("label"))
    flow = named.unionByName(ends.select("session_id", "step", F.col("token").alias("label")))
    nxt = Window.partitionBy("session_id").orderBy("step")
    return flow.select("step", F.col("label").alias("src"), F.lead("label").over(nxt).alias("dst")).filter("dst is not null").groupBy("step", "src", "dst").agg(F.count("*").alias("n"))


def companions(seq: DataFrame, top: int = 5) -> DataFrame:
    other = F.when(F.col("token") == F.col("event_type"), F.col("activity_id")).otherwise(F.col("event_type"))
    return _top(seq.groupBy("token", other.alias("label")).agg(F.count("*").alias("n")), top, "token")


def neighbours(seq: DataFrame, top: int = 5) -> DataFrame:
    """Successors of each token, the end of the session among them."""
    follow = F.coalesce(F.lead("token").over(in_session(seq)), F.lit(END))
    return _top(seq.select("token", follow.alias("label")).groupBy("token", "label").agg(F.count("*").alias("n")), top, "token")


def predecessors(seq: DataFrame, top: int = 5) -> DataFrame:
    """What comes before each token, the start of the session among it."""
    before = F.coalesce(F.lag("token").over(in_session(seq)), F.lit(START))
    return _top(seq.select("token", before.alias("label")).groupBy("token", "label").agg(F.count("*").alias("n")), top, "token")


def activity_profiles(seq: DataFrame) -> DataFrame:
    """Per token: counts, shares, reach, start, end and repeat shares, dwell median, success and score.

    Reach is counted from one row for each token and session, so no distinct set is held.
    """
    w = in_session(seq)
    rich = seq.select(
        "token", "session_id", "learner_id", "success", "score",
        F.lag("token").over(w).alias("before"), F.lead("token").over(w).alias("after"),
        (F.lead(F.unix_micros("timestamp")).over(w) - F.unix_micros("timestamp")).alias("dwell_us"),
    )
    hits = lambda c: F.sum(c.cast("bigint"))
    per = rich.groupBy("token", "learner_id", "session_id").agg(
        F.count("*").alias("n"), hits(F.col("before").isNull()).alias("starts"), hits(F.col("after").isNull()).alias("ends"), hits(F.coalesce(F.col("before") == F.col("token"), F.lit(False))).alias("repeats"),
        hits(F.col("success")).alias("won"), F.count("success").alias("judged"), F.sum("score").alias("score"), F.count("score").alias("scored"),
    )
    own = per.groupBy("token", "learner_id").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in ("n", "starts", "ends", "repeats", "won", "judged", "score", "scored")))
    total = own.groupBy("token").agg(F.sum("sessions").alias("n_sessions"), F.count("*").alias("n_learners"), *(F.sum(c).alias(c) for c in ("n", "starts", "ends", "repeats", "won", "judged", "score", "scored")))
    share = lambda part, whole="n": F.round(F.try_divide(F.col(part), F.col(whole)), 6)
    middle = quantiles(rich.withColumn("token", F.col("token")), F.col("dwell_us") / 1e6, {"median": 0.5}, ("token",)).select(F.col("token").alias("of"), F.round("median", 4).alias("dwell_median_s"))
    made = total.join(middle, F.col("of") == F.col("token"), "left")
    return made.select("token", "n", "n_sessions", "n_learners", share("starts").alias("start_share"), share("ends").alias("end_share"), share("repeats").alias("repeat_share"), "dwell_median_s", share("won", "judged").alias("success_rate"), share("score", "scored").alias("mean_score"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def nll(seq: DataFrame) -> DataFrame:
    """Mean negative log probability of each session's bigrams, add one."""
    counts = transitions(seq)
    size = counts.agg(F.count_distinct("token").alias("size"))
    smoothed = (F.col("n") + 1) / (F.sum("n").over(Window.partitionBy("context")) + F.col("size"))
    table = counts.join(F.broadcast(size), F.lit(True)).select("context", "token", smoothed.alias("p"))  # pairs that occur are all that is scored
    context: Column = F.coalesce(F.lag("token").over(in_session(seq)), F.lit(START))
    scored = seq.select("session_id", context.alias("context"), "token").join(table, ["context", "token"])
    return scored.groupBy("session_id").agg(F.round(F.avg(-F.log("p")), 6).alias("nll"))


def transition_scores(train: DataFrame, target: DataFrame) -> DataFrame:
    """(session_id, score): mean negative log probability of the target's transitions under the training log's, add one."""
    counts = transitions(train)
    size = counts.agg((F.count_distinct("token") + 1).alias("size"))
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"))
    context: Column = F.coalesce(F.lag("token").over(in_session(target)), F.lit(START))
    seen = target.select("session_id", context.alias("context"), "token").join(counts, ["context", "token"], "left").join(totals, "context", "left").join(F.broadcast(size), F.lit(True))
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("size"))
    return seen.groupBy("session_id").agg(F.round(F.avg(-F.log(p)), 6).alias("score"))
