"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation
over the table of vote patterns estimates how often each rule votes each way
on good and on bad texts, and a text is kept when its posterior probability of
being good reaches a threshold.  The pattern table has at most 3**rules rows,
whatever the corpus, so only it comes to the driver.

Defined results: a null text has no words; a very long text is measured whole; a
posterior of exactly the threshold is kept; texts below the base rules (too few
words, or too many of them in repeated windows) are never kept; repeated rows
get equal verdicts; with an empty table nothing is estimated or returned; input
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Fixed by the contract.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more in the text.

    Windows are compared by 64-bit hash: in a text of n words two different
    windows agree with a probability below n**2 / 2**64.
    """

    def among(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(sorted_pairs: Column) -> Column:
            same = lambda i, k: F.coalesce(F.get(sorted_pairs, i + k)["h"] == F.get(sorted_pairs, i)["h"], F.lit(False))
            hit = F.filter(sorted_pairs, lambda p, i: same(i, -1) | same(i, 1))
            return F.array_sort(F.transform(hit, lambda p: p["i"]))

        def covered(starts: Column) -> Column:
            reach = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
            return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return _let(pairs, lambda s: _let(repeated(s), covered))

    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    )
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), among(w)).otherwise(F.lit(0).cast("bigint")))


def measure(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the measures of each text; one narrow stage."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = F.split(F.trim(body, F.lit(BLANKS)), WORD_GAP)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    made = docs.select(*keep, body.alias("__body"), F.filter(cut, lambda x: x != "").alias("__words"), lines.alias("__lines"))
    joined = F.array_join("__words", "")
    long = lambda c: c.cast("bigint")
    found = F.struct(
        long(F.size("__words")).alias("n_words"),
        long(F.char_length(joined)).alias("word_chars"),
        long(F.regexp_count("__body", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("__words")).alias("n_repeat_words"),
        long(F.size("__lines")).alias("n_lines"),
        long(F.regexp_count("__body", F.lit("[A-Z]"))).alias("n_upper"),
        long(F.regexp_count("__body", F.lit(MARKS))).alias("n_marks"),
    )
    # inline() keeps later filters and votes from being folded into, and so repeating, the expressions above
    return made.select(*keep, F.inline(F.array(found)))


def base_failed() -> Column:
    """The base rules of the contract."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(value: Column, good: float, bad: float) -> Column:
    """1 up to ``good``, -1 from ``bad``, 0 between them and for no value; exact on integers' ratios."""
    return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)


def _per_hundred(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part) * 100, F.col(whole))


#: Rules by name: share of symbols, of repeated lines and of repeated words, word length, capitals, exclamation and question marks.
RULES = {
    "symbols": lambda: _vote(_per_hundred("n_symbols", "word_chars"), 1, 5),
    "lines": lambda: _vote(_per_hundred("n_dup_lines", "n_lines"), 5, 30),
    "repeats": lambda: _vote(_per_hundred("n_repeat_words", "n_words"), 2, 10),
    "length": lambda: _vote(F.abs(F.try_divide(F.col("word_chars"), F.col("n_words")) - 6), 3, 6),
    "capitals": lambda: _vote(_per_hundred("n_upper", "word_chars"), 10, 30),
    "marks": lambda: _vote(_per_hundred("n_marks", "n_words"), 2, 20),
}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, smooth: float = 1.0) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, by EM.

    A two-class model with conditionally independent votes; each rule has its
    own chances of voting good, bad and abstaining on either class.  It starts
    from the majority of the votes; ``smooth`` pseudo-counts favour no vote.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}
    k = len(patterns[0][0])
    post = {}
    for votes, _ in patterns:
        up, down = votes.count(1), votes.count(-1)
        post[votes] = (up + 0.5) / (up + 3 * down + 1)
    for _ in range(rounds):
        mass = [smooth, smooth]
        count = [[{-1: smooth, 0: smooth, 1: smooth} for _ in range(k)] for _ in range(2)]
        for votes, n in patterns:
            for c, p in ((1, post[votes]), (0, 1 - post[votes])):
                mass[c] += n * p
                for j, v in enumerate(votes):
                    count[c][j][v] += n * p
        log_prior = [math.log(m / sum(mass)) for m in mass]
        log_vote = [[{v: math.log(x / sum(d.values())) for v, x in d.items()} for d in rules] for rules in count]
        moved = 0.0
        for votes, _ in patterns:
            score = [log_prior[c] + sum(log_vote[c][j][v] for j, v in enumerate(votes)) for c in range(2)]
            new = 1 / (1 + math.exp(max(-700.0, min(700.0, score[0] - score[1]))))
            moved, post[votes] = max(moved, abs(new - post[votes])), new
        if moved < 1e-9:
            break
    return post


def judge(docs: DataFrame, *, text: str = "text", keep: list[str], least: float = 0.5) -> DataFrame:
    """Measures, base verdict, votes, posterior and the verdict ``kept`` of every row.

    The measures are written once to the shared folder: the table of patterns
    and the verdicts are both read from there.
    """
    made = {*MEASURES, "n_lines", "n_upper", "n_marks", "base_failed", "kept", "posterior"}
    keep = [c for c in keep if c.lower() not in made]
    votes = F.array(*(rule() for rule in RULES.values()))
    measured = measure(docs, text=text, keep=keep).withColumn("base_failed", base_failed()).withColumn("votes", votes)
    stored = materialize(measured, "quality")
    patterns = [(tuple(r["votes"]), r["count"]) for r in stored.groupBy("votes").count().collect()]
    post = fit(patterns)
    code = _code(F.col("votes"))
    if post:
        pairs = [x for v, p in sorted(post.items()) for x in (F.lit(sum((a + 1) * 3**j for j, a in enumerate(v))), F.lit(p))]
        probability = F.element_at(F.create_map(*pairs), code)
    else:
        probability = F.lit(None).cast("double")
    scored = stored.withColumn("posterior", probability)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= least)).drop("n_lines", "n_upper", "n_marks")


def _code(votes: Column) -> Column:
    return F.aggregate(F.transform(votes, lambda v, j: (v + 1) * F.pow(F.lit(3), j).cast("int")), F.lit(0), lambda a, x: a + x)


def keep_good(docs: DataFrame, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text passes, with their columns.

    Rows are measured once and stored with the number of their vote pattern; the
    table of patterns and the rows kept are both read from there.
    """
    named = [f"__c{i}" for i in range(len(docs.columns))]
    votes = F.array(*(rule() for rule in RULES.values()))
    judged = measure(docs.toDF(*named), text=named[docs.columns.index(text)], keep=named)
    stored = materialize(judged.select(*named, base_failed().alias("__failed"), votes.alias("__votes")).withColumn("__code", _code(F.col("__votes"))), "quality")
    post = fit([(tuple(r["__votes"]), r["count"]) for r in stored.groupBy("__votes").count().collect()])
    good = [sum((a + 1) * 3**j for j, a in enumerate(v)) for v, p in sorted(post.items()) if p >= least]
    kept = stored.filter(~F.col("__failed") & F.col("__code").isin(good)) if good else stored.limit(0)
    return kept.select(*(F.col(n).alias(c) for n, c in zip(named, docs.columns, strict=True)))
