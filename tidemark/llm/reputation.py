"""URL filters: fixed rules first, then empirical-Bayes reputation of hosts.

Labelled pages give each host a count of good and bad outcomes.  A host's rate
is shrunk to its registered domain's, that to its public suffix's, and that to
the rate of all pages, by beta-binomial priors whose strength is estimated from
the spread of the children's rates at each level.  A host is blocked when the
lower bound of its posterior bad rate exceeds a limit, so that few outcomes
alone block nothing.

The bound is the mean less z deviations of the posterior beta distribution.

Defined results: a null url and one without ``://`` has an empty host and path
and is allowed; a very long url is cut like any other; labels that repeat for a page
count once, as bad if any is; labels of unknown pages and of null ids are ignored;
repeated pages are counted and judged one by one, those without an id too; of equally
long rules the first in the alphabet wins; without labels everything is allowed,
without pages there are no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Fixed by the contract: verdict and rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels under which domains are registered; more can be given.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz")
LIMIT = 0.3
BOUND_Z = 1.645
LEAST_RHO, MOST_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (then the first in order of the alphabet), as struct(rule, verdict)."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        where, slash, start = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _name(host: Column) -> Column:
    """A host without port and user name."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` with ``domain``, the label below the public suffix with the suffix.

    ``suffixes`` is a table with the column ``suffix`` of those that have several
    labels, such as a public list; without it a few common ones are known.
    """
    name = _name(F.col("host"))
    tail = lambda n: F.substring_index(name, ".", -n)
    if suffixes is None:
        return hosts.withColumn("domain", F.when(tail(2).isin(list(TWO_LABELS)), tail(3)).otherwise(tail(2)))
    known = suffixes.select(F.col("suffix").alias("__tail")).distinct()
    longest = hosts.select("host", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), tail(n).alias("t")) for n in (2, 3, 4)))).alias("x"))
    longest = longest.select("host", F.col("x.n").alias("n"), F.col("x.t").alias("__tail")).join(known, "__tail").groupBy("host").agg(F.max("n").alias("__n"))
    return hosts.join(longest, "host", "left").withColumn("domain", F.expr("substring_index(regexp_replace(host, '^.*@|:[0-9]*$', ''), '.', -1 - coalesce(__n, 1))")).drop("__n")


def _strength(s: Row | None) -> float:
    """Prior pseudo-counts by the analysis-of-variance estimate of the correlation within groups, from the sums of a level."""
    m, n = (s["m"], s["n"]) if s else (0, 0)
    if m < 2 or n <= m:
        return 1 / MOST_RHO - 1
    p = s["b"] / n
    between = (s["npp"] - n * p * p) / (m - 1)
    within = (s["b"] - s["npp"]) / (n - m)
    size = (n - s["nn"] / n) / (m - 1)
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def reputation(visits: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of each host of ``visits(host, bad)``; bad is null where there is no label.

    host, n, b, alpha, beta, mean and lower bound.  Hosts are counted once and
    stored; the sums of all levels are one aggregate over that table.
    """
    counted = visits.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    suffix = F.expr("if(instr(domain, '.') > 0, substring(domain, instr(domain, '.') + 1), domain)")
    hosts = materialize(with_domain(counted, suffixes).withColumn("suffix", suffix), "reputation-hosts")
    both = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    domains, suffixes_ = both("domain", "suffix"), both("suffix")
    level = lambda df, name: df.select(F.lit(name).alias("level"), "n", "b")
    share = F.col("b") / F.col("n")
    every = level(hosts, "host").unionByName(level(domains, "domain")).unionByName(level(suffixes_, "suffix")).filter("n > 0")
    sums = every.groupBy("level").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * share * share).alias("npp"))
    known = {r["level"]: r for r in sums.collect()}  # three rows at most
    k_host, k_domain, k_suffix = (_strength(known.get(x)) for x in ("host", "domain", "suffix"))
    whole = known.get("suffix")
    root = ((whole["b"] if whole else 0) + 0.5) / ((whole["n"] if whole else 0) + 1)
    suffix_mean = suffixes_.select("suffix", ((F.col("b") + k_suffix * root) / (F.col("n") + k_suffix)).alias("above"))
    domain_mean = domains.join(suffix_mean, "suffix").select("domain", ((F.col("b") + k_domain * F.col("above")) / (F.col("n") + k_domain)).alias("above"))
    a = F.col("b") + k_host * F.col("above")
    b = F.col("n") - F.col("b") + k_host * (1 - F.col("above"))
    made = hosts.join(domain_mean, "domain").select("host", "n", "b", a.alias("alpha"), b.alias("beta"))
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    return made.withColumn("mean", mean).withColumn("lower", mean - BOUND_Z * F.sqrt(mean * (1 - mean) / (total + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, key: str = "page_id", url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule and verdict of every page.

    ``outcomes`` has key and bad (0 or 1).  Hosts are counted with partial sums
    before any row moves, and the verdicts of blocked hosts are joined in a way
    that Spark may split for a host that holds a large share of the pages.
    """
    parsed = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = outcomes.select(F.col(key).alias("key"), F.col("bad").cast("int")).groupBy("key").agg(F.max("bad").alias("bad"))
    known = reputation(parsed.select("key", "host").filter("host <> ''").join(labels, "key", "left"), suffixes)
    blocked = known.filter(F.col("lower") > limit).select(F.col("host").alias("at"), F.lit(True).alias("blocked"))
    ruled = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    nowhere = F.concat(F.lit("/"), F.xxhash64("key").cast("string"))  # pages without a host meet no other page: a host has no slash
    return ruled.withColumn("at", F.when(F.col("host") == "", nowhere).otherwise(F.col("host"))).join(blocked, "at", "left").select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"))
