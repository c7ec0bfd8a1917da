"""Host reputation by empirical Bayes, and rule-based URL verdicts.

Labelled page outcomes (bad or good) are counted per host, registered domain
and suffix. Every level's bad rate is shrunk towards the level above with a
beta prior whose strength is estimated from the data (method of moments: the
less the groups of a level differ beyond chance, the stronger the prior):

    suffix  ~ Beta(overall rate, strength 1)
    domain  ~ Beta(posterior mean of its suffix, strength 2)
    host    ~ Beta(posterior mean of its domain, strength 3)

A host is blocked when the lower bound of its posterior bad rate (normal
approximation, ``z`` standard deviations under the mean) exceeds
``block_rate``; a host without outcomes inherits its domain's posterior mean
with the prior's strength. Explicit rules come first: a rule fits its host and
all subdomains when the URL's path starts with the rule's path; the longest
rule wins.

Everything is DataFrame expressions. Outcomes are counted by partial
aggregates, so a host with a third of all rows collapses before the shuffle;
pages meet their host's verdict in one join on the host, which adaptive
execution broadcasts when small and splits when skewed.

Defined results: a null URL, or one without ``://``, has an empty host and
path and is judged by the overall rate; a page without a label has no outcome;
pages labelled more than once are bad if any label says so; repeated page rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path) of the explicit rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Public suffixes of two labels.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
BLOCK_RATE = 0.5
WEAKEST, STRONGEST = 1.0, 1e6
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)) \
        .otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def outcomes(pages: DataFrame, labels: DataFrame, *, page_col: str = "page_id", url_col: str = "url",
             label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """(host, n, bad): labelled pages and bad ones among them, of every host
    that a page has. The label of a page is the row of ``labels`` with its
    number; by default low quality or toxicity is bad."""
    bad = bad if bad is not None else (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = (labels.where(F.col(f"`{label_id}`").isNotNull())
             .select(F.col(f"`{label_id}`").alias("_id"), bad.cast("int").alias("_bad"))
             .where(F.col("_bad").isNotNull()).groupBy("_id").agg(F.max("_bad").alias("_bad")))
    urls = pages.select(F.col(f"`{page_col}`").alias("_id"), host_of(F.col(f"`{url_col}`")).alias("host"))
    return (urls.join(marks, "_id", "left").groupBy("host")
            .agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")))


def _strength(groups: DataFrame, mean: str) -> Column:
    """Method of moments: the prior's strength for groups (n, bad) around
    their parents' mean, as an aggregate expression."""
    n, bad, m = F.col("n"), F.col("bad"), F.col(mean)
    total = F.sum(n)
    spread = F.sum(F.when(n > 0, n * F.pow(bad / n - m, 2)).otherwise(0.0))
    chance = F.avg(F.when(n > 0, m * (1 - m)))
    # try_divide: one group, or rates of 0 and 1 only, leave nothing to estimate from.
    share = F.try_divide(spread - (F.sum(F.when(n > 0, 1).otherwise(0)) - 1) * chance, total - F.try_divide(F.sum(n * n), total))
    rho = F.try_divide(share, chance)
    return F.coalesce(F.when(rho <= 0, F.lit(STRONGEST))
                      .otherwise(F.least(F.greatest(F.try_divide(1 - rho, rho), F.lit(WEAKEST)), F.lit(STRONGEST))),
                      F.lit(STRONGEST))


def _with_strength(groups: DataFrame, mean: str) -> DataFrame:
    """Adds the level's strength to every group: one aggregated row comes to
    the driver and goes back as a constant."""
    live = groups.where("n > 0")
    row = live.agg(_strength(live, mean).alias("s")).first()
    return groups.withColumn("s", F.lit(float(row.s)))


def reputation(counts: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) from (host, n, bad): posterior mean and
    lower bound of every host's bad rate."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total.bad + 0.5) / (total.n + 1.0)

    hosts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    suffixes = _with_strength(suffixes.withColumn("m", F.lit(overall)), "m")
    suffixes = suffixes.select("suffix", ((F.col("m") * F.col("s") + F.col("bad")) / (F.col("s") + F.col("n"))).alias("m"))
    domains = _with_strength(domains.join(suffixes, "suffix"), "m")
    domains = domains.select("suffix", "domain",
                             ((F.col("m") * F.col("s") + F.col("bad")) / (F.col("s") + F.col("n"))).alias("m"))
    hosts = _with_strength(hosts.join(domains, ["suffix", "domain"]), "m")
    a, b = F.col("m") * F.col("s") + F.col("bad"), (1 - F.col("m")) * F.col("s") + F.col("n") - F.col("bad")
    rate = a / (a + b)
    bound = F.greatest(F.lit(0.0), rate - Z * F.sqrt(rate * (1 - rate) / (a + b + 1)))
    return hosts.select("host", "n", "bad", rate.alias("rate"), bound.alias("bound"))


def judge(pages: DataFrame, host_reputation: DataFrame, *, page_col: str = "page_id", url_col: str = "url",
          rules=RULES, block_rate: float = BLOCK_RATE) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, bound) of every page."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{page_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation.select("host", "rate", "bound")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > block_rate, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rate", "bound")
