"""Soft-membership mixing: document rates whose expected domain totals match targets.

1. *Classifier.* A naive Bayes model over hashed words is counted from
   labelled rows (a bounded sample of at most ``max_rows``, those with the
   smallest id hashes; every domain gets an equal share of it). It gives every
   document posteriors over the domains. A text's evidence counts as at most
   ``evidence`` words, so posteriors of long texts stay soft.
2. *Rates.* With n tokens and posteriors p of each document, the rates r >=
   least nearest to one (in the sum of n (r - 1)^2) are sought whose expected
   totals T = sum r n p / sum n equal the targets t. They are r = max(least,
   1 - p x) for one number x of each domain, the minimum of a smooth convex
   function, found by Newton steps over the rows that are not at their bound.
   A pass over the table is one partial aggregate of a few sums, for a few
   lengths of the step at once; the rates are an expression of the posteriors,
   so nothing else is kept between passes. Targets out of reach are missed by
   as little as can be; the miss is returned and warned of.
3. *Copies.* A document of rate r occurs floor(r + u) times, u a hash of its
   id in [0, 1): r times in expectation.

Only DataFrame expressions; scoring and rates move no rows. The driver sees
the model's bucket counts (a fixed number) and one row of sums a pass.

Defined results: null, empty and blank texts have no tokens and the domains'
shares of the sample as posteriors; domains without labelled rows get no
posterior mass and miss their target; with no labels all posteriors are equal;
rows of an unknown label are not learnt from; repeated rows get the same rate
and copies; a null id is one id; other columns are kept by ``resample`` and
ignored otherwise. Posteriors are rounded to millionths and steps to 12
digits, so results do not depend on the order of sums.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored

BUCKETS = 8192
MAX_ROWS = 6000
EVIDENCE = 20.0
PASSES = 100
CLOSE = 1e-4
RIDGE = 1e-9
LENGTHS = (1.0, 0.25, 1 / 16, 1 / 64, 1 / 256)
# The domains of the labelled table and their target shares of the tokens.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.80, "low": 0.15, "toxic": 0.05}


def label_domain() -> Column:
    """The domain of a row of ``labels``; null where a mark is missing."""
    return F.when(F.col("quality").isNull() | F.col("toxic").isNull(), F.lit(None).cast("string")) \
        .when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")


def words_of(text: Column) -> Column:
    """Blank-separated words, line ends counting as blanks; never null."""
    words = F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), "\n\r\t", "   ")), " ")
    return F.filter(words, lambda w: w != "")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, domains=DOMAINS, *, domain: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS) -> dict:
    """{"prior": [...], "weights": [[...] per domain]}: log odds against the
    first domain for each bucket."""
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), (domain if domain is not None else label_domain()).alias("_d"))
             .where(F.col("_id").isNotNull() & F.col("_d").isin(*domains)).groupBy("_id").agg(F.max("_d").alias("_d")))
    shares = {r._d: r.c for r in known.groupBy("_d").agg(F.count(F.lit(1)).alias("c")).collect()}
    sample = None
    for d in domains:
        part = known.where(F.col("_d") == d).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // len(domains))
        sample = part if sample is None else sample.unionByName(part)
    counted = (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
               .join(F.broadcast(sample), "_id")                     # at most max_rows ids
               .select("_d", F.explode(F.transform(words_of(F.col("_t")), bucket_of)).alias("b"))
               .groupBy("_d", "b").agg(F.count(F.lit(1)).alias("c")))          # at most BUCKETS rows a domain
    counts = np.zeros((len(domains), BUCKETS))
    for r in counted.collect():
        counts[domains.index(r._d), r.b] = r.c
    log_p = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
    total = sum(shares.values())
    prior = [math.log(shares.get(d, 0) / total) if shares.get(d) else -50.0 for d in domains] if total else [0.0] * len(domains)
    return {"domains": tuple(domains), "prior": prior, "weights": (log_p - log_p[0]).round(6).tolist()}


def _sum_of(weights: Column) -> Column:
    """The weights of a text's word buckets, added up."""
    return F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(weights, b))


def posteriors(docs: DataFrame, model: dict, *, text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """All columns of ``docs`` and ``_n`` (tokens) and ``_p0`` .. (posteriors
    in millionths)."""
    k = len(model["domains"])
    rows = docs.withColumn("_b", F.transform(words_of(F.col(f"`{text_col}`")), bucket_of))
    rows = rows.withColumn("_n", F.size("_b").cast("bigint"))
    scale = F.greatest(F.lit(1.0), F.col("_n") / F.lit(evidence))
    logs = [F.lit(model["prior"][0])]
    for j in range(1, k):
        weights = F.from_json(F.lit(json.dumps(model["weights"][j])), "array<double>")     # folded to a constant
        logs.append(_sum_of(weights) / scale + F.lit(model["prior"][j]))
    rows = rows.select("*", *[x.alias(f"_l{j}") for j, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"_l{j}") for j in range(k)])
    parts = [F.exp(F.col(f"_l{j}") - top) for j in range(k)]
    whole = sum(parts[1:], parts[0])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "_n",
                       *[F.round(1e6 * p / whole).cast("int").alias(f"_p{j}") for j, p in enumerate(parts)])


def rate_of(steps: list[list[float]], k: int, least: float) -> Column:
    """The rate after the given steps, from the posterior columns."""
    rate = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"_p{j}") * F.lit(step[j] / 1e6) for j in range(1, k)), F.col("_p0") * F.lit(step[0] / 1e6))
        rate = F.greatest(F.lit(float(least)), rate - move)
    return rate


def solve(table: DataFrame, targets: list[float], *, total: float | None = None, least: float = 0.0,
          passes: int = PASSES, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """The steps of ``rate_of`` for the rows (_n, _p0 ..), and the largest miss
    of a target that is left. ``total``: the token total aimed at, as a multiple
    of the present one; None stands for the smallest at which no domain's
    target lies under what it holds."""
    k = len(targets)
    p = [F.col(f"_p{j}") / 1e6 for j in range(k)]
    n = F.col("_n").cast("double")
    size = float(table.agg(F.sum(n).alias("n")).first().n or 0.0)
    if not size:
        return [], 0.0

    def sums(xs: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each x the convex function without its linear part, T and the
        second derivatives, in one pass."""
        cols = []
        for m, x in enumerate(xs):
            rate = F.lit(1.0) - sum((p[j] * F.lit(float(x[j])) for j in range(1, k)), p[0] * F.lit(float(x[0])))
            free = rate >= least
            cols.append(F.sum(n * F.when(free, rate * rate / 2).otherwise(rate * least - least * least / 2)).alias(f"f{m}"))
            cols += [F.sum(n * F.greatest(F.lit(float(least)), rate) * p[j]).alias(f"t{m}_{j}") for j in range(k)]
            cols += [F.sum(F.when(free, n * p[i] * p[j]).otherwise(0.0)).alias(f"h{m}_{i}_{j}")
                     for i in range(k) for j in range(i + 1)]
        row = table.agg(*cols).first()
        return [(row[f"f{m}"] / size, np.array([row[f"t{m}_{j}"] for j in range(k)]) / size,
                 np.array([[row[f"h{m}_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / size)
                for m in range(len(xs))]

    x = np.zeros(k)
    value, held, second = sums([x])[0]
    t = np.array(targets, dtype=float) / sum(targets)
    t = t * (total if total is not None else float(np.max(held / np.maximum(t, 1e-12))))
    shrink = 1.0
    for _ in range(passes):
        slope = t - held + RIDGE * x
        if np.abs(held - t).max() <= close or np.abs(slope).max() <= close / 100:
            break
        step = np.linalg.solve(second + RIDGE * np.eye(k), -slope)
        tried = [np.array([float(f"{v:.12g}") for v in x + shrink * a * step]) for a in LENGTHS]
        found = [(f + t @ y + RIDGE / 2 * (y @ y), h, s) for y, (f, h, s) in zip(tried, sums(tried), strict=True)]
        now = value + t @ x + RIDGE / 2 * (x @ x)
        best = next((m for m, a in enumerate(LENGTHS) if found[m][0] <= now + 1e-4 * shrink * a * (slope @ step)), None)
        if best is None:                                    # shorter steps next time
            shrink *= LENGTHS[-1] / 4
            if shrink < 1e-12:
                break
            continue
        x, shrink = tried[best], 1.0
        value, held, second = found[best][0] - t @ x - RIDGE / 2 * (x @ x), found[best][1], found[best][2]
    miss = float(np.abs(held - t).max())
    if miss > close:
        warnings.warn(f"mixing targets missed by up to {miss:.6f} of the tokens", RuntimeWarning, stacklevel=3)
    return ([x.tolist()] if x.any() else []), miss


def copies_of(rate: Column, key: Column) -> Column:
    """floor(rate + u), u in [0, 1) from a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1_000_000)) / 1e6
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, *, targets: dict = TARGETS, id_col: str = "doc_id", text_col: str = "text",
          total: float | None = 1.0, least: float = 0.0, domain: Column | None = None) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``p_<domain>`` .., ``rate``, ``copies``, and
    ``miss``, the largest miss of a target by the expected totals (at most
    ``CLOSE`` where the targets can be met)."""
    domains = tuple(targets)
    model = fit(docs, labels, domains, domain=domain, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    k = len(domains)
    rows = stored(posteriors(narrow, model, text_col="_t").select("_id", "_n", *[f"_p{j}" for j in range(k)]), "posteriors")
    steps, miss = solve(rows, [targets[d] for d in domains], total=total, least=least)
    rate = rate_of(steps, k, least)
    return rows.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"),
                       *[(F.col(f"_p{j}") / 1e6).alias(f"p_{d}") for j, d in enumerate(domains)],
                       rate.alias("rate"), copies_of(rate, F.col("_id")).alias("copies"),
                       F.lit(miss).alias("miss"))


def resample(docs: DataFrame, labels: DataFrame, *, targets: dict = TARGETS, id_col: str = "doc_id",
             text_col: str = "text", total: float | None = None, least: float = 1.0, domain: Column | None = None) -> DataFrame:
    """``docs`` with every row repeated by its copies (none: dropped). By
    default no document is dropped: the total is the smallest at which every
    target can be met by repeating, and no rate falls under one."""
    domains = tuple(targets)
    k = len(domains)
    model = fit(docs, labels, domains, domain=domain, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    rows = stored(posteriors(narrow, model, text_col="_t").select("_n", *[f"_p{j}" for j in range(k)]), "posteriors")
    steps, _ = solve(rows, [targets[d] for d in domains], total=total, least=least)
    # The rate is an expression of the row's own posteriors: no join back.
    times = copies_of(rate_of(steps, k, least), F.col(f"`{id_col}`"))
    # The row number keeps the optimizer from moving the filter, and with it a
    # second computation of the posteriors, below this projection.
    marked = posteriors(docs, model, text_col=text_col).select("*", times.alias("_times"),
                                                               F.monotonically_increasing_id().alias("_row"))
    return (marked.where("_times > 0 and _row >= 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
