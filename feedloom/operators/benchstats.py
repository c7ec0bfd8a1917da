"""Benchmark statistics (S6, B1-B9) as aggregates over a samples table
``(run, variant, ns_per_op)``.

Percentiles and the KS statistic need ordered samples. Samples are counted by
value first (a partial aggregate), so a value that a third of all samples
share is one row; the distinct values are then ordered by the distributed
running sum of ``ordered``, so a variant of many values is spread over many
tasks. Everything else is read off the same counted rows: the samples
themselves are evaluated once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.strings import trim_ws
from feedloom.operators.ordered import running_sum
from feedloom.session import cut_lineage

# Fixed values that must equal the reference's for identical results.
NAME_PATTERN = r"^(Benchmark\S+?/\S+?)(?:-\d+)?$"     # first token of a line
VALUE_PATTERN = r"^\S+\s+\d+\s+([\d.]+)\s+ns/op"      # what follows it
PERCENTILES = (0.5, 0.95, 0.99)
KS_TERMS = 99
EFFECT_BANDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
EFFECT_TOP = "large"
CONFIDENCE_BANDS = ((0.001, "*** (p < 0.001)"), (0.01, "** (p < 0.01)"), (0.05, "* (p < 0.05)"))
NOT_SIGNIFICANT = "not significant"


# --- S6 log parsing ---------------------------------------------------------------------

def parse_benchmark_lines(lines: DataFrame, line_col: str = "line", strip_procs: bool = True) -> DataFrame:
    """Benchmark output lines -> (…, variant, ns_per_op); other lines dropped
    (``rejected_lines`` returns those whose number cannot be read).

    The default pattern is the reference's (it also strips ``-100`` from a
    name ending in ``scale-100`` when the log has no proc suffix);
    ``strip_procs=False`` keeps the whole name."""
    # The name rule applies to the first token only (no backtracking over the
    # rest of the line), then plain checks on the count, value and unit.
    name_pat = NAME_PATTERN if strip_procs else r"^(Benchmark\S+/\S+)$"
    s = trim_ws(F.col(line_col))
    keep = [c for c in lines.columns if c != line_col]
    value = F.regexp_extract("_line", VALUE_PATTERN, 1).try_cast("double")
    variant = F.regexp_extract(F.regexp_extract("_line", r"^(\S+)", 1), name_pat, 1)
    # As the row of a generator the patterns are looked for once a line: the
    # filters below stay behind it, instead of looking for them by themselves.
    found = F.inline(F.array(F.struct(variant.alias("variant"), value.alias("ns_per_op"))))
    return (lines.select(*keep, s.alias("_line")).select(*keep, found)
            .where((F.col("variant") != "") & F.col("ns_per_op").isNotNull()))


def rejected_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The lines that have a sample's form but no readable number."""
    value = F.regexp_extract(trim_ws(F.col(line_col)), VALUE_PATTERN, 1)
    return lines.where((value != "") & value.try_cast("double").isNull())


def read_benchmark_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(run, variant, ns_per_op) from ``go test -bench`` text files; the run
    is the file's base name unless given."""
    raw = spark.read.text(path).select(
        (F.lit(run) if run else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)).alias("run"),
        F.col("value").alias("line"))
    return parse_benchmark_lines(raw)


# --- B1 / B2 summary --------------------------------------------------------------------------

def counted_values(samples: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, c), saved: how often each value occurs."""
    return cut_lineage(samples.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c")))


def _percentiles(counted: DataFrame, sizes: DataFrame, groups: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """A counted row holds the ranks ``cum_c - c`` to ``cum_c - 1``; it adds its
    value to a percentile by the weight of the two ranks around the position
    that it holds. ``sizes`` (one row a group) has ``n``."""
    ranked = running_sum(counted, [F.col(value).asc()], ["c"], groups).join(sizes.select(*groups, "n"), list(groups))

    def holds(rank: Column) -> Column:
        return ((rank >= F.col("cum_c") - F.col("c")) & (rank < F.col("cum_c"))).cast("double")

    out = []
    for p in ps:
        at = F.lit(p) * (F.col("n") - 1)
        high = at - F.floor(at)                            # weight of the rank above; 0 where there is none between
        weight = holds(F.floor(at)) * (F.lit(1.0) - high) + holds(F.ceil(at)) * high
        out.append(F.sum(F.when(weight > 0, F.col(value) * weight)).alias(f"p{int(round(p * 100))}"))
    return ranked.groupBy(*groups).agg(*out)


def exact_percentiles(samples: DataFrame, groups: Sequence[str], value: str,
                      ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """Linear interpolation at ``p*(n-1)`` (the reference's rule, same as
    Spark ``percentile`` and DuckDB ``quantile_cont``) from exact ranks."""
    counted = counted_values(samples, groups, value)
    return _percentiles(counted, counted.groupBy(*groups).agg(F.sum("c").alias("n")), list(groups), value, ps)


def _moments(counted: DataFrame, groups: Sequence[str], value: str, weight: str = "c") -> DataFrame:
    """(groups, n, min, max, mean, var): the variance (NULL for n < 2) is that
    of the distances from the mean, in a second pass over the counted rows."""
    counted = counted.where(F.col(weight) > 0)
    first = counted.groupBy(*groups).agg(
        F.sum(weight).cast("bigint").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
    away = F.sum(F.col(weight) * F.pow(F.col(value) - F.col("mean"), F.lit(2.0)))
    second = (counted.join(first.select(*groups, "n", "mean"), list(groups)).groupBy(*groups)
              .agg(F.try_divide(away, F.first("n") - 1).alias("var")))
    return first.join(second, list(groups))


def summary(samples: DataFrame, groups: Sequence[str] = ("run", "variant"),
            value: str = "ns_per_op") -> DataFrame:
    """B1: n, min, max, mean, sample std (0 when n = 1), p50, p95, p99."""
    groups = list(groups)
    counted = counted_values(samples, groups, value)
    basic = _moments(counted, groups, value).select(*groups, "n", "min", "max", "mean",
                                                    F.sqrt(F.coalesce("var", F.lit(0.0))).alias("std"))
    return basic.join(_percentiles(counted, basic, groups, value, PERCENTILES), groups, "inner")


# --- B3..B8 comparison ------------------------------------------------------------------------

def effect_magnitude(d: Column) -> Column:
    a = F.abs(d)
    out = F.when(a < EFFECT_BANDS[0][0], F.lit(EFFECT_BANDS[0][1]))
    for limit, name in EFFECT_BANDS[1:]:
        out = out.when(a < limit, F.lit(name))
    return out.otherwise(F.lit(EFFECT_TOP))


def confidence_level(p: Column) -> Column:
    out = F.when(p < CONFIDENCE_BANDS[0][0], F.lit(CONFIDENCE_BANDS[0][1]))
    for limit, name in CONFIDENCE_BANDS[1:]:
        out = out.when(p < limit, F.lit(name))
    return out.otherwise(F.lit(NOT_SIGNIFICANT))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic Kolmogorov series with 99 terms, clamped to [0, 1]."""
    n = n1 * n2 / (n1 + n2)
    lam = (F.sqrt(n) + F.lit(0.12) + F.lit(0.11) / F.sqrt(n)) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0).cast("double"),
                        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * terms))


def _both_counted(samples: DataFrame, in_a: Column, in_b: Column, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, ca, cb), saved: how often each value occurs in either run."""
    return cut_lineage(samples.where(F.col(value).isNotNull() & (in_a | in_b)).groupBy(*groups, value)
                       .agg(F.count(F.when(in_a, 1)).alias("ca"), F.count(F.when(in_b, 1)).alias("cb")))


def _ks(counted: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    cum = running_sum(counted, [F.col(value).asc()], ["ca", "cb"], groups)
    n = counted.groupBy(*groups).agg(F.sum("ca").alias("n1"), F.sum("cb").alias("n2"))
    return (cum.join(n, list(groups), "inner")
            .groupBy(*groups).agg(F.max(F.abs(F.try_divide("cum_ca", "n1") - F.try_divide("cum_cb", "n2"))).alias("ks_d"),
                                  F.first("n1").alias("n1"), F.first("n2").alias("n2")))


def _tagged(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(*cols, F.lit(True).alias("_a")).unionByName(b.select(*cols, F.lit(False).alias("_a")))


def ks_statistic(a: DataFrame, b: DataFrame, groups: Sequence[str] = ("variant",),
                 value: str = "ns_per_op") -> DataFrame:
    """Two-sample D per group: max |F_a(x) - F_b(x)| over the distinct
    values x (textbook form, symmetric, ties handled)."""
    groups = list(groups)
    counted = _both_counted(_tagged(a, b, [*groups, value]), F.col("_a"), ~F.col("_a"), groups, value)
    return _ks(counted, groups, value)


def compare(base: DataFrame, exp: DataFrame, value: str = "ns_per_op") -> DataFrame:
    """B9 of two tables of samples."""
    return _compared(_both_counted(_tagged(base, exp, ["variant", value]), F.col("_a"), ~F.col("_a"), ["variant"], value), value)


def compare_runs(samples: DataFrame, base: str, exp: str, value: str = "ns_per_op") -> DataFrame:
    """B9 of two runs of one table, evaluated once."""
    return _compared(_both_counted(samples, F.col("run") == base, F.col("run") == exp, ["variant"], value), value)


def _compared(counted: DataFrame, value: str) -> DataFrame:
    """Per variant present in both runs: means, delta %, Cohen's d
    (base - exp over the unweighted pooled sd; 0 when either n < 2 or the
    pooled sd is 0), magnitude, KS D, p-value and confidence band."""
    def stats(weight, tag):
        return _moments(counted, ["variant"], value, weight).select(
            "variant", F.col("n").alias(f"n_{tag}"), F.col("mean").alias(f"mean_{tag}"), F.col("var").alias(f"var_{tag}"))
    s = stats("ca", "base").join(stats("cb", "exp"), "variant", "inner")
    pooled = F.sqrt((F.col("var_base") + F.col("var_exp")) / 2)
    d = (F.when((F.col("n_base") < 2) | (F.col("n_exp") < 2), F.lit(0.0))
         .when(pooled == 0, F.lit(0.0))
         .otherwise((F.col("mean_base") - F.col("mean_exp")) / pooled))
    out = (s.withColumn("delta_pct", F.try_divide(F.col("mean_exp") - F.col("mean_base"), F.col("mean_base")) * 100)
           .withColumn("cohens_d", d)
           .join(_ks(counted, ["variant"], value).select("variant", "ks_d"), "variant", "inner"))
    p = ks_pvalue(F.col("ks_d"), F.col("n_base").cast("double"), F.col("n_exp").cast("double"))
    return (out.withColumn("magnitude", effect_magnitude(F.col("cohens_d")))
            .withColumn("p_value", p)
            .withColumn("confidence", confidence_level(F.col("p_value")))
            .select("variant", "n_base", "n_exp", "mean_base", "mean_exp", "delta_pct", "cohens_d",
                    "magnitude", "ks_d", "p_value", "confidence"))
