"""Benchmark statistics queries (S6, B1-B9, Q9): benchmark log lines
printed from ``lineitem`` (two runs split by order key parity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import benchstats as B
from feedloom.plans.registry import register
from feedloom.session import table


def bench_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    run = F.when(F.col("l_orderkey") % 2 == 0, F.lit("base")).otherwise(F.lit("exp"))
    procs = F.when(F.col("l_tax") > 0.04, F.lit("")).otherwise(F.lit("-16"))
    line = F.concat(F.lit("BenchmarkPrice/"), F.col("l_returnflag"), F.lit("/scale-"),
                    F.col("l_linenumber").cast("string"), procs, F.lit("\t"),
                    (F.col("l_linenumber") * 1000).cast("string"), F.lit("\t"),
                    F.format_string("%.2f", F.col("l_extendedprice")), F.lit(" ns/op"))
    header = table(spark, sf, "nation").select(F.lit("base").alias("run"),
                                               F.concat(F.lit("pkg: "), F.col("n_name")).alias("line"))
    return li.select(run.alias("run"), line.alias("line")).unionByName(header)


def bench_samples_df(spark, sf):
    return B.parse_benchmark_lines(bench_lines(spark, sf))


SAMPLES_SQL = r"""
lines AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE 'exp' END AS run,
    'BenchmarkPrice/' || l_returnflag || '/scale-' || CAST(l_linenumber AS VARCHAR)
    || CASE WHEN l_tax > 0.04 THEN '' ELSE '-16' END || chr(9) || CAST(l_linenumber * 1000 AS VARCHAR)
    || chr(9) || printf('%.2f', l_extendedprice) || ' ns/op' AS line
  FROM lineitem
  UNION ALL SELECT 'base', 'pkg: ' || n_name FROM nation
),
samples AS (
  SELECT run, regexp_extract(line, '^(Benchmark\S+?/\S+?)(?:-\d+)?\s+\d+\s+([\d.]+)\s+ns/op', 1) AS variant,
         CAST(regexp_extract(line, '^(Benchmark\S+?/\S+?)(?:-\d+)?\s+\d+\s+([\d.]+)\s+ns/op', 2) AS DOUBLE) AS ns_per_op
  FROM lines WHERE regexp_matches(line, '^(Benchmark\S+?/\S+?)(?:-\d+)?\s+\d+\s+([\d.]+)\s+ns/op')
)"""


@register("bench_samples", f"WITH {SAMPLES_SQL.strip()}\nSELECT run, variant, ns_per_op FROM samples")
def bench_samples(spark, sf):
    return bench_samples_df(spark, sf).select("run", "variant", "ns_per_op")


@register("bench_summary", f"""
WITH {SAMPLES_SQL.strip()}
SELECT run, variant, CAST(count(*) AS BIGINT) AS n, round(min(ns_per_op), 6) AS min, round(max(ns_per_op), 6) AS max,
  round(avg(ns_per_op), 6) AS mean, round(coalesce(stddev_samp(ns_per_op), 0), 6) AS std,
  round(quantile_cont(ns_per_op, 0.5), 6) AS p50, round(quantile_cont(ns_per_op, 0.95), 6) AS p95,
  round(quantile_cont(ns_per_op, 0.99), 6) AS p99
FROM samples GROUP BY run, variant""")
def bench_summary(spark, sf):
    s = B.summary(bench_samples_df(spark, sf))
    return s.select("run", "variant", F.col("n").cast("bigint").alias("n"),
                    *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p50", "p95", "p99")])


@register("bench_compare", f"""
WITH {SAMPLES_SQL.strip()},
st AS (SELECT variant,
  count(*) FILTER (WHERE run = 'base') AS n_base, count(*) FILTER (WHERE run = 'exp') AS n_exp,
  avg(ns_per_op) FILTER (WHERE run = 'base') AS mean_base, avg(ns_per_op) FILTER (WHERE run = 'exp') AS mean_exp,
  var_samp(ns_per_op) FILTER (WHERE run = 'base') AS var_base, var_samp(ns_per_op) FILTER (WHERE run = 'exp') AS var_exp
  FROM samples GROUP BY variant HAVING count(*) FILTER (WHERE run = 'base') > 0 AND count(*) FILTER (WHERE run = 'exp') > 0),
pv AS (SELECT variant, ns_per_op AS x, count(*) FILTER (WHERE run = 'base') AS ca, count(*) FILTER (WHERE run = 'exp') AS cb
       FROM samples GROUP BY variant, ns_per_op),
cum AS (SELECT variant, sum(ca) OVER (PARTITION BY variant ORDER BY x) AS cca,
               sum(cb) OVER (PARTITION BY variant ORDER BY x) AS ccb FROM pv),
ks AS (SELECT cum.variant, max(abs(cca / st.n_base - ccb / st.n_exp)) AS ks_d FROM cum JOIN st USING (variant) GROUP BY cum.variant),
j AS (SELECT st.*, ks.ks_d,
  CASE WHEN n_base < 2 OR n_exp < 2 OR sqrt((var_base + var_exp) / 2) = 0 THEN 0.0
       ELSE (mean_base - mean_exp) / sqrt((var_base + var_exp) / 2) END AS d,
  (sqrt(n_base * n_exp / (n_base + n_exp)) + 0.12 + 0.11 / sqrt(n_base * n_exp / (n_base + n_exp))) * ks.ks_d AS lam
  FROM st JOIN ks USING (variant)),
p AS (SELECT *, least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 100),
        lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))))) AS pv FROM j)
SELECT variant, CAST(n_base AS BIGINT) AS n_base, CAST(n_exp AS BIGINT) AS n_exp,
  round(mean_base, 6) AS mean_base, round(mean_exp, 6) AS mean_exp,
  round((mean_exp - mean_base) / mean_base * 100, 6) AS delta_pct, round(d, 6) AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude,
  round(ks_d, 6) AS ks_d, round(pv, 6) AS p_value,
  CASE WHEN pv < 0.001 THEN '*** (p < 0.001)' WHEN pv < 0.01 THEN '** (p < 0.01)' WHEN pv < 0.05 THEN '* (p < 0.05)'
       ELSE 'not significant' END AS confidence
FROM p""")
def bench_compare(spark, sf):
    c = B.compare_runs(bench_samples_df(spark, sf), "base", "exp")
    return c.select("variant", F.col("n_base").cast("bigint"), F.col("n_exp").cast("bigint"),
                    *[F.round(x, 6).alias(x) for x in ("mean_base", "mean_exp", "delta_pct", "cohens_d")],
                    "magnitude", F.round("ks_d", 6).alias("ks_d"), F.round("p_value", 6).alias("p_value"),
                    "confidence")


@register("bench_rejected", r"""
WITH l AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE 'exp' END AS run,
    'BenchmarkPrice/' || l_returnflag || chr(9) || '7' || chr(9)
    || CASE l_linenumber WHEN 2 THEN '1.2.3' WHEN 3 THEN '.' WHEN 4 THEN 'fast' ELSE printf('%.2f', l_extendedprice) END || ' ns/op' AS line
  FROM lineitem)
SELECT l_orderkey, run, line FROM l WHERE l_linenumber IN (2, 3)""")
def bench_rejected(spark, sf):
    """Lines in a sample's form whose number cannot be read come back;
    lines of another form are no samples at all."""
    li = table(spark, sf, "lineitem")
    number = (F.when(F.col("l_linenumber") == 2, F.lit("1.2.3")).when(F.col("l_linenumber") == 3, F.lit("."))
              .when(F.col("l_linenumber") == 4, F.lit("fast")).otherwise(F.format_string("%.2f", F.col("l_extendedprice"))))
    line = F.concat(F.lit("BenchmarkPrice/"), F.col("l_returnflag"), F.lit("\t7\t"), number, F.lit(" ns/op"))
    run = F.when(F.col("l_orderkey") % 2 == 0, F.lit("base")).otherwise(F.lit("exp"))
    return B.rejected_lines(li.select("l_orderkey", run.alias("run"), line.alias("line")))
