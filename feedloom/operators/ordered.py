"""Exact running sums and ranks in a global (or per-group) order without a
single-task window.

A plain ``sum().over(Window.orderBy(...))`` moves the whole table (or a whole
hot group) into one task. Here the rows are range-partitioned on
(group, order) — range bounds split even one huge group across tasks — then:

1. each range partition computes local running sums (bounded task size);
2. per (partition, group) totals form a small table of at most
   ``P + #groups`` rows, whose own running sum gives each partition's offset;
3. offsets join back on (partition, group).

The partition id is pinned with a reliable checkpoint so a recomputed task
sees the same ranges after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import cut_lineage, shuffle_partitions


def running_sum(df: DataFrame, order: Sequence[Column], values: Sequence[str],
                groups: Sequence[str] = (), num_partitions: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Adds ``cum_<v>`` = inclusive running sum of ``v`` in ``order`` within
    ``groups``. ``order`` must be total (end it with a unique key)."""
    spark = df.sparkSession
    p = num_partitions or shuffle_partitions(spark)
    keys = [F.col(g).asc() for g in groups] + list(order)
    ranged = df.repartitionByRange(p, *keys).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)

    local_w = (Window.partitionBy("_pid", *groups).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged
    for v in values:
        local = local.withColumn(f"_loc_{v}", F.sum(v).over(local_w))

    totals = ranged.groupBy("_pid", *groups).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    off_w = (Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *groups, *[
        F.coalesce(F.sum(f"_tot_{v}").over(off_w), F.lit(0)).alias(f"_off_{v}") for v in values])

    out = local.join(offsets, ["_pid", *groups], "inner")
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_loc_{v}") + F.col(f"_off_{v}"))
    return out.drop("_pid", *[f"_loc_{v}" for v in values], *[f"_off_{v}" for v in values])


def row_rank(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (),
             num_partitions: int | None = None, name: str = "rank") -> DataFrame:
    """0-based position in ``order`` within ``groups`` (exact, distributed)."""
    out = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], groups,
                      num_partitions, prefix="_c")
    return out.withColumn(name, F.col("_c_one") - 1).drop("_one", "_c_one")
