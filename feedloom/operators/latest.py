"""One row for each key, picked on narrow columns.

The rows are written once to the shared scratch folder with a row number;
winners are found on (key, order, row number) alone, by hash aggregates where
the order is a number or a time, round by round (one for each order column, then the row number, so
that every tie has a defined winner); and the rows themselves move once, in
the semi join with the winning numbers. A hot key is folded in every task
before it moves. The rows that lose stay available."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import scratch_path

LOWEST = -(2 ** 63) + 1


class Picked(NamedTuple):
    kept: DataFrame
    lost: DataFrame


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` as a written table with a number for each row, the same at
    every reading."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "numbered")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def order_terms(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """``order`` as bigint columns (texts stay texts) of the same order; NULL
    comes lowest."""
    out = []
    for c in order:
        kind = df.select(c.alias("o")).schema["o"].dataType
        if isinstance(kind, T.StructType):
            out += order_terms(df, [c[f.name] for f in kind.fields])
        elif isinstance(kind, T.StringType):
            out.append(F.coalesce(c, F.lit("")))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(LOWEST)))
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            out.append(F.coalesce(c.cast("bigint"), F.lit(LOWEST)))
        else:
            raise TypeError(f"cannot order by {kind.simpleString()}")
    return out


def pick(df: DataFrame, key: str, order: Sequence[Column] = (), smallest: bool = False) -> Picked:
    """The row of the greatest ``order`` for each ``key`` (with ``smallest`` the
    least), the last row of equals (the first), and the other rows."""
    terms, best = order_terms(df, order), F.min if smallest else F.max
    saved = numbered(df.select("*", *[t.alias(f"_o{i}") for i, t in enumerate(terms)]))
    left = saved.select(F.col(key).alias("_key"), *[f"_o{i}" for i in range(len(terms))], "_row")
    for i in range(len(terms)):
        top = left.groupBy("_key").agg(best(f"_o{i}").alias("_top"))
        left = (left.join(top.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col(f"_o{i}") == F.col("_top")))
                .drop("_k", "_top"))
    won = left.groupBy("_key").agg(best("_row").alias("_row")).select("_row")
    drop = [f"_o{i}" for i in range(len(terms))] + ["_row"]
    return Picked(saved.join(won, "_row", "left_semi").drop(*drop), saved.join(won, "_row", "left_anti").drop(*drop))
