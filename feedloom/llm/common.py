"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import checkpoint_root, release_memory, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch; whole texts travel in them, so the default of 10,000 holds much at a time.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workers_ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and hold the session's
    Arrow batches to ``BATCH_ROWS`` rows (a smaller setting stays)."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that hands its freed memory back when it ends: Python
    workers live on from stage to stage, and would keep their peak."""
    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()
    return task


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bytes_list(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None for null."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def record_batch(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for (_, t), c in zip(names_types, columns, strict=True)],
        names=[n for n, _ in names_types])


def renamed_away(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that extra columns (whatever
    their names) never reach its joins."""
    return df.select(*[F.col(f"`{c}`") for c in keep])
