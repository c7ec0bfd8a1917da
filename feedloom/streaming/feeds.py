"""Incremental feed ingestion with Structured Streaming.

New feed files landing in a folder are parsed, validated and appended to an
episode table. Re-ingestion is safe: episodes are identified by audio URL (without
one, by feed and guid or position), and each micro-batch anti-joins against what the table already holds
before it appends (an idempotent sink: a replayed batch writes nothing
new). What the table holds is kept in buckets beside it (``identities``), so a
batch reads the buckets of its own rows and not the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.validate import with_reject_reason
from feedloom.session import cut_lineage
from feedloom.sinks.artifacts import BUNDLE_DDL, read_batches
from feedloom.sources.feeds import episodes as feed_episodes
from feedloom.sources.feeds import feed_errors, parse_feeds
from feedloom.streaming.identities import IdentityIndex


def with_identity(df: DataFrame) -> DataFrame:
    """Adds ``identity``: the audio URL, or, where there is none (an empty URL
    is no identity), the feed with the guid or else the position."""
    own = F.concat_ws("\n", F.lit(""), F.coalesce("feed_url", F.lit("")),
                      F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("id "), F.col("id")))
                      .otherwise(F.concat(F.lit("at "), F.col("position").cast("string"))))
    return df.withColumn("identity", F.when(F.coalesce("audio_url", F.lit("")) != "", F.col("audio_url")).otherwise(own))


def dedupe_by_identity(df: DataFrame) -> DataFrame:
    """One row per identity (the earliest by feed and position); a partial
    ``min_by`` aggregate, so duplicates are folded map-side."""
    cols = [c for c in df.columns if c != "identity"]
    return (df.groupBy("identity").agg(F.min_by(F.struct(*cols), F.struct("feed_url", "position")).alias("_v"))
            .select("identity", *[F.col("_v")[c].alias(c) for c in cols]))


def ingest_batch(batch: DataFrame, table_path: str, policy: str = "strict") -> int | None:
    """T2/T3 for one micro-batch: parse once, validate, dedupe, skip what the
    table already has, append. Feeds that cannot be read and episodes that are
    rejected go to ``<table_path>_errors``, deduped by what they name, so a
    replay adds none. Returns the batch number written (None when nothing was
    new)."""
    spark = batch.sparkSession
    parsed = parse_feeds(batch, "xml", "feed_url")
    eps = cut_lineage(with_identity(with_reject_reason(feed_episodes(parsed, "rss"), policy)
                                    .withColumn("categories", F.array_join("categories", "|"))))
    bad = (feed_errors(parsed, "rss").select("feed_url", F.lit(None).cast("bigint").alias("position"), F.col("error").alias("reason"))
           .unionByName(eps.where(F.col("reject_reason").isNotNull())
                        .select("feed_url", F.col("position").cast("bigint").alias("position"), F.col("reject_reason").alias("reason"))))
    IdentityIndex(spark, f"{table_path}_errors", _error_identity()).append_new(bad.distinct())
    good = dedupe_by_identity(eps.where(F.col("reject_reason").isNull()).drop("reject_reason"))
    return IdentityIndex(spark, table_path, F.col("identity")).append_new(good)


def _error_identity() -> Column:
    return F.to_json(F.array("feed_url", F.col("position").cast("string"), "reason"))


def stream_feeds(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str | None = None,
                 policy: str = "strict", available_now: bool = True, max_files: int | None = None,
                 bundles: bool = False) -> StreamingQuery:
    """Watch ``source_dir`` for feed files (one feed per file) and
    append new, valid, unseen episodes to ``table_path``. The stream's own
    checkpoint lies beside the table unless another place is given, so a
    second run reads only new files.

    Spark lists every file for each run and again for each batch, and sends
    the lists to the driver; so very many feeds should come as ``bundles``,
    the (name, text) files of ``artifacts.export_bundles`` with many feeds
    each, whose names are the feeds' URLs."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if bundles:
        raw = reader.schema(BUNDLE_DDL).parquet(source_dir).select(F.col("name").alias("feed_url"), F.col("text").alias("xml"))
    else:
        files = reader.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(source_dir)
        raw = files.select(F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("xml"))
    w = (raw.writeStream.foreachBatch(lambda df, epoch: ingest_batch(df, table_path, policy))
         .option("checkpointLocation", checkpoint or f"{table_path.rstrip('/')}_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_episode_table(spark: SparkSession, table_path: str) -> DataFrame | None:
    b = read_batches(spark, table_path)
    return None if b is None else b.drop("batch", "identity")


def read_error_table(spark: SparkSession, table_path: str) -> DataFrame | None:
    """(feed_url, position, reason): unreadable feeds (no position) and
    rejected episodes of all batches."""
    b = read_batches(spark, f"{table_path}_errors")
    return None if b is None else b.drop("batch")
