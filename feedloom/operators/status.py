"""Run status, error classes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.strings import effective_id

# Fixed error classes (declared by the reference; only the first is used there).
ERROR_CLASSES = ("transcription timeout", "invalid feed", "download", "extraction", "storage")
FAILED = ("error", "failed", "rejected")


class RunFailed(RuntimeError):
    """Raised when a run has failed episodes and ``raise_on_error`` is set."""


def error_class(stage, error) -> F.Column:
    stage, error = F.col(stage) if isinstance(stage, str) else stage, F.col(error) if isinstance(error, str) else error
    return (F.when(error.isNull(), F.lit(None).cast("string"))
            .when((stage == "transcribe") & F.lower(error).contains("timeout"), F.lit(ERROR_CLASSES[0]))
            .when(stage == "feed", F.lit(ERROR_CLASSES[1]))
            .when(stage == "download", F.lit(ERROR_CLASSES[2]))
            .when(stage == "extract", F.lit(ERROR_CLASSES[3]))
            .when(stage == "store", F.lit(ERROR_CLASSES[4]))
            .otherwise(F.lit(None).cast("string")))


def stage_status(df: DataFrame, stage: str, status_col: str, error_col: str,
                 value_col: str | None = None) -> DataFrame:
    """R1 rows for one stage: (feed_url, episode_id, stage, status, error,
    error_class[, value]) — one projection of the stage output, no join."""
    feed = F.col("feed_url") if "feed_url" in df.columns else F.lit(None).cast("string")
    extra = [F.col(value_col).alias("value")] if value_col else []
    return df.select(feed.alias("feed_url"), effective_id("id", "audio_url").alias("episode_id"),
                     F.lit(stage).alias("stage"), F.col(status_col).alias("status"),
                     F.col(error_col).alias("error"),
                     error_class(F.lit(stage), F.col(error_col)).alias("error_class"), *extra)


def summarize(status: DataFrame, by: tuple[str, ...] = ("feed_url", "stage"),
              per_class: tuple[str, ...] = ()) -> DataFrame:
    """Counts per (feed, stage), plus ``n_<class>`` for the named
    error classes; one partial aggregate."""
    bad = F.col("status").isin(*FAILED)
    classes = [F.count(F.when(F.col("error_class") == c, 1)).cast("bigint").alias("n_" + c.replace(" ", "_"))
               for c in per_class]
    return status.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   F.count(F.when(~bad, 1)).cast("bigint").alias("n_ok"),
                                   F.count(F.when(bad, 1)).cast("bigint").alias("n_error"), *classes)


def raise_on_error(status: DataFrame, show: int = 20) -> None:
    """R2: fail the run when any episode failed; the message joins the
    first ``show`` errors (a bounded sample, the counts are exact)."""
    bad = status.where(F.col("status").isin(*FAILED))
    first = bad.orderBy("stage", "episode_id").limit(show).collect()
    if first:
        n = bad.count()
        lines = [f"{r['stage']} {r['episode_id']}: {r['error']}" for r in first]
        raise RunFailed(f"{n} episode(s) failed:\n" + "\n".join(lines))
