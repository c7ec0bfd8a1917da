"""Episode validation, per-feed limits and download plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.strings import audio_name, blank, effective_id

# Fixed reject messages (first failing check wins, in this order).
STRICT_REASONS = ("missing episode ID", "missing episode title", "missing audio URL for episode: ")
LENIENT_REASONS = ("missing title", "missing enclosure")
DOWNLOAD_REASONS = ("url required", "dest required", "url must be http(s)")


def with_reject_reason(episodes: DataFrame, policy: str = "strict") -> DataFrame:
    """Adds ``reject_reason`` (NULL = valid).

    strict: id, then title, then audio URL must be non-empty (live host rule).
    lenient: a title and at least one enclosure; id falls back to the URL.
    """
    if policy == "strict":
        reason = (F.when(blank("id"), F.lit(STRICT_REASONS[0]))
                  .when(blank("title"), F.lit(STRICT_REASONS[1]))
                  .when(blank("audio_url"), F.concat(F.lit(STRICT_REASONS[2]), F.col("title"))))
        return episodes.withColumn("reject_reason", reason)
    if policy == "lenient":
        reason = (F.when(blank("title"), F.lit(LENIENT_REASONS[0]))
                  .when(F.col("enclosures") <= 0, F.lit(LENIENT_REASONS[1])))
        return (episodes.withColumn("reject_reason", reason)
                .withColumn("id", effective_id("id", "audio_url")))
    raise ValueError(f"unknown policy {policy!r}")


def validate_episodes(episodes: DataFrame, policy: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) split of the episode table."""
    tagged = with_reject_reason(episodes, policy)
    valid = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = tagged.where(F.col("reject_reason").isNotNull())
    return valid, rejected


def limit_per_feed(episodes: DataFrame, n: int | None, key: str = "feed_url",
                   order: str = "position") -> DataFrame:
    """First ``n`` episodes of each feed in feed order; ``n <= 0`` keeps all.

    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so a huge feed sends at most ``n`` rows per map task.
    """
    if not n or n <= 0:
        return episodes
    w = Window.partitionBy(key).orderBy(order)
    return episodes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def download_plan(episodes: DataFrame, output_dir: str) -> DataFrame:
    """(id, url, dest, reason): reason NULL = the download may run."""
    eid = effective_id("id", "audio_url")
    dest = F.when(F.lit(output_dir) == "", F.lit("")).otherwise(
        F.concat(F.lit(output_dir.rstrip("/") + "/"), audio_name(eid)))
    return (episodes.select(eid.alias("id"), F.coalesce(F.col("audio_url"), F.lit("")).alias("url"),
                            dest.alias("dest"))
            .withColumn("reason", F.when(blank("url"), F.lit(DOWNLOAD_REASONS[0]))
                        .when(blank("dest"), F.lit(DOWNLOAD_REASONS[1]))
                        .when(~F.col("url").startswith("http"), F.lit(DOWNLOAD_REASONS[2]))))
