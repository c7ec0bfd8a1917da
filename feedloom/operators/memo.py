"""Memoised artifacts as a table.

``artifacts(key, kind, value, size_bytes, last_used)`` replaces the
reference's content-addressed blob directory: lookups are joins, upserts
are latest-wins aggregates, and the LRU byte budget is an exact running
sum computed without gathering the table in one task.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.strings import artifact_key, blank
from feedloom.operators.latest import pick
from feedloom.operators.ordered import running_sum
from feedloom.session import cut_lineage

# Fixed values that must equal the reference's for identical results.
DEFAULT_MAX_BYTES = 256 * 1024 * 1024
MAX_KEY_BYTES = 200
# Spans of time an eviction looks at in one pass, and rows it puts in order at the edge.
BUCKETS = 4096
FEW_ROWS = 200_000
NEVER = -(2 ** 61)
TOO_LARGE = "larger than the store"
KEY_REASONS = ("empty", "longer than 200 bytes", "starts with a dot", "invalid character")


@dataclass
class StoreSettings:
    """M7: location and budget; option, then environment, then default.

    A non-positive or unparsable budget means the default; an empty location
    turns memoisation off (every stage runs) and never fails the run."""
    path: str | None = None
    max_bytes: int | None = None

    def resolved(self) -> StoreSettings:
        path = self.path if self.path is not None else os.environ.get("FEEDLOOM_CACHE_DIR", "")
        budget = self.max_bytes
        if budget is None:
            try:
                budget = int(os.environ.get("FEEDLOOM_CACHE_MAX_BYTES", ""))
            except ValueError:
                budget = None
        if budget is None or budget <= 0:
            budget = DEFAULT_MAX_BYTES
        return StoreSettings(path or None, budget)

    @property
    def enabled(self) -> bool:
        return bool(self.resolved().path)


# --- M1 keys and F7 key rules -------------------------------------------------------

def transcript_key(audio_url) -> Column:
    """Transcript identity: the audio URL only (title and guid never matter)."""
    return artifact_key("transcript", audio_url)


def entry_key(audio_url, scheme_id, scheme) -> Column:
    """Entry identity: audio URL + scheme id + scheme text."""
    return artifact_key("entry", audio_url, scheme_id, scheme)


def key_reason(key) -> Column:
    """NULL for a usable store key, else why it is refused."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.when(blank(k), F.lit(KEY_REASONS[0]))
            .when(F.octet_length(k) > MAX_KEY_BYTES, F.lit(KEY_REASONS[1]))
            .when(k.startswith("."), F.lit(KEY_REASONS[2]))
            .when(~k.rlike(r"^[A-Za-z0-9._-]+\z"), F.lit(KEY_REASONS[3])))


# --- M2 lookup, F5 predicate, M8 outputs --------------------------------------------------

def memo_lookup(df: DataFrame, artifacts: DataFrame | None, key: str = "key",
                value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(hits with ``value``, misses). A NULL key or a disabled store is a miss.

    The artifact side is projected to (key, value) before the join so only
    the needed columns are scanned; AQE picks broadcast or sort-merge from
    the measured sizes."""
    if artifacts is None:
        return df.limit(0).withColumn(value, F.lit(None).cast("string")), df
    art = artifacts.select(F.col("key").alias(key), F.col("value").alias(value))
    hits = df.join(art, key, "inner")
    misses = df.join(art.select(key), key, "left_anti")      # the anti side reads keys only
    return hits, misses


def memo_join(df: DataFrame, artifacts: DataFrame | None, key: str = "key", value: str = "value") -> DataFrame:
    """``df`` with ``value`` (NULL for a miss): hits and misses in one pass
    over ``df``. The store holds a key once, so no row is repeated."""
    if artifacts is None:
        return df.withColumn(value, F.lit(None).cast("string"))
    return df.join(artifacts.select(F.col("key").alias(key), F.col("value").alias(value)), key, "left")


def needs_transcription(episodes: DataFrame, artifacts: DataFrame | None,
                        key: str = "transcript_key") -> DataFrame:
    """Rows with an empty transcript and no cached transcript."""
    empty = episodes.where(blank("transcript"))
    return memo_lookup(empty, artifacts, key)[1]


# --- M3 upsert, M4 refresh, M5 evict, M6 refusal -------------------------------------------

def memo_put(artifacts: DataFrame | None, new: DataFrame) -> DataFrame:
    """Upsert by key, latest ``last_used`` wins (new rows win ties). New rows
    whose key a store refuses (``key_reason``) are left out; ``refused_rows``
    gives them back.

    Keys and times decide (``latest``); a stored value moves only where its
    key is put again, and then as the loser or the winner of one join."""
    cols = ["key", "kind", "value", "size_bytes", "last_used"]
    fresh = pick(new.where(key_reason("key").isNull()).select(*cols), "key", [F.col("last_used")]).kept
    if artifacts is None:
        return fresh
    old = artifacts.select(*cols)
    seen = F.coalesce(F.col("last_used"), F.lit("0001-01-01").cast("timestamp"))
    times = old.select("key", seen.alias("_old")).join(fresh.select("key", seen.alias("_new")), "key")
    beaten = times.where("_old <= _new").select("key")
    late = times.where("_old > _new").select("key")
    return old.join(beaten, "key", "left_anti").unionByName(fresh.join(late, "key", "left_anti"))


def refused_rows(new: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The rows that a put does not take, with the ``reason``: a key that is no
    usable name, or a value larger than the whole budget."""
    reason = key_reason("key")
    if max_bytes is not None:
        reason = F.coalesce(reason, F.when(F.col("size_bytes") > max_bytes, F.lit(TOO_LARGE)))
    return new.withColumn("reason", reason).where(F.col("reason").isNotNull())


def memo_refresh(artifacts: DataFrame, access_log: DataFrame) -> DataFrame:
    """A read makes the entry most recent: ``last_used`` = latest of its own
    time and its reads (access log: key, accessed_at)."""
    reads = access_log.groupBy("key").agg(F.max("accessed_at").alias("_read"))
    return (artifacts.join(reads, "key", "left")
            .withColumn("last_used", F.greatest("last_used", F.coalesce("_read", "last_used")))
            .drop("_read"))


def memo_evict(artifacts: DataFrame, max_bytes: int, num_partitions: int | None = None, buckets: int = BUCKETS,
               few: int = FEW_ROWS) -> DataFrame:
    """Keep what an oldest-first eviction down to ``max_bytes`` keeps.

    Evicting oldest-first until the total fits keeps exactly the rows whose
    newest-first running byte total is within the budget (zero-size rows
    included). Ties on ``last_used`` evict the smaller key first.

    Bytes are added up in at most ``buckets`` spans of time; the prefix sum
    over that small table finds the span in which the budget runs out, which
    is split again until it holds ``few`` rows or one instant. Everything
    newer stays and everything older goes by a comparison of times; only
    inside that last span are rows put in order."""
    meta = cut_lineage(artifacts.select("key", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), _instant().alias("_t")))
    all_ = meta.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.sum("size_bytes").alias("bytes")).first()
    if all_.bytes is None or all_.bytes <= max_bytes:
        return artifacts
    lo, hi, spent = all_.lo, all_.hi, 0
    while True:
        width = max(1, -(-(hi - lo + 1) // buckets))
        inside = meta.where(F.col("_t").between(lo, hi))
        spans = (inside.groupBy(F.floor((F.lit(hi) - F.col("_t")) / F.lit(width).cast("decimal(38,0)")).cast("bigint").alias("b"))
                 .agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))).collect()    # at most ``buckets`` rows
        for span in sorted(spans, key=lambda r: r.b):
            if spent + span.bytes > max_bytes:
                break
            spent += span.bytes
        hi, lo = hi - span.b * width, max(lo, hi - (span.b + 1) * width + 1)
        if width == 1 or span.rows <= few:
            break
    edge = running_sum(meta.where(F.col("_t").between(lo, hi)), [F.col("_t").desc(), F.col("key").desc()], ["size_bytes"],
                       num_partitions=num_partitions)
    keep = edge.where(F.col("cum_size_bytes") <= max_bytes - spent).select("key")
    newer = artifacts.where(_instant() > hi)
    return newer.unionByName(artifacts.where(_instant().between(lo, hi)).join(keep, "key", "left_semi"))


def _instant() -> Column:
    """``last_used`` in microseconds; never used counts as oldest."""
    return F.coalesce(F.unix_micros(F.col("last_used").cast("timestamp")), F.lit(NEVER))


def memo_put_bounded(artifacts: DataFrame | None, new: DataFrame, max_bytes: int,
                     num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(store after put + eviction, refused rows with their ``reason``). A
    value larger than the whole budget and an unusable key are refused;
    eviction still runs for the rest."""
    refused = refused_rows(new, max_bytes)
    stored = memo_put(artifacts, new.where(F.col("size_bytes") <= max_bytes))
    return memo_evict(stored, max_bytes, num_partitions), refused


def artifact_rows(df: DataFrame, key: str, kind: str, value: str, at: Column) -> DataFrame:
    """(key, kind, value, size_bytes, last_used) rows for ``memo_put``;
    NULL keys (uncacheable rows) are dropped."""
    return (df.where(F.col(key).isNotNull())
            .select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(value).alias("value"),
                    F.octet_length(value).cast("bigint").alias("size_bytes"), at.alias("last_used")))


# --- M4 + M7: the store on shared storage -------------------------------------------------

class MemoStore:
    """A memo table kept under one folder: ``data/batch=<n>`` snapshots
    (the latest committed one is current) and an append-only ``access``
    log of reads. An unusable store turns memoisation off; a failed write
    is reported and never fails the run."""

    def __init__(self, spark, settings: StoreSettings):
        self.spark = spark
        self.settings = settings.resolved()
        self.path = (self.settings.path or "").rstrip("/")
        self.last_error: str | None = None

    @property
    def enabled(self) -> bool:
        return bool(self.path)

    def _latest(self):
        from feedloom.sinks.artifacts import committed_batches
        batches = committed_batches(self.spark, f"{self.path}/data")
        return batches[-1][1] if batches else None

    def load(self) -> DataFrame | None:
        if not self.enabled:
            return None
        try:
            latest = self._latest()
            if latest is None:
                return None
            return self.spark.read.parquet(latest).select("key", "kind", "value", "size_bytes", "last_used")
        except Exception as e:  # noqa: BLE001  (cannot open -> caching off)
            self.last_error = f"{type(e).__name__}: {e}"
            return None

    def record_reads(self, keys: DataFrame) -> None:
        """Append (key, accessed_at) for every recalled key (M4)."""
        if not self.enabled:
            return
        from feedloom.sinks.artifacts import append_batch
        try:
            append_batch(keys.where(F.col("key").isNotNull())
                         .select("key", F.current_timestamp().alias("accessed_at")), f"{self.path}/access")
        except Exception as e:  # noqa: BLE001
            self.last_error = f"{type(e).__name__}: {e}"

    def save(self, new: DataFrame) -> DataFrame | None:
        """Fold the unread part of the access log, put the new rows, evict to
        the budget and commit the result as the next snapshot. Returns the
        refused rows (values larger than the whole budget)."""
        if not self.enabled:
            return None
        from feedloom.sinks.artifacts import append_batch, committed_batches
        try:
            cur = self.load()
            access = committed_batches(self.spark, f"{self.path}/access")
            if cur is not None:
                snap = self.spark.read.parquet(self._latest())
                # reads up to this access batch are already folded into the snapshot
                upto = snap.agg(F.max("access_upto")).first()[0] if "access_upto" in snap.columns else None
                fresh = [d for n, d in access if n > (-1 if upto is None else upto)]
                if fresh:
                    cur = memo_refresh(cur, self.spark.read.parquet(*fresh).select("key", "accessed_at"))
            stored, refused = memo_put_bounded(cur, new, self.settings.max_bytes)
            top = access[-1][0] if access else -1
            append_batch(stored.withColumn("access_upto", F.lit(top)), f"{self.path}/data")
            return refused
        except Exception as e:  # noqa: BLE001  (the run already has its values)
            self.last_error = f"{type(e).__name__}: {e}"
            return None
