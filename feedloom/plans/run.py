"""A run from feeds to stored entries with five named stages, each of which
can be replaced (D4, N4, R1-R7).

Stage      request (JSON)                          reply
=========  ======================================  ==========================================
feed       ``{"url", "xml"}``                       ``{"podcast": {...}, "episodes": [{...}]}``
download   ``{"url", "dest"}``                      anything; an error is a failed download
transcribe ``{"audio_url", "initial_prompt"}``      ``{"transcript": ...}`` or text
extract    a chat request                           a chat reply
store      ``{"name", "text"}``                     anything; an error is a failed write
=========  ======================================  ==========================================

``feed`` and ``store`` have built-in forms (``read_feeds`` with the dialect of
each row, and the tables of ``sinks.artifacts``). ``download`` is passed over
where nobody does it; without ``transcribe`` or ``extract`` the rows that need
it have an error each, or, with ``skip_missing``, the status ``skipped``.

Every stage is saved once and counted by the job that saves it
(``DataFrame.observe``), so the run summary with its counts, limit and seconds
costs no job of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import strings as S
from feedloom.operators import memo as M
from feedloom.operators import status as R
from feedloom.operators.enrich import call_key, call_once, extract, transcribe
from feedloom.operators.validate import limit_per_feed, with_reject_reason
from feedloom.plans.flow import STAGES, RunOptions
from feedloom.session import cut_lineage
from feedloom.sinks import artifacts as K
from feedloom.sources.feeds import FeedTables, read_feeds

REPLY_DDL = ("podcast struct<title string, description string, author string, categories array<string>>, "
             "episodes array<struct<id string, title string, audio_url string, pub_date string, description string, "
             "author string, duration string, explicit boolean, categories array<string>, transcript string>>")
SUMMARY_DDL = "stage string, n bigint, n_ok bigint, n_error bigint, limit int, seconds double"
FAILED_FEED, NO_EPISODES = "feed", "no episodes in the reply"


class Run(NamedTuple):
    podcasts: DataFrame
    episodes: DataFrame
    entries: DataFrame
    status: DataFrame
    summary: DataFrame
    new_artifacts: DataFrame


@dataclass
class _Stages:
    """The stages of a run: their saved rows, status rows and counts."""
    spark: SparkSession
    options: RunOptions
    rows: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def save(self, stage: str, df: DataFrame, status: Column, error: Column, episode_id: Column, tables: bool = True) -> DataFrame:
        """``df`` saved and counted in one job; its status rows join the run's.
        With ``fail_fast`` a stage with an error ends the run."""
        bad = F.coalesce(status.isin(*R.FAILED), F.lit(False))
        seen, start = Observation(f"stage-{stage}"), time.time()
        shown = df.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"))
        saved = cut_lineage(shown)
        got = seen.get
        self.counts.append((stage, got["n"], got["n"] - got["bad"], got["bad"], self.options.limit, round(time.time() - start, 3)))
        self.rows.append(saved.select(
            F.col("feed_url"), episode_id.alias("episode_id"), F.lit(stage).alias("stage"), status.alias("status"),
            error.alias("error"), R.error_class(F.lit(stage), error).alias("error_class")))
        if self.options.fail_fast and got["bad"]:
            R.raise_on_error(self.status())
        return saved

    def status(self) -> DataFrame:
        out = self.rows[0]
        for more in self.rows[1:]:
            out = out.unionByName(more)
        return out


def _called_feeds(feeds: DataFrame, fn: Callable, max_parallel: int | None, row_fn: bool) -> FeedTables:
    """Feeds read by a replaced stage; one call a feed."""
    request = F.to_json(F.struct(F.col("feed_url").alias("url"), F.col("xml")))
    calls = call_once(feeds, fn, F.col("feed_url"), request, max_parallel=max_parallel, row_fn=row_fn, stage=FAILED_FEED)
    got = calls.select(F.col("call_key").alias("feed_url"), "error", F.from_json("reply", REPLY_DDL).alias("r"))
    error = F.coalesce("error", F.when(F.col("r.episodes").isNull(), F.lit(NO_EPISODES)))
    good = got.where(error.isNull())

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[-1])
    none = F.array().cast("array<string>")
    podcasts = good.select("feed_url", text("r.podcast.title"), text("r.podcast.description"), F.col("feed_url").alias("url"),
                           text("r.podcast.author"), F.coalesce("r.podcast.categories", none).alias("categories"))
    episodes = good.select("feed_url", F.posexplode("r.episodes").alias("position", "e")).select(
        "feed_url", "position", *[text(f"e.{c}") for c in ("id", "title", "audio_url", "pub_date", "description", "author", "duration")],
        F.coalesce("e.explicit", F.lit(False)).alias("explicit"), F.coalesce("e.categories", none).alias("categories"),
        text("e.transcript"), F.when(F.coalesce("e.audio_url", F.lit("")) != "", 1).otherwise(0).alias("enclosures"))
    errors = got.where(error.isNotNull()).select("feed_url", error.alias("error"), F.lit(0).cast("bigint").alias("bytes"))
    return FeedTables(podcasts, episodes, errors)


def _done_by(df: DataFrame, fn: Callable, key: Column, request: Column, wanted: Column, stage: str, o: RunOptions,
             row_fn: bool) -> DataFrame:
    """``df`` with ``_error`` of the stage's calls, one a key."""
    calls = call_once(df.where(wanted), fn, key, request, max_parallel=o.max_parallel, row_fn=row_fn, stage=stage)
    return (df.withColumn("call_key", F.when(wanted, call_key(key, request)))
            .join(calls.select("call_key", F.col("error").alias("_error")), "call_key", "left").drop("call_key"))


def run_feeds(feeds: DataFrame, stages: dict[str, Callable] | None = None, options: RunOptions | None = None, *,
              artifacts: DataFrame | None = None, skip_missing: bool = False, row_fn: bool = True,
              audio_dir: str = "audio") -> Run:
    """Process a table of (feed_url, xml). ``stages`` maps stage names to row
    functions (batch functions with ``row_fn=False``)."""
    stages, o, spark = dict(stages or {}), options or RunOptions(), feeds.sparkSession
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    store = M.MemoStore(spark, o.store)
    if artifacts is None and store.enabled:
        artifacts = store.load()
    book = _Stages(spark, o)
    eid = S.effective_id("id", "audio_url")
    none = F.lit(None).cast("string")

    # feed: a feed that cannot be read is an error of its own
    feeds = feeds.select("feed_url", "xml")
    tables = _called_feeds(feeds, stages["feed"], o.max_parallel, row_fn) if "feed" in stages else read_feeds(feeds, dialect="auto")
    read = tables.podcasts.select("feed_url", none.alias("error")).unionByName(tables.errors.select("feed_url", "error"))
    book.save("feed", read, F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")), F.col("error"), F.lit(""))

    # validate, then limit; what is rejected goes no further
    tagged = with_reject_reason(tables.episodes, o.policy)
    tagged = book.save("validate", tagged, F.when(F.col("reject_reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")),
                       F.col("reject_reason"), eid)
    eps = limit_per_feed(tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), o.limit)

    # download: only what has to be transcribed
    if "download" in stages:
        eps = eps.withColumn("_row", F.monotonically_increasing_id())
        eps = cut_lineage(eps)
        wanted = S.blank("transcript")
        if artifacts is not None:
            eps = M.memo_join(eps.withColumn("transcript_key", M.transcript_key("audio_url")), artifacts, "transcript_key", "_cached")
            wanted = wanted & F.col("_cached").isNull()
        dest = F.concat(F.lit(audio_dir.rstrip("/") + "/"), S.audio_name(eid))
        request = F.to_json(F.struct(F.col("audio_url").alias("url"), dest.alias("dest")))
        got = _done_by(eps, stages["download"], S.empty_to_null("audio_url"), request, wanted, "download", o, row_fn)
        got = book.save("download", got.drop("_cached", "transcript_key", "_row"),
                        F.when(F.col("_error").isNotNull(), F.lit("error")).otherwise(F.lit("ok")), F.col("_error"), eid)
        eps = got.where(F.col("_error").isNull()).drop("_error")

    # transcribe
    if "transcribe" in stages or not skip_missing:
        transcribed, new_t = transcribe(eps, stages.get("transcribe"), artifacts, o.max_parallel, row_fn)
    else:
        transcribed = eps.withColumn("transcript_key", M.transcript_key("audio_url")).withColumn(
            "transcript_status", F.when(S.blank("transcript"), F.lit("skipped")).otherwise(F.lit("given"))).withColumn("transcript_error", none)
        new_t = None
    transcribed = book.save("transcribe", transcribed, F.col("transcript_status"), F.col("transcript_error"), eid)
    ready = transcribed.where(F.col("transcript_status") != "error")

    # extract
    if "extract" in stages or not skip_missing:
        entries, new_e = extract(ready, stages.get("extract"), o.scheme, o.scheme_id, artifacts, o.max_parallel, o.model, row_fn)
    else:
        entries = ready.withColumns({"entry": none, "entry_status": F.lit("skipped"), "entry_error": none,
                                     "entry_key": none, "scheme_rejected": F.lit(False)})
        new_e = None
    entries = book.save("extract", entries, F.col("entry_status"), F.col("entry_error"), eid)

    # store
    outputs = K.raw_table(ready).select("name", "text", "episode_id", F.lit("raw").alias("kind"))
    good = entries.where(F.col("entry_status").isin("ok", "cache", "malformed"))
    if "store" in stages:
        rows = ready.select("feed_url", eid.alias("episode_id"), S.raw_name(eid).alias("name"),
                            S.raw_text("transcript", "title").alias("text")).unionByName(
            good.select("feed_url", eid.alias("episode_id"), S.structured_name(eid, F.lit(o.scheme_id)).alias("name"),
                        F.col("entry").alias("text")))
        request = F.to_json(F.struct("name", "text"))
        done = _done_by(rows, stages["store"], F.col("name"), request, F.lit(True), "store", o, row_fn).drop("text")
        book.save("store", done, F.when(F.col("_error").isNotNull(), F.lit("error")).otherwise(F.lit("ok")), F.col("_error"),
                  F.col("episode_id"))
    elif o.output_dir:
        K.append_batch(outputs.drop("kind"), f"{o.output_dir}/raw")
        K.write_structured(good, f"{o.output_dir}/structured", o.scheme_id)
        K.write_metadata(good, f"{o.output_dir}/metadata")

    fresh = [x for x in (new_t, new_e) if x is not None]
    new = fresh[0] if fresh else spark.createDataFrame([], "key string, kind string, value string, size_bytes bigint, last_used timestamp")
    for more in fresh[1:]:
        new = new.unionByName(more)
    if store.enabled:
        store.record_reads(
            transcribed.where(F.col("transcript_status") == "cache").select(F.col("transcript_key").alias("key"))
            .unionByName(entries.where(F.col("entry_status") == "cache").select(F.col("entry_key").alias("key"))))
        store.save(new)
    status = book.status()
    summary = spark.createDataFrame(book.counts, SUMMARY_DDL)             # one row a stage
    if o.on_status:
        o.on_status(status)
    if o.raise_on_error:
        R.raise_on_error(status)
    return Run(tables.podcasts, transcribed, entries, status, summary, new)


# -- one-to-many stages for SQL ------------------------------------------------------------------

class EntryPeople:
    """One row for every guest and every company of an entry."""

    def eval(self, entry: str):
        import json
        try:
            doc = json.loads(entry or "")
        except ValueError:
            return
        if not isinstance(doc, dict):
            return
        for kind, name in (("guest", "guests"), ("company", "companies")):
            items = doc.get(name)
            for i, x in enumerate(items if isinstance(items, list) else []):
                if isinstance(x, dict):
                    own = x.get("name")
                    yield kind, i, own if isinstance(own, str) else None


def register_table_stage(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Expose a one-to-many stage to SQL as a table function: ``SELECT ...
    FROM t, LATERAL name(t.column)``. ``handler.eval`` yields its rows."""
    from feedloom.session import ship_package
    ship_package(spark)
    spark.udtf.register(name, F.udtf(handler, returnType=returns, useArrow=True))


def register_entry_people(spark: SparkSession, name: str = "entry_people") -> None:
    register_table_stage(spark, name, EntryPeople, "kind string, pos int, name string")
