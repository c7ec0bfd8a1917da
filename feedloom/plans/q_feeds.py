"""Feed queries: S1-S3, P1-P11, F1-F4 over feeds derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import normalize_pub_date, utc_wall_clock
from feedloom.functions.strings import effective_id, transcription_hint
from feedloom.operators.validate import download_plan, limit_per_feed, with_reject_reason
from feedloom.plans.fixtures import feeds_from_documents, mixed_feeds
from feedloom.plans.registry import register
from feedloom.session import table
from feedloom.sources.feeds import episodes, parse_feeds, read_feeds
from feedloom.sources.mixed import feed_rows, parse_mixed

# Oracle side of ``doc_item_fields``: the same rules in DuckDB SQL.
DOC_FIELDS_SQL = """
doc_fields AS (
  SELECT doc_id, text, lang, source, n_chars,
    doc_id // 100 AS block,
    'https://feeds.example.com/' || source || '/' || CAST(doc_id // 100 AS VARCHAR) || '.xml' AS feed_url,
    ((doc_id // 100) % 5 = 2 AND source IN ('src3', 'src7')) AS broken,
    CASE WHEN n_chars % 11 = 0 THEN '' ELSE upper(lang) || ' episode ' || CAST(doc_id AS VARCHAR) END AS title,
    CASE WHEN doc_id % 7 = 3 THEN '' ELSE 'ep-' || CAST(doc_id AS VARCHAR) END AS id,
    CASE WHEN n_chars % 13 = 0 THEN ''
         ELSE (CASE WHEN doc_id % 17 = 5 THEN 'ftp://files.example.com/' ELSE 'https://cdn.example.com/' END)
              || lang || '/' || CAST(doc_id AS VARCHAR) || '.mp3' END AS audio_url,
    CASE WHEN n_chars % 13 = 0 THEN 0 WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END AS enclosures,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT)) + to_minutes(CAST(n_chars % 60 AS BIGINT)) AS ts,
    CASE WHEN lang = 'en' THEN 'Narrator ' || source ELSE 'Writer ' || lang END AS author,
    CAST(n_chars // 60 AS VARCHAR) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS duration,
    (lang = 'de') AS explicit,
    lang || '|' || 'n' || CAST(n_chars // 1000 AS VARCHAR) AS categories,
    CAST(row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS BIGINT) AS position
  FROM documents
),
episodes AS (
  SELECT *,
    CASE doc_id % 3 WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000')
                    WHEN 1 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS pub_date,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at,
    CASE WHEN id = '' THEN 'missing episode ID'
         WHEN title = '' THEN 'missing episode title'
         WHEN audio_url = '' THEN 'missing audio URL for episode: ' || title END AS strict_reason,
    CASE WHEN title = '' THEN 'missing title' WHEN enclosures = 0 THEN 'missing enclosure' END AS lenient_reason
  FROM doc_fields WHERE NOT broken
)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _feed_tables(spark: SparkSession, sf: str, dialect: str = "rss"):
    return read_feeds(feeds_from_documents(_docs(spark, sf), dialect), dialect=dialect)


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _feed_tables(spark, sf).episodes


def _ts(c) -> F.Column:
    """An instant as UTC wall-clock text, whatever the session time zone."""
    return F.date_format(utc_wall_clock(c), "yyyy-MM-dd HH:mm:ss")


def duration_seconds(col: str = "duration") -> F.Column:
    """``h:mm:ss`` / ``m:ss`` / ``ss`` -> seconds (NULL when not numeric)."""
    parts = F.split(F.col(col), ":")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x.try_cast("bigint"))


# ---------------------------------------------------------------------------

@register("feed_podcasts", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT DISTINCT feed_url, 'Feed ' || source || ' #' || CAST(block AS VARCHAR) AS title,
  'Documents from ' || source AS description, feed_url AS url,
  CASE WHEN block % 2 = 0 THEN 'Host of ' || source ELSE 'Curator ' || CAST(block AS VARCHAR) END AS author,
  source || '|documents' AS categories
FROM doc_fields WHERE NOT broken
""")
def feed_podcasts(spark, sf):
    p = _feed_tables(spark, sf).podcasts
    return p.select("feed_url", "title", "description", "url", "author",
                    F.array_join("categories", "|").alias("categories"))


EPISODE_SQL_COLS = """feed_url, position, id, title, audio_url, pub_date, published_at,
  text AS description, author, duration, explicit, categories, CAST(enclosures AS INTEGER) AS enclosures"""


def _episode_cols(df: DataFrame) -> DataFrame:
    return df.select("feed_url", F.col("position").cast("bigint").alias("position"), "id", "title",
                     "audio_url", "pub_date", _ts("published_at").alias("published_at"),
                     "description", "author", "duration", "explicit",
                     F.array_join("categories", "|").alias("categories"), "enclosures")


@register("feed_episodes", f"WITH {DOC_FIELDS_SQL.strip()}\nSELECT {EPISODE_SQL_COLS} FROM episodes")
def feed_episodes(spark, sf):
    return _episode_cols(_episodes(spark, sf))


@register("feed_errors", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT DISTINCT feed_url, 'invalid feed XML' AS error FROM doc_fields WHERE broken
""")
def feed_errors_q(spark, sf):
    return _feed_tables(spark, sf).errors.select("feed_url", "error")


@register("feed_dialects", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT d.dialect, feed_url, position, id, title, audio_url, published_at, text AS description,
       enclosures > 0 AS has_enclosure
FROM episodes CROSS JOIN (VALUES ('rss'), ('atom'), ('json')) AS d(dialect)
""")
def feed_dialects(spark, sf):
    out = None
    for dialect in ("rss", "atom", "json"):
        e = _feed_tables(spark, sf, dialect).episodes.select(
            F.lit(dialect).alias("dialect"), "feed_url", F.col("position").cast("bigint").alias("position"),
            "id", "title", "audio_url", _ts("published_at").alias("published_at"), "description",
            (F.col("enclosures") > 0).alias("has_enclosure"))
        out = e if out is None else out.unionByName(e)
    return out


@register("feed_mixed", f"""
WITH {DOC_FIELDS_SQL.strip()},
m AS (SELECT *, ['rss', 'atom', 'json', 'rdf'][block % 4 + 1] AS dialect FROM doc_fields),
p AS (SELECT DISTINCT feed_url, source, block, broken, dialect FROM m)
SELECT feed_url, CASE WHEN broken AND dialect = 'json' THEN NULL ELSE dialect END AS dialect,
  CASE WHEN broken THEN 'error' ELSE 'podcast' END AS kind, CAST(NULL AS BIGINT) AS position, '' AS id,
  CASE WHEN broken THEN '' ELSE 'Feed ' || source || ' #' || CAST(block AS VARCHAR) END AS title, '' AS audio_url,
  CASE WHEN broken THEN '' ELSE 'Documents from ' || source END AS description,
  CASE WHEN broken THEN CASE WHEN dialect = 'json' THEN 'unknown feed type' ELSE 'invalid feed XML' END END AS error
FROM p
UNION ALL
SELECT feed_url, dialect, 'episode' AS kind, position, id, title, audio_url, text AS description, CAST(NULL AS VARCHAR) AS error
FROM m WHERE NOT broken""")
def feed_mixed(spark, sf):
    """S3: one table with feeds of every dialect, each parsed once; podcasts,
    episodes and errors come out of the same pass."""
    return feed_rows(parse_mixed(mixed_feeds(_docs(spark, sf))))


@register("feed_catalog", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT feed_url, 'Feed ' || any_value(source) || ' #' || CAST(any_value(block) AS VARCHAR) AS title,
  CAST(count(*) AS BIGINT) AS n_items,
  CAST(count(*) FILTER (WHERE strict_reason IS NULL) AS BIGINT) AS n_valid,
  CAST(count(*) FILTER (WHERE strict_reason IS NOT NULL) AS BIGINT) AS n_rejected,
  CAST(sum(n_chars) FILTER (WHERE strict_reason IS NULL) AS BIGINT) AS valid_seconds,
  CAST(count(*) FILTER (WHERE explicit) AS BIGINT) AS n_explicit
FROM episodes GROUP BY feed_url
""")
def feed_catalog(spark, sf):
    """Flagship: feed -> parse -> validate -> per-podcast catalogue, from a
    single parse (the podcast title travels with its items)."""
    parsed = parse_feeds(feeds_from_documents(_docs(spark, sf)))
    tagged = with_reject_reason(episodes(parsed, podcast_title=True), "strict")
    valid = F.col("reject_reason").isNull()
    agg = tagged.groupBy("feed_url").agg(
        F.first("podcast_title").alias("title"),
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(valid, 1)).alias("n_valid"),
        F.count(F.when(~valid, 1)).alias("n_rejected"),
        F.sum(F.when(valid, duration_seconds())).alias("valid_seconds"),
        F.count(F.when(F.col("explicit"), 1)).alias("n_explicit"))
    return agg.select("feed_url", "title", *[F.col(c).cast("bigint") for c in
                                             ("n_items", "n_valid", "n_rejected", "valid_seconds", "n_explicit")])


@register("episodes_strict", f"WITH {DOC_FIELDS_SQL.strip()}\nSELECT {EPISODE_SQL_COLS} FROM episodes WHERE strict_reason IS NULL")
def episodes_strict(spark, sf):
    t = with_reject_reason(_episodes(spark, sf), "strict")
    return _episode_cols(t.where(F.col("reject_reason").isNull()))


@register("episodes_lenient", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT feed_url, position, CASE WHEN id = '' THEN audio_url ELSE id END AS id, title, audio_url,
  pub_date, published_at, text AS description, author, duration, explicit, categories,
  CAST(enclosures AS INTEGER) AS enclosures
FROM episodes WHERE lenient_reason IS NULL""")
def episodes_lenient(spark, sf):
    t = with_reject_reason(_episodes(spark, sf), "lenient")
    return _episode_cols(t.where(F.col("reject_reason").isNull()))


@register("episodes_rejected", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT 'strict' AS policy, regexp_replace(strict_reason, ': .*$', '') AS reason,
       CAST(count(*) AS BIGINT) AS n
FROM episodes WHERE strict_reason IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'lenient' AS policy, lenient_reason AS reason, CAST(count(*) AS BIGINT) AS n
FROM episodes WHERE lenient_reason IS NOT NULL GROUP BY ALL""")
def episodes_rejected(spark, sf):
    """Both policies tagged on one pass over the parsed feeds."""
    e = with_reject_reason(_episodes(spark, sf), "strict").withColumnRenamed("reject_reason", "strict_reason")
    e = with_reject_reason(e, "lenient")
    pairs = F.array(F.struct(F.lit("strict").alias("policy"), F.col("strict_reason").alias("reason")),
                    F.struct(F.lit("lenient").alias("policy"), F.col("reject_reason").alias("reason")))
    tagged = e.select(F.inline(pairs)).where(F.col("reason").isNotNull())
    return (tagged.groupBy("policy", F.regexp_replace("reason", ": .*$", "").alias("reason"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("episodes_limit", f"""
WITH {DOC_FIELDS_SQL.strip()},
v AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY position) AS rn
      FROM episodes WHERE strict_reason IS NULL)
SELECT feed_url, position, id, audio_url FROM v WHERE rn <= 3""")
def episodes_limit(spark, sf):
    t = with_reject_reason(_episodes(spark, sf), "strict").where(F.col("reject_reason").isNull())
    return limit_per_feed(t, 3).select("feed_url", F.col("position").cast("bigint").alias("position"),
                                       "id", "audio_url")


@register("episode_pub_dates", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT feed_url, position, pub_date AS raw, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date,
       published_at
FROM episodes""")
def episode_pub_dates(spark, sf):
    e = _episodes(spark, sf)
    return e.select("feed_url", F.col("position").cast("bigint").alias("position"),
                    F.col("pub_date").alias("raw"), normalize_pub_date("pub_date").alias("pub_date"),
                    _ts("published_at").alias("published_at"))


@register("transcription_hints", f"""
WITH {DOC_FIELDS_SQL.strip()}
SELECT feed_url, position,
  CASE WHEN title <> '' AND text <> '' THEN title || chr(10) || chr(10) || text
       WHEN title <> '' THEN title ELSE text END AS hint,
  CASE WHEN id = '' THEN audio_url ELSE id END AS effective_id
FROM episodes""")
def transcription_hints(spark, sf):
    e = _episodes(spark, sf)
    return e.select("feed_url", F.col("position").cast("bigint").alias("position"),
                    transcription_hint("title", "description").alias("hint"),
                    effective_id("id", "audio_url").alias("effective_id"))


@register("download_plan", f"""
WITH {DOC_FIELDS_SQL.strip()},
p AS (SELECT CASE WHEN id = '' THEN audio_url ELSE id END AS eid, audio_url FROM episodes)
SELECT eid AS id, audio_url AS url,
  '/data/audio/' || CASE WHEN eid = '' THEN 'unknown' ELSE regexp_replace(eid, '[^A-Za-z0-9]', '_', 'g') END || '.mp3' AS dest,
  CASE WHEN audio_url = '' THEN 'url required' WHEN NOT starts_with(audio_url, 'http') THEN 'url must be http(s)' END AS reason
FROM p""")
def download_plan_q(spark, sf):
    return download_plan(_episodes(spark, sf), "/data/audio")


# Layout of an event's time by its number: (Spark pattern, DuckDB format); both give whole seconds in UTC.
_LAYOUTS = (
    ("EEE, dd MMM yyyy HH:mm:ss '+0000'", "%a, %d %b %Y %H:%M:%S +0000"), ("d MMM yyyy HH:mm:ss 'GMT'", "%-d %b %Y %H:%M:%S GMT"),
    ("EEEE, dd-MMM-yy HH:mm:ss 'UTC'", "%A, %d-%b-%y %H:%M:%S UTC"), ("EEE MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y"),
    ("d MMMM yyyy HH:mm:ss", "%-d %B %Y %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss'.250+00:00'", "%Y-%m-%dT%H:%M:%S.250+00:00"),
    ("'on 'yyyy", "on %Y"))
_LAYOUT_SQL = " ".join(f"WHEN {i} THEN strftime(ts, '{fmt}')" for i, (_, fmt) in enumerate(_LAYOUTS))


@register("pub_date_layouts", f"""
WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, CAST(event_id % {len(_LAYOUTS)} AS INTEGER) AS layout FROM events),
r AS (SELECT *, CASE layout {_LAYOUT_SQL} END AS raw FROM e)
SELECT event_id, raw, CASE WHEN layout = {len(_LAYOUTS) - 1} THEN raw ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END AS pub_date
FROM r""")
def pub_date_layouts(spark, sf):
    """Event times printed in the layouts that feeds use, read back; the
    last is none and stays as it is."""
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    raw = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(_LAYOUTS):
        raw = F.when(F.col("event_id") % len(_LAYOUTS) == i, F.date_format("ts", pattern)).otherwise(raw)
    e = e.select("event_id", raw.alias("raw"))
    return e.select("event_id", "raw", normalize_pub_date("raw").alias("pub_date"))
