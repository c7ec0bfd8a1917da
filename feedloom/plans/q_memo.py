"""Memo queries (M1-M8, F5, F7) over artifacts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.strings import artifact_key, slug
from feedloom.operators import memo as M
from feedloom.plans.fixtures import doc_item_fields
from feedloom.plans.q_feeds import DOC_FIELDS_SQL
from feedloom.plans.registry import register
from feedloom.session import table

T0 = "2024-01-01 00:00:00"
EVICT_BUDGET = 500_000
REFUSE_BUDGET = 16_384


def _eps(spark, sf):
    f = doc_item_fields(table(spark, sf, "documents"))
    url = F.when(F.col("has_enclosure"), F.col("audio_url")).otherwise(F.lit(""))
    return f.select("doc_id", "lang", "title", "text", "ts", url.alias("audio_url"),
                    F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.lit("")).alias("transcript")) \
        .withColumn("transcript_key", M.transcript_key("audio_url"))


def _cached(eps):
    """Transcripts already in the store: German and Spanish episodes with audio."""
    src = eps.where(F.col("lang").isin("de", "es") & (F.col("audio_url") != ""))
    src = src.withColumn("value", F.concat(F.lit("[cached] "), F.col("text")))
    return M.artifact_rows(src, "transcript_key", "transcript", "value", F.col("ts"))


MEMO_SQL = f"""
{DOC_FIELDS_SQL.strip()},
e AS (
  SELECT doc_id, lang, title, text, ts, audio_url,
    CASE WHEN lang = 'fr' THEN text ELSE '' END AS transcript,
    CASE WHEN audio_url = '' THEN NULL ELSE 'transcript-' || sha256(encode(audio_url) || '\\x00'::BLOB) END AS transcript_key
  FROM doc_fields
),
art AS (
  SELECT transcript_key AS key, '[cached] ' || text AS value FROM e WHERE lang IN ('de', 'es') AND audio_url <> ''
)"""


@register("memo_hits", f"""
WITH {MEMO_SQL.strip()}
SELECT doc_id, transcript_key, CAST(strlen(value) AS BIGINT) AS cached_bytes
FROM e JOIN art ON e.transcript_key = art.key""")
def memo_hits(spark, sf):
    eps = _eps(spark, sf)
    hits, _ = M.memo_lookup(eps, _cached(eps), "transcript_key")
    return hits.select("doc_id", "transcript_key", F.octet_length("value").cast("bigint").alias("cached_bytes"))


@register("memo_misses", f"""
WITH {MEMO_SQL.strip()}
SELECT doc_id, transcript_key FROM e
WHERE transcript = '' AND (transcript_key IS NULL OR transcript_key NOT IN (SELECT key FROM art))""")
def memo_misses(spark, sf):
    eps = _eps(spark, sf)
    return M.needs_transcription(eps, _cached(eps)).select("doc_id", "transcript_key")


@register("memo_outputs", f"""
WITH {MEMO_SQL.strip()}
SELECT doc_id, transcript, 'given' AS origin FROM e WHERE transcript <> ''
UNION ALL
SELECT doc_id, value AS transcript, 'cache' AS origin FROM e JOIN art ON e.transcript_key = art.key
WHERE transcript = ''
UNION ALL
SELECT doc_id, '[asr] ' || title AS transcript, 'computed' AS origin FROM e
WHERE transcript = '' AND (transcript_key IS NULL OR transcript_key NOT IN (SELECT key FROM art))""")
def memo_outputs(spark, sf):
    """M8: recalled rows flow to the outputs exactly like computed ones."""
    eps = _eps(spark, sf)
    given = eps.where(F.col("transcript") != "").select("doc_id", "transcript", F.lit("given").alias("origin"))
    empty = eps.where(F.col("transcript") == "")
    hits, misses = M.memo_lookup(empty, _cached(eps), "transcript_key")
    cached = hits.select("doc_id", F.col("value").alias("transcript"), F.lit("cache").alias("origin"))
    computed = misses.select("doc_id", F.concat(F.lit("[asr] "), F.col("title")).alias("transcript"),
                             F.lit("computed").alias("origin"))
    return given.unionByName(cached).unionByName(computed)


@register("memo_upsert", """
WITH a AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS key, props AS value, ts,
                  CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS src FROM events)
SELECT key, arg_max(value, (ts, src)) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used,
       CAST(strlen(arg_max(value, (ts, src))) AS BIGINT) AS size_bytes
FROM a GROUP BY key""")
def memo_upsert(spark, sf):
    ev = table(spark, sf, "events").withColumn("key", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    rows = ev.select("key", "event_type", F.lit("profile").alias("kind"), F.col("props").alias("value"),
                     F.octet_length("props").cast("bigint").alias("size_bytes"), F.col("ts").alias("last_used"))
    old = rows.where(F.col("event_type").isin("view", "click")).drop("event_type")
    new = rows.where(~F.col("event_type").isin("view", "click")).drop("event_type")
    out = M.memo_put(M.memo_put(None, old), new)
    return out.select("key", "value", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_used"),
                      "size_bytes")


def _doc_artifacts(spark, sf):
    d = table(spark, sf, "documents")
    lu = F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 97).cast("int"))
    return d.select("doc_id", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("key"),
                    F.lit("text").alias("kind"), F.col("text").alias("value"),
                    F.octet_length("text").cast("bigint").alias("size_bytes"), lu.alias("last_used"))


DOC_ART_SQL = f"""
a AS (SELECT doc_id, lang, 'doc-' || CAST(doc_id AS VARCHAR) AS key, CAST(strlen(text) AS BIGINT) AS size_bytes,
             TIMESTAMP '{T0}' + to_hours(CAST(doc_id % 97 AS BIGINT)) AS lu FROM documents)"""


@register("memo_evict", f"""
WITH {DOC_ART_SQL.strip()},
r AS (SELECT key, size_bytes,
        CASE WHEN lang = 'fr' THEN greatest(lu, TIMESTAMP '{T0}' + to_hours(200) + to_seconds(CAST(doc_id AS BIGINT)))
             ELSE lu END AS last_used FROM a),
c AS (SELECT *, sum(size_bytes) OVER (ORDER BY last_used DESC, key DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r)
SELECT key, size_bytes, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used FROM c WHERE cum <= {EVICT_BUDGET}""")
def memo_evict(spark, sf):
    """M4 + M5: reads refresh recency, then the byte budget evicts oldest first."""
    art = _doc_artifacts(spark, sf)
    log = art.where(F.col("lang") == "fr").select(
        "key", (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(200), F.lit(0),
                                                                 F.col("doc_id").cast("int"))).alias("accessed_at"))
    kept = M.memo_evict(M.memo_refresh(art.drop("doc_id", "lang"), log), EVICT_BUDGET)
    return kept.select("key", "size_bytes", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@register("memo_refused", f"""
WITH {DOC_ART_SQL.strip()},
c AS (SELECT key, sum(size_bytes) OVER (ORDER BY lu DESC, key DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM a WHERE size_bytes <= {REFUSE_BUDGET})
SELECT a.key, a.size_bytes,
  CASE WHEN a.size_bytes > {REFUSE_BUDGET} THEN 'refused' WHEN c.cum <= {REFUSE_BUDGET} THEN 'kept' ELSE 'evicted' END AS outcome
FROM a LEFT JOIN c ON a.key = c.key""")
def memo_refused(spark, sf):
    """M6: a value over the whole budget is refused; eviction still runs."""
    art = _doc_artifacts(spark, sf).drop("doc_id", "lang")
    kept, refused = M.memo_put_bounded(None, art, REFUSE_BUDGET)
    tag = (art.select("key", "size_bytes")
           .join(kept.select("key", F.lit(True).alias("_kept")), "key", "left")
           .join(refused.select("key", F.lit(True).alias("_refused")), "key", "left"))
    return tag.select("key", "size_bytes",
                      F.when(F.col("_refused"), F.lit("refused")).when(F.col("_kept"), F.lit("kept"))
                      .otherwise(F.lit("evicted")).alias("outcome"))


@register("memo_refused_keys", f"""
WITH a AS (
  SELECT CASE WHEN doc_id % 9 = 4 THEN '.doc-' || CAST(doc_id AS VARCHAR) WHEN doc_id % 9 = 5 THEN ''
              WHEN doc_id % 9 = 6 THEN 'doc/' || CAST(doc_id AS VARCHAR) ELSE 'doc-' || CAST(doc_id AS VARCHAR) END AS key,
         doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents)
SELECT doc_id, key, size_bytes, CASE doc_id % 9 WHEN 4 THEN 'starts with a dot' WHEN 5 THEN 'empty' WHEN 6 THEN 'invalid character'
         ELSE 'larger than the store' END AS reason
FROM a WHERE doc_id % 9 IN (4, 5, 6) OR size_bytes > {REFUSE_BUDGET}""")
def memo_refused_keys(spark, sf):
    """What a put does not take comes back with its reason."""
    art = _doc_artifacts(spark, sf)
    i = F.col("doc_id") % 9
    key = (F.when(i == 4, F.concat(F.lit("."), F.col("key"))).when(i == 5, F.lit(""))
           .when(i == 6, F.replace("key", F.lit("-"), F.lit("/"))).otherwise(F.col("key")))
    _, refused = M.memo_put_bounded(None, art.withColumn("key", key), REFUSE_BUDGET)
    return refused.select("doc_id", "key", "size_bytes", "reason")


@register("memo_keys", """
WITH s AS (SELECT page_id, url, CASE WHEN url = '' THEN 'unknown'
                  ELSE regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') END AS sl FROM pages),
k AS (
  SELECT page_id, 'url' AS kind, url AS k FROM s
  UNION ALL SELECT page_id, 'slug', sl FROM s
  UNION ALL SELECT page_id, 'hidden', '.' || sl FROM s
  UNION ALL SELECT page_id, 'long', repeat(sl, 5) FROM s
  UNION ALL SELECT page_id, 'empty', '' FROM s
  UNION ALL SELECT page_id, 'keyed', 'transcript-' || sha256(encode(url) || '\\x00'::BLOB) FROM s
)
SELECT page_id, kind, CASE WHEN k = '' THEN 'empty' WHEN strlen(k) > 200 THEN 'longer than 200 bytes'
  WHEN starts_with(k, '.') THEN 'starts with a dot'
  WHEN NOT regexp_full_match(k, '[A-Za-z0-9._-]+') THEN 'invalid character' END AS reason
FROM k""")
def memo_keys(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", slug("url").alias("sl"))
    kinds = [("url", F.col("url")), ("slug", F.col("sl")), ("hidden", F.concat(F.lit("."), F.col("sl"))),
             ("long", F.repeat(F.col("sl"), 5)), ("empty", F.lit("")),
             ("keyed", artifact_key("transcript", "url"))]
    out = None
    for name, k in kinds:
        part = p.select("page_id", F.lit(name).alias("kind"), M.key_reason(k).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out
