"""Scalar function queries: names, keys, byte cut, request texts
and JSON handling (J1-J8) over inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import jsonfn as J
from feedloom.functions import strings as S
from feedloom.plans.q_feeds import DOC_FIELDS_SQL, _episodes
from feedloom.plans.registry import register
from feedloom.session import table

SCHEME_SQL = J.DEFAULT_SCHEME.replace("'", "''")


# --- names and keys -------------------------------------------------------------

@register("slugs", """
SELECT doc_id,
  regexp_replace(text, '[^A-Za-z0-9]', '_', 'g') AS text_slug,
  CASE WHEN doc_id % 10 = 0 THEN 'unknown'
       ELSE regexp_replace(lang || '/' || source, '[^A-Za-z0-9]', '_', 'g') END AS tag_slug
FROM documents""")
def slugs(spark, sf):
    d = table(spark, sf, "documents")
    tag = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.concat_ws("/", "lang", "source"))
    return d.select("doc_id", S.slug("text").alias("text_slug"), S.slug(tag).alias("tag_slug"))


_PAGE_ID_SQL = "CASE WHEN page_id % 10 = 0 THEN '' ELSE url END"


def _page_id():
    return F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.col("url"))


@register("artifact_names", f"""
WITH p AS (SELECT page_id, {_PAGE_ID_SQL} AS id FROM pages),
s AS (SELECT page_id, id, CASE WHEN id = '' THEN 'unknown'
             ELSE regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') END AS slug FROM p)
SELECT page_id, id, slug || '_raw.txt' AS raw_name, slug || '_meta.json' AS meta_name,
  slug || '.mp3' AS audio_name, slug || '_entry.json' AS structured_name,
  slug || '_guests.v2.json' AS structured_v2_name
FROM s""")
def artifact_names(spark, sf):
    p = table(spark, sf, "pages").select("page_id", _page_id().alias("id"))
    return p.select("page_id", "id", S.raw_name("id").alias("raw_name"),
                    S.meta_name("id").alias("meta_name"), S.audio_name("id").alias("audio_name"),
                    S.structured_name("id", F.lit("entry")).alias("structured_name"),
                    S.structured_name("id", F.lit("guests.v2")).alias("structured_v2_name"))


@register("artifact_keys", f"""
WITH p AS (SELECT page_id, {_PAGE_ID_SQL} AS url FROM pages)
SELECT page_id,
  CASE WHEN url = '' THEN NULL ELSE 'transcript-' || sha256(encode(url) || '\\x00'::BLOB) END AS transcript_key,
  CASE WHEN url = '' THEN NULL ELSE 'entry-' || sha256(encode(url) || '\\x00'::BLOB || encode('entry')
       || '\\x00'::BLOB || encode('{SCHEME_SQL}') || '\\x00'::BLOB) END AS entry_key
FROM p""")
def artifact_keys(spark, sf):
    p = table(spark, sf, "pages").select("page_id", _page_id().alias("url"))
    return p.select("page_id", S.artifact_key("transcript", "url").alias("transcript_key"),
                    S.artifact_key("entry", "url", F.lit("entry"), F.lit(J.DEFAULT_SCHEME)).alias("entry_key"))


# --- content, prompts and request bodies -------------------------------------------

_TRANSCRIPT_SQL = "CASE WHEN lang = 'en' THEN source || ': ' || text ELSE '' END"


def _transcript():
    return F.when(F.col("lang") == "en", F.concat(F.col("source"), F.lit(": "), F.col("text"))).otherwise(F.lit(""))


CUT_SQL = """
cut AS (
  SELECT *, encode(src) AS b, octet_length(encode(src)) AS nb FROM base
),
cut2 AS (
  SELECT *, CASE WHEN nb <= 4000 THEN 0
      WHEN NOT (b[4001:4001] >= '\\x80'::BLOB AND b[4001:4001] <= '\\xBF'::BLOB) THEN 0
      WHEN NOT (b[4000:4000] >= '\\x80'::BLOB AND b[4000:4000] <= '\\xBF'::BLOB) THEN 1
      WHEN NOT (b[3999:3999] >= '\\x80'::BLOB AND b[3999:3999] <= '\\xBF'::BLOB) THEN 2
      ELSE 3 END AS dangling FROM cut
),
content AS (
  SELECT *, CASE WHEN nb <= 4000 THEN src
    ELSE decode(b[1:4000 - dangling]) || repeat(chr(65533), dangling) || '...' END AS content FROM cut2
)"""


@register("extraction_content", f"""
WITH base AS (
  SELECT doc_id, lang, source, text,
    CASE WHEN ({_TRANSCRIPT_SQL}) <> '' THEN ({_TRANSCRIPT_SQL}) ELSE text END AS src FROM documents
), {CUT_SQL.strip()}
SELECT doc_id, content, nb > 4000 AS truncated, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes
FROM content""")
def extraction_content(spark, sf):
    d = table(spark, sf, "documents")
    c = S.extraction_content(_transcript(), F.col("text"))
    src = F.coalesce(S.empty_to_null(_transcript()), F.col("text"))
    return d.select("doc_id", c.alias("content"), (F.octet_length(src) > 4000).alias("truncated"),
                    F.octet_length(c).cast("bigint").alias("n_bytes"))


@register("extraction_prompts", f"""
WITH base AS (
  SELECT doc_id, lang, source, text,
    CASE WHEN ({_TRANSCRIPT_SQL}) <> '' THEN ({_TRANSCRIPT_SQL}) ELSE text END AS src FROM documents
), {CUT_SQL.strip()}
SELECT doc_id, 'Extract data from this podcast episode.' || chr(10) || chr(10) || 'Schema:' || chr(10)
  || '{SCHEME_SQL}' || chr(10) || chr(10) || 'Title: ' || upper(lang) || ' #' || CAST(doc_id AS VARCHAR)
  || chr(10) || 'Content: ' || content AS prompt
FROM content""")
def extraction_prompts(spark, sf):
    d = table(spark, sf, "documents")
    title = F.concat(F.upper("lang"), F.lit(" #"), F.col("doc_id").cast("string"))
    content = S.extraction_content(_transcript(), F.col("text"))
    scheme = J.resolve_scheme(F.lit(None).cast("string"))["scheme"]
    return d.select("doc_id", S.extraction_prompt(title, content, scheme).alias("prompt"))


@register("chat_requests", f"""
WITH base AS (
  SELECT doc_id, lang, source, text,
    CASE WHEN ({_TRANSCRIPT_SQL}) <> '' THEN ({_TRANSCRIPT_SQL}) ELSE text END AS src FROM documents
), {CUT_SQL.strip()}
SELECT doc_id, to_json({{'model': '{S.DEFAULT_MODEL}', 'messages': [
    {{'role': 'system', 'content': '{S.SYSTEM_PROMPT}'}},
    {{'role': 'user', 'content': 'Title: ' || upper(lang) || chr(10) || 'Content: ' || content}}],
  'stream': false}}) AS body
FROM content""")
def chat_requests(spark, sf):
    d = table(spark, sf, "documents")
    content = S.extraction_content(_transcript(), F.col("text"))
    prompt = F.concat(F.lit("Title: "), F.upper("lang"), F.lit("\nContent: "), content)
    return d.select("doc_id", S.chat_request(prompt).alias("body"))


@register("transcribe_requests", f"""
WITH {DOC_FIELDS_SQL.strip()},
h AS (SELECT feed_url, position, audio_url,
  CASE WHEN title <> '' AND text <> '' THEN title || chr(10) || chr(10) || text
       WHEN title <> '' THEN title ELSE text END AS hint FROM episodes)
SELECT feed_url, position,
  CASE WHEN hint = '' THEN to_json({{'audio_url': audio_url}})
       ELSE to_json({{'audio_url': audio_url, 'initial_prompt': hint}}) END AS body
FROM h""")
def transcribe_requests(spark, sf):
    e = _episodes(spark, sf)
    hint = S.transcription_hint("title", "description")
    return e.select("feed_url", F.col("position").cast("bigint").alias("position"),
                    S.transcribe_request("audio_url", hint).alias("body"))


@register("raw_outputs", """
WITH r AS (SELECT doc_id, 'ep-' || CAST(doc_id AS VARCHAR) AS id, upper(lang) || ' #' || CAST(doc_id AS VARCHAR) AS title,
           CASE WHEN n_chars % 4 = 0 THEN '' ELSE text END AS transcript FROM documents)
SELECT regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') || '_raw.txt' AS name, id AS episode_id,
  CASE WHEN transcript = '' THEN '# ' || title || chr(10) || chr(10) || '(no transcript)' || chr(10)
       ELSE transcript END AS text
FROM r""")
def raw_outputs(spark, sf):
    from feedloom.sinks.artifacts import raw_table
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("ep-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.upper("lang"), F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("n_chars") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("transcript"),
        F.lit("").alias("audio_url"))
    return raw_table(d).select("name", "episode_id", "text")


# --- JSON -------------------------------------------------------------------------

def _scheme_input():
    e = F.col("event_type")
    props = F.col("props")
    return (F.when(F.col("event_id") % 50 == 0, F.lit(""))
            .when(e == "view", props)
            .when(e == "click", F.concat(F.lit("  "), props, F.lit("\n")))
            .when(e == "signup", F.lit("null"))
            .when(e == "error", F.concat(F.lit('"'), F.base64(F.encode(props, "UTF-8")), F.lit('"')))
            .otherwise(props.substr(F.lit(1), F.length(props) - 1)))


@register("scheme_resolution", f"""
SELECT event_id,
  CASE WHEN event_id % 50 = 0 OR event_type IN ('signup', 'error', 'purchase') THEN '{SCHEME_SQL}'
       ELSE props END AS scheme,
  (event_id % 50 <> 0 AND event_type IN ('error', 'purchase')) AS rejected
FROM events""")
def scheme_resolution(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _scheme_input().alias("raw"))
    r = J.resolve_scheme("raw")
    return ev.select("event_id", r["scheme"].alias("scheme"), r["rejected"].alias("rejected"))


def _completion():
    """Replies in four shapes: preamble + object, fenced object, no JSON,
    an invalid slice between braces."""
    obj = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")))
    bad = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(", text: "), F.col("text"), F.lit("}"))
    return (F.when(F.col("turn") % 5 == 4, bad)
            .when(F.col("role") == "assistant", F.concat(F.lit("Here you go: "), obj, F.lit(" Done.")))
            .when(F.col("role") == "user", F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .otherwise(F.col("text")))


COMPLETION_SQL = """
c AS (
  SELECT conv_id, turn, role, text,
    CAST(to_json({'turn': turn, 'text': text}) AS VARCHAR) AS obj,
    '{"turn": ' || CAST(turn AS VARCHAR) || ', text: ' || text || '}' AS bad
  FROM conversations
),
k AS (
  SELECT *, CASE WHEN turn % 5 = 4 THEN 'malformed' WHEN role IN ('assistant', 'user') THEN 'ok'
                 ELSE 'error' END AS status,
    CASE WHEN turn % 5 = 4 THEN bad WHEN role = 'assistant' THEN 'Here you go: ' || obj || ' Done.'
         WHEN role = 'user' THEN '```json' || chr(10) || obj || chr(10) || '```' ELSE text END AS completion,
    CASE WHEN turn % 5 = 4 THEN bad WHEN role IN ('assistant', 'user') THEN obj END AS json
  FROM c
)"""


@register("completion_parse", f"""
WITH {COMPLETION_SQL.strip()}
SELECT conv_id, turn, json, CASE WHEN json IS NULL THEN 'no JSON in completion' END AS error FROM k""")
def completion_parse(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", _completion().alias("completion"))
    p = J.parse_completion("completion")
    return c.select("conv_id", "turn", p["json"].alias("json"), p["error"].alias("error"))


@register("completion_merge", f"""
WITH {COMPLETION_SQL.strip()}
SELECT conv_id, turn, status,
  CASE status WHEN 'ok' THEN obj WHEN 'malformed' THEN '{{"data":null}}'
       ELSE to_json({{'error': 'no JSON in completion', 'raw_completion': completion}}) END AS entry
FROM k""")
def completion_merge(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", _completion().alias("completion"))
    m = J.merge_response("completion")
    return c.select("conv_id", "turn", m["status"].alias("status"), m["entry"].alias("entry"))


def _asr_reply():
    t = F.col("turn") % 6
    return (F.when(F.col("role") == "system", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
            .when(t == 0, F.to_json(F.struct(F.col("text").alias("transcript"))))
            .when(t == 1, F.col("text"))
            .when(t == 2, F.lit('{"other": 1}'))
            .when(t == 3, F.lit('{"transcript": null}'))
            .when(t == 4, F.lit("null"))
            .otherwise(F.concat(F.lit('{"transcript": '), F.col("turn").cast("string"), F.lit("}"))))


@register("asr_replies", """
SELECT conv_id, turn,
  CASE WHEN role = 'system' THEN '[' || CAST(turn AS VARCHAR) || ']'
       WHEN turn % 6 IN (0, 1) THEN text
       WHEN turn % 6 IN (2, 3, 4) THEN ''
       ELSE '{"transcript": ' || CAST(turn AS VARCHAR) || '}' END AS transcript
FROM conversations""")
def asr_replies(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", _asr_reply().alias("reply"))
    return c.select("conv_id", "turn", J.parse_asr_response("reply").alias("transcript"))


@register("transcript_json", """
SELECT conv_id, turn, to_json({'transcript': text}) AS json FROM conversations""")
def transcript_json(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", J.format_transcript("text").alias("json"))


@register("chat_replies", """
SELECT conv_id, turn, text AS content FROM conversations""")
def chat_replies(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("message"),
                              F.lit(True).alias("done")))
    return c.select("conv_id", "turn", J.chat_reply(body).alias("content"))


@register("store_request_kinds", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'structured' WHEN 'click' THEN 'raw' ELSE 'error' END AS kind
FROM events""")
def store_request_kinds(spark, sf):
    e = F.col("event_type")
    req = (F.when(e == "view", F.concat(F.lit('{"episode": {"id": "'), F.col("event_id").cast("string"),
                                        F.lit('"}, "entry": '), F.col("props"), F.lit("}")))
           .when(e == "click", F.concat(F.lit('{"episode": {"id": "'), F.col("event_id").cast("string"), F.lit('"}}')))
           .when(e == "error", F.lit('{"other": 1}'))
           .when(e == "signup", F.lit("not json"))
           .otherwise(F.lit("[1]")))
    ev = table(spark, sf, "events").select("event_id", req.alias("req"))
    return ev.select("event_id", J.store_request_kind("req").alias("kind"))
