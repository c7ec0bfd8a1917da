"""Whole runs over feeds derived from ``documents``: five replaced stages and a
table function (D4, N4, R1-R6), stage counts with a limit (R5), a document
pipeline with two sinks (D1, D2, K6), output tables (K1, K5) and the inverse
of node properties (Q7)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from feedloom.functions import strings as S
from feedloom.operators import graph as G
from feedloom.plans.fixtures import feeds_from_documents
from feedloom.plans.flow import DocumentFlow, RunOptions, read_documents, row_transform
from feedloom.plans.q_feeds import DOC_FIELDS_SQL
from feedloom.plans.q_graph import EVENT_SQL, event_graph
from feedloom.plans.registry import register
from feedloom.plans.run import register_entry_people, run_feeds
from feedloom.session import scratch_path, table
from feedloom.sinks import artifacts as K


# --- deterministic stage functions ------------------------------------------------------

def read_rss(request: str) -> str:
    """A feed stage of one's own: the standard library's parser."""
    from xml.etree import ElementTree
    body = json.loads(request)
    channel = ElementTree.fromstring(body["xml"]).find("channel")

    def text(node, name):
        found = node.find(name)
        return "" if found is None else found.text or ""
    episodes = []
    for it in channel.findall("item"):
        sound = it.find("enclosure")
        episodes.append({"id": text(it, "guid"), "title": text(it, "title"), "audio_url": "" if sound is None else sound.get("url"),
                         "description": text(it, "description")})
    return json.dumps({"podcast": {"title": text(channel, "title")}, "episodes": episodes})


def fetch(request: str) -> str:
    body = json.loads(request)
    if body["url"].endswith("3.mp3"):
        raise ValueError("404")
    return body["dest"]


def listen(request: str) -> str:
    url = json.loads(request)["audio_url"]
    if url.endswith("7.mp3"):
        raise TimeoutError("timeout")
    return json.dumps({"transcript": "heard at " + url})


def ask(request: str) -> str:
    url = json.loads(request)["messages"][1]["content"].rsplit(" ", 1)[1]
    entry = {"guests": [{"name": url}], "companies": [{"name": url.split("/")[2]}, {"name": url.split("/")[3]}]}
    content = "no idea" if url.endswith("5.mp3") else "Found: " + json.dumps(entry)
    return json.dumps({"message": {"role": "assistant", "content": content}, "done": True})


def keep(request: str) -> str:
    if json.loads(request)["name"].endswith("9_raw.txt"):
        raise OSError("disk full")
    return "ok"


STAGES = {"feed": read_rss, "download": fetch, "transcribe": listen, "extract": ask, "store": keep}


def _feeds(spark, sf):
    return feeds_from_documents(table(spark, sf, "documents"))


RUN_SQL = f"""
{DOC_FIELDS_SQL.strip()},
v AS (SELECT * FROM episodes WHERE strict_reason IS NULL),
d AS (SELECT * FROM v WHERE audio_url NOT LIKE '%3.mp3'),
t AS (SELECT * FROM d WHERE audio_url NOT LIKE '%7.mp3'),
x AS (SELECT * FROM t WHERE audio_url NOT LIKE '%5.mp3')"""


@register("run_flow", f"""
WITH {RUN_SQL.strip()},
r AS (
  SELECT DISTINCT 'feed' AS stage, feed_url AS one, broken AS bad, 'invalid feed' AS class FROM doc_fields
  UNION ALL SELECT 'validate', id, strict_reason IS NOT NULL, NULL FROM episodes
  UNION ALL SELECT 'download', id, audio_url LIKE '%3.mp3', 'download' FROM v
  UNION ALL SELECT 'transcribe', id, audio_url LIKE '%7.mp3', 'transcription timeout' FROM d
  UNION ALL SELECT 'extract', id, audio_url LIKE '%5.mp3', 'extraction' FROM t
  UNION ALL SELECT 'store', id, id LIKE '%9', 'storage' FROM t
  UNION ALL SELECT 'store', id, false, NULL FROM x)
SELECT stage, CASE WHEN NOT bad THEN 'ok' WHEN stage = 'validate' THEN 'rejected' ELSE 'error' END AS status,
       CASE WHEN bad THEN class END AS error_class, CAST(count(*) AS BIGINT) AS n
FROM r GROUP BY ALL""")
def run_flow(spark, sf):
    """All five stages replaced; every error class has rows."""
    run = run_feeds(_feeds(spark, sf), STAGES)
    return run.status.groupBy("stage", "status", "error_class").agg(F.count(F.lit(1)).alias("n"))


@register("stage_replacement", f"""
WITH {RUN_SQL.strip()}
SELECT id AS episode_id, 'guest' AS kind, 0 AS pos, audio_url AS name FROM x
UNION ALL SELECT id, 'company', 0, split_part(audio_url, '/', 3) FROM x
UNION ALL SELECT id, 'company', 1, split_part(audio_url, '/', 4) FROM x""")
def stage_replacement(spark, sf):
    """What the replaced stages found, taken apart by a table function in SQL."""
    run = run_feeds(_feeds(spark, sf), STAGES)
    register_entry_people(spark)
    return spark.sql("SELECT e.id AS episode_id, p.kind, p.pos, p.name FROM {entries} e, LATERAL entry_people(e.entry) p",
                     entries=run.entries.where("entry_status = 'ok'").select("id", "entry"))


@register("run_stage_counts", f"""
WITH {DOC_FIELDS_SQL.strip()},
v AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY position) AS rn FROM episodes WHERE strict_reason IS NULL),
t AS (SELECT * FROM v WHERE rn <= 2),
r AS (
  SELECT DISTINCT 'feed' AS stage, feed_url AS one, broken AS bad FROM doc_fields
  UNION ALL SELECT 'validate', id, strict_reason IS NOT NULL FROM episodes
  UNION ALL SELECT 'transcribe', id, audio_url LIKE '%7.mp3' FROM t
  UNION ALL SELECT 'extract', id, false FROM t WHERE audio_url NOT LIKE '%7.mp3')
SELECT stage, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT bad) AS BIGINT) AS n_ok,
       CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_error, 2 AS "limit", true AS timed
FROM r GROUP BY stage""")
def run_stage_counts(spark, sf):
    """Counts by the jobs that save the stages, with the limit of the run;
    the extraction stage is missing and passed over."""
    run = run_feeds(_feeds(spark, sf), {"transcribe": listen}, RunOptions(limit=2), skip_missing=True)
    return run.summary.select("stage", "n", "n_ok", "n_error", "limit", (F.col("seconds") >= 0).alias("timed"))


def _counted(doc: dict) -> dict:
    doc["n_lines"] = (doc["content"] or "").count("\n") + 1
    return doc


@register("document_run", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
r AS (SELECT id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM d)
SELECT 'sizes' AS sink, id, n_bytes, NULL::INTEGER AS n_lines FROM r
UNION ALL SELECT 'lines', id, NULL, n_lines FROM r""")
def document_run(spark, sf):
    """Transforms in order, then both sinks read the saved result."""
    docs = read_documents(table(spark, sf, "documents"), id="doc_id", content="text", source_id="source")
    path = scratch_path(spark, "document-run")
    schema = "id string, source_id string, metadata map<string,string>, content string, n_lines int"
    flow = DocumentFlow(docs, [lambda df: df.withColumn("content", S.trim_ws("content")), row_transform(_counted, schema)], [
        lambda df: K.append_batch(df.select("id", F.octet_length("content").cast("bigint").alias("n_bytes")), f"{path}/sizes"),
        lambda df: K.append_batch(df.select("id", "n_lines"), f"{path}/lines")])
    flow.run(spark, max_parallel=8)
    sizes, lines = (K.read_batches(spark, f"{path}/{name}") for name in ("sizes", "lines"))
    return (sizes.select(F.lit("sizes").alias("sink"), "id", "n_bytes", F.lit(None).cast("int").alias("n_lines"))
            .unionByName(lines.select(F.lit("lines").alias("sink"), "id", F.lit(None).cast("bigint").alias("n_bytes"), "n_lines")))


@register("artifact_tables", """
SELECT 'ep_' || CAST(doc_id AS VARCHAR) || '_raw.txt' AS name,
  CASE WHEN doc_id % 3 = 0 THEN 'second: ' || source ELSE '# T' || chr(10) || chr(10) || '(no transcript)' || chr(10) END AS text
FROM documents""")
def artifact_tables(spark, sf):
    """K1, K5: raw outputs overwrite by batch; a batch that was not committed
    is not there."""
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.concat(F.lit("ep-"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("audio_url"),
                    F.lit("T").alias("title"), F.lit("").alias("transcript"), "source")
    path = scratch_path(spark, "raw")
    K.write_raw(rows.drop("source"), path)
    again = rows.where(F.col("doc_id") % 3 == 0).withColumn("transcript", F.concat(F.lit("second: "), F.col("source")))
    K.write_raw(again.drop("source"), path)
    (again.limit(1).select(F.lit("lost").alias("name"), F.lit("").alias("episode_id"), F.lit("").alias("text"))
     .write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=7"))
    return K.read_raw(spark, path).select("name", "text")


@register("graph_properties_inverse", f"""
WITH {EVENT_SQL.strip()}
SELECT id, label, k, hr AS hour, CAST(CASE WHEN k IS NULL THEN 0 ELSE 2 END AS INTEGER) AS n_props FROM gnodes""")
def graph_properties_inverse(spark, sf):
    """Q7: the long form of the properties folded back onto the nodes."""
    nodes = event_graph(spark, sf).nodes
    back = G.nodes_from_properties(nodes.select("id", "label"), G.node_properties(nodes))
    return back.select("id", "label", F.col("properties")["k"].alias("k"), F.col("properties")["hour"].alias("hour"),
                       F.size("properties").alias("n_props"))
