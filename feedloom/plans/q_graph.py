"""Graph queries (G1-G9, Q1-Q8, F6) over graphs derived from the driver
tables: suppliers and parts linked by ``lineitem``; users linked by
``events``; nations and regions as document encyclopedias."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import graph as G
from feedloom.plans.registry import register
from feedloom.session import table

BFS_START = "s1"


def lineitem_graph(spark, sf, with_ids: bool = False) -> G.Graph:
    """Suppliers and parts linked by order lines. Lines have no unique key,
    so edge ids (when asked for) are dense ranks in a total order of the
    edge columns; identical lines are interchangeable."""
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("label"),
        F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("properties"))
    p = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("label"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("properties"))
    e = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("label"))
    if with_ids:
        order = [F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "src", "dst", "label")]
        e = G.append_edges(None, e, order)
    return G.Graph(s.unionByName(p), e.drop("l_orderkey", "l_linenumber"))


LINEITEM_GRAPH_SQL = """
nodes AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS label, 2 AS n_props FROM supplier
          UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'part', 2 FROM part),
edges AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, 's' || CAST(l_suppkey AS VARCHAR),
                   'p' || CAST(l_partkey AS VARCHAR), l_returnflag) - 1 AS BIGINT) AS edge_id,
                 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst,
                 l_returnflag AS label FROM lineitem),
und AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges))"""


def _event_rows(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    props = F.when(F.col("event_type") == "error", F.lit(None).cast("map<string,string>")).otherwise(
        F.create_map(F.lit("k"), k, F.lit("hour"), F.hour("ts").cast("string")))
    first = F.col("event_type").isin("view", "click")
    return ev.select("event_id", "ts", first.alias("first"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
                     F.col("event_type").alias("label"), props.alias("properties"),
                     F.concat(F.lit("u"), (k.cast("int") * 2).cast("string")).alias("dst"))


def event_graph(spark, sf) -> G.Graph:
    """Users upserted in two batches (later batch wins, then latest event),
    edges appended in two batches (user -> user named by the event)."""
    ev = _event_rows(spark, sf)
    seq = F.struct("ts", "event_id")
    nodes = G.upsert_nodes(G.upsert_nodes(None, ev.where("first"), seq), ev.where(~F.col("first")), seq)
    e = ev.select("event_id", "first", F.col("id").alias("src"), "dst", "label")
    order = [F.col("event_id").asc()]
    edges = G.append_edges(G.append_edges(None, e.where("first").drop("first"), order),
                           e.where(~F.col("first")).drop("first"), order).drop("event_id")
    return G.Graph(nodes, edges)


EVENT_SQL = """
ev AS (SELECT event_id, ts, 'u' || CAST(user_id AS VARCHAR) AS id, event_type AS label,
         CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS b,
         json_extract_string(props, '$.k') AS k, CAST(hour(ts) AS VARCHAR) AS hr,
         'u' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 2 AS VARCHAR) AS dst FROM events),
win AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b DESC, ts DESC, event_id DESC) AS rn FROM ev),
gnodes AS (SELECT id, label, CASE WHEN label = 'error' THEN NULL ELSE k END AS k,
                  CASE WHEN label = 'error' THEN NULL ELSE hr END AS hr FROM win WHERE rn = 1),
gedges AS (SELECT CAST(row_number() OVER (ORDER BY b, event_id) - 1 AS BIGINT) AS edge_id, id AS src, dst, label FROM ev)"""


@register("graph_nodes", f"""
WITH {EVENT_SQL.strip()}
SELECT id, label, CAST(CASE WHEN k IS NULL THEN 0 ELSE 2 END AS INTEGER) AS n_props, k, hr AS hour FROM gnodes""")
def graph_nodes(spark, sf):
    n = event_graph(spark, sf).nodes
    return n.select("id", "label", F.size("properties").alias("n_props"),
                    F.col("properties")["k"].alias("k"), F.col("properties")["hour"].alias("hour"))


@register("graph_node_properties", f"""
WITH {EVENT_SQL.strip()}
SELECT id AS node_id, 'k' AS key, k AS value FROM gnodes WHERE k IS NOT NULL
UNION ALL SELECT id, 'hour', hr FROM gnodes WHERE k IS NOT NULL""")
def graph_node_properties(spark, sf):
    return G.node_properties(event_graph(spark, sf).nodes)


@register("graph_edges", f"WITH {EVENT_SQL.strip()}\nSELECT edge_id, src, dst, label FROM gedges")
def graph_edges(spark, sf):
    return event_graph(spark, sf).edges.select("edge_id", "src", "dst", "label")


@register("graph_neighbors", f"""
WITH {LINEITEM_GRAPH_SQL.strip()},
q AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS query_id FROM supplier
      UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT q.query_id, true AS found, n.id, n.label
FROM q JOIN und ON und.a = q.query_id JOIN nodes n ON n.id = und.b
WHERE q.query_id IN (SELECT id FROM nodes) AND n.id <> q.query_id
UNION ALL
SELECT query_id, false, NULL, NULL FROM q WHERE query_id NOT IN (SELECT id FROM nodes)""")
def graph_neighbors(spark, sf):
    g = lineitem_graph(spark, sf)
    ids = (table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("query_id"))
           .unionByName(table(spark, sf, "nation").select(
               F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"))))
    return G.neighbors(g, ids).select("query_id", "found", "id", "label")


@register("graph_neighbors_self", f"""
WITH {EVENT_SQL.strip()},
und AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM gedges UNION ALL SELECT dst, src FROM gedges))
SELECT n.id AS query_id, true AS found, m.id AS id
FROM gnodes n JOIN und ON und.a = n.id JOIN gnodes m ON m.id = und.b""")
def graph_neighbors_self(spark, sf):
    g = event_graph(spark, sf)
    ids = g.nodes.select(F.col("id").alias("query_id"))
    return G.neighbors(g, ids, include_self=True).select("query_id", "found", "id")


@register("graph_degrees", f"""
WITH {LINEITEM_GRAPH_SQL.strip()},
d AS (SELECT a, count(*) AS c FROM und WHERE b IN (SELECT id FROM nodes) AND a <> b GROUP BY a)
SELECT id, CAST(coalesce(c, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN d ON d.a = nodes.id""")
def graph_degrees(spark, sf):
    return G.degrees(lineitem_graph(spark, sf))


@register("graph_snapshot", f"""
WITH {LINEITEM_GRAPH_SQL.strip()}
SELECT 'node' AS kind, id AS key, label, CAST(n_props AS INTEGER) AS n_props, NULL AS src, NULL AS dst FROM nodes
UNION ALL
SELECT 'edge', CAST(edge_id AS VARCHAR), label, NULL, src, dst FROM edges""")
def graph_snapshot(spark, sf):
    g = G.snapshot(lineitem_graph(spark, sf, with_ids=True))
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), "label",
                       F.size("properties").alias("n_props"), F.lit(None).cast("string").alias("src"),
                       F.lit(None).cast("string").alias("dst"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("key"), "label",
                       F.lit(None).cast("int").alias("n_props"), "src", "dst")
    return n.unionByName(e)


@register("graph_bfs", f"""
WITH RECURSIVE {LINEITEM_GRAPH_SQL.strip()},
reach(id, depth) AS (
  SELECT '{BFS_START}', 0
  UNION
  SELECT und.b, reach.depth + 1 FROM reach JOIN und ON und.a = reach.id
  WHERE reach.depth < 12 AND und.b IN (SELECT id FROM nodes)
)
SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY id""")
def graph_bfs(spark, sf):
    out = G.bfs(lineitem_graph(spark, sf), BFS_START)
    return out.select("id", F.col("depth").cast("bigint").alias("depth"))


def _region_documents(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    per = (n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))).alias("nations")))
    docs = r.join(per, r.r_regionkey == per.n_regionkey, "left")
    ents = F.concat(F.array(F.struct(F.col("r_name").alias("id"), F.lit("Region").alias("type"))),
                    F.transform(F.coalesce("nations", F.array()), lambda x: F.struct(
                        x["name"].alias("id"), F.lit("Location").alias("type"))))
    rels = F.transform(F.coalesce("nations", F.array()), lambda x: F.struct(
        x["name"].alias("source"), F.col("r_name").alias("target"), F.lit("located_in").alias("relation"),
        F.concat(F.lit("nation key "), x["key"].cast("string")).alias("context")))
    return docs.select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("id"),
                       F.col("r_regionkey").alias("_order"),
                       F.struct(ents.alias("entities"), rels.alias("relationships")).alias("graph"))


@register("graph_from_entities", """
WITH nodes AS (
  SELECT r_name AS id, 'Unknown' AS label, 'region-' || CAST(r_regionkey AS VARCHAR) AS document FROM region
  UNION ALL
  SELECT n_name, 'Location', 'region-' || CAST(n_regionkey AS VARCHAR) FROM nation
),
edges AS (
  SELECT CAST(row_number() OVER (ORDER BY 'region-' || CAST(r_regionkey AS VARCHAR), n_name) - 1 AS BIGINT) AS edge_id,
         n_name AS src, r_name AS dst, 'located_in' AS label, 'nation key ' || CAST(n_nationkey AS VARCHAR) AS context
  FROM nation JOIN region ON n_regionkey = r_regionkey
)
SELECT 'node' AS kind, id, label, document, NULL::BIGINT AS edge_id, NULL AS src, NULL AS dst, NULL AS context FROM nodes
UNION ALL
SELECT 'edge', NULL, label, NULL, edge_id, src, dst, context FROM edges""")
def graph_from_entities(spark, sf):
    g = G.entities_to_graph(_region_documents(spark, sf))
    n = g.nodes.select(F.lit("node").alias("kind"), "id", "label", F.col("properties")["document"].alias("document"),
                       F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("string").alias("src"),
                       F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("context"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("id"), "label",
                       F.lit(None).cast("string").alias("document"), "edge_id", "src", "dst", "context")
    return n.unionByName(e)


@register("graph_from_customers", """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, n_name, 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS doc
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'node' AS kind, c_name AS id, 'Organization' AS label, doc AS document, NULL::BIGINT AS edge_id, NULL AS src, NULL AS dst, NULL AS context FROM c
UNION ALL
SELECT 'node', n_name, 'Location', max(doc), NULL, NULL, NULL, NULL FROM c GROUP BY n_name
UNION ALL
SELECT 'edge', NULL, 'located_in', NULL, row_number() OVER (ORDER BY doc) - 1, c_name, n_name, c_mktsegment FROM c""")
def graph_from_customers(spark, sf):
    """G9 over as many documents as there are customers; a nation is named by
    many and keeps the last one's document."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = c.select(
        F.concat(F.lit("customer-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"),
        F.struct(
            F.array(F.struct(F.col("c_name").alias("id"), F.lit("Organization").alias("type")),
                    F.struct(F.col("n_name").alias("id"), F.lit("Location").alias("type"))).alias("entities"),
            F.array(F.struct(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("located_in").alias("relation"),
                             F.col("c_mktsegment").alias("context"))).alias("relationships")).alias("graph"))
    g = G.entities_to_graph(docs)
    n = g.nodes.select(F.lit("node").alias("kind"), "id", "label", F.col("properties")["document"].alias("document"),
                       F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("string").alias("src"),
                       F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("context"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("id"), "label",
                       F.lit(None).cast("string").alias("document"), "edge_id", "src", "dst", "context")
    return n.unionByName(e)
