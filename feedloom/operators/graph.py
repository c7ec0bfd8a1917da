"""Property graph over two tables.

``nodes(id, label, properties map<string,string>)`` and
``edges(edge_id, src, dst, label[, context])``. Every operator is a bulk
DataFrame job: neighbours are two joins, breadth-first search is one join
per *level* (not per node), and nothing is collected to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.latest import pick
from feedloom.operators.ordered import row_rank
from feedloom.session import saved

EMPTY_PROPS = "cast(map() as map<string,string>)"
# Fixed values that must equal the reference's for identical results.
ENTITY_TYPES = ("Organization", "Person", "Product", "Concept", "Location", "Event", "Unknown")


class NodeNotFound(KeyError):
    pass


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], "id string, label string, properties map<string,string>"),
                 spark.createDataFrame([], "edge_id bigint, src string, dst string, label string"))


def _props(c: Column) -> Column:
    return F.coalesce(c, F.expr(EMPTY_PROPS))


# --- G1 / G2 writes -----------------------------------------------------------------

def upsert_nodes(nodes: DataFrame | None, new: DataFrame, order: str | Column | None = None) -> DataFrame:
    """Insert or replace by id: label and *all* properties are replaced;
    NULL properties become an empty map. Within ``new`` the last row in
    ``order`` wins, and the last row of all where no order is given. Ids and
    order decide (``latest``); labels and properties move once."""
    seq = [] if order is None else [F.col(order) if isinstance(order, str) else order]
    rows = new.select("id", "label", _props(F.col("properties")).alias("properties"),
                      *[c.alias(f"_s{i}") for i, c in enumerate(seq)])
    fresh = pick(rows, "id", [F.col(f"_s{i}") for i in range(len(seq))]).kept.select("id", "label", "properties")
    if nodes is None:
        return fresh
    old = nodes.select("id", "label", _props(F.col("properties")).alias("properties"))
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def append_edges(edges: DataFrame | None, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Always append (duplicates, self-loops and dangling ends allowed).
    New edges get ids after the current maximum in ``order`` (exact,
    distributed rank; the only driver value is the current maximum)."""
    start = 0
    if edges is not None:
        top = edges.agg(F.max("edge_id")).first()[0]
        start = 0 if top is None else int(top) + 1
    order = order or [F.col("src").asc(), F.col("dst").asc(), F.col("label").asc()]
    ranked = row_rank(new, order, name="_r").withColumn("edge_id", F.col("_r") + F.lit(start)).drop("_r")
    cols = ["edge_id", "src", "dst", "label"] + [c for c in new.columns if c not in ("edge_id", "src", "dst", "label")]
    ranked = ranked.select(*cols)
    if edges is None:
        return ranked
    return edges.unionByName(ranked, allowMissingColumns=True)


# --- Q2 / G3 / G4 / G5 reads ----------------------------------------------------------

def _both_ways() -> Column:
    """(a, b) of both directions of each edge, from one scan."""
    return F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                            F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b) pairs for every edge in both directions. With
    ``nodes``, pairs whose far end is not a node (dangling) are dropped."""
    u = edges.select(_both_ways()).distinct()
    if nodes is not None:
        u = u.join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return u


def node_exists(nodes: DataFrame, ids: DataFrame, id_col: str = "query_id") -> DataFrame:
    """F6 batch form: (query_id, found)."""
    known = nodes.select(F.col("id").alias(id_col), F.lit(True).alias("found"))
    return (ids.select(id_col).distinct().join(known, id_col, "left")
            .select(id_col, F.coalesce("found", F.lit(False)).alias("found")))


def neighbors(g: Graph, ids: DataFrame, include_self: bool = False,
              id_col: str = "query_id") -> DataFrame:
    """(query_id, found, id, label, properties): distinct nodes joined to
    each query id by an edge in either direction; dangling ends dropped;
    an unknown query id gives one row with ``found=false``.

    ``include_self=False`` is the relational backend's rule (a self-loop
    does not make a node its own neighbour)."""
    exists = node_exists(g.nodes, ids, id_col)
    # The asked ids first: only their edges are made distinct.
    pairs = (exists.where("found").select(id_col).join(g.edges.select(_both_ways()), F.col(id_col) == F.col("a"))
             .select(id_col, F.col("b").alias("id")).distinct())
    if not include_self:
        pairs = pairs.where(F.col("id") != F.col(id_col))
    found = (pairs.join(g.nodes, "id", "inner")
             .select(id_col, F.lit(True).alias("found"), "id", "label", "properties"))
    missing = exists.where(~F.col("found")).select(
        id_col, "found", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("map<string,string>").alias("properties"))
    return found.unionByName(missing)


def adjacency(g: Graph, include_self: bool = False) -> DataFrame:
    """G5 long form: (id, neighbor) for every node at once. Kept long (no
    per-node list), so a node with a third of all edges is never packed
    into one row."""
    u = undirected(g.edges, g.nodes).join(g.nodes.select(F.col("id").alias("a")), "a", "left_semi")
    if not include_self:
        u = u.where(F.col("a") != F.col("b"))
    return u.select(F.col("a").alias("id"), F.col("b").alias("neighbor"))


def degrees(g: Graph, include_self: bool = False) -> DataFrame:
    """(id, degree): distinct existing neighbours per node, 0 for isolated
    nodes. Counting is a partial aggregate."""
    counts = adjacency(g, include_self).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return (g.nodes.select("id").join(counts, "id", "left")
            .select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")))


# --- G6 / G8 / Q7 ---------------------------------------------------------------------

def snapshot(g: Graph) -> Graph:
    """All nodes with properties and all edges in insertion order."""
    return Graph(g.nodes, g.edges.orderBy("edge_id"))


def snapshot_json(g: Graph) -> DataFrame:
    """One JSON line per node and per edge (export form of a snapshot)."""
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"),
                       F.to_json(F.struct("id", "label", "properties")).alias("json"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("key"),
                       F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "label")).alias("json"))
    return n.unionByName(e)


def node_properties(nodes: DataFrame) -> DataFrame:
    """Long form (node_id, key, value) of the property maps."""
    return nodes.select(F.col("id").alias("node_id"), F.explode("properties").alias("key", "value"))


def nodes_from_properties(base: DataFrame, props: DataFrame) -> DataFrame:
    """Inverse of ``node_properties``: one join instead of a query per node."""
    packed = props.groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    return (base.join(packed.withColumnRenamed("node_id", "id"), "id", "left")
            .select("id", "label", _props(F.col("properties")).alias("properties")))


# --- G7 breadth-first search -------------------------------------------------------------

def bfs(g: Graph, start: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of every node reachable from ``start`` over undirected
    edges, start included at depth 0. Unknown start -> NodeNotFound.

    One join per level, never one per node, and one job per level: the level
    is saved and counted by the same job. Each undirected pair is saved once,
    as Parquet, and read in both directions; levels are saved so too, and
    how a level meets the pairs, by broadcast, by shuffle or with a hub's edges
    split over tasks, is decided from the sizes they have. So while a level is
    small no pair moves, and only the ends it reaches are looked up among the
    nodes. In an undirected graph a neighbour of a node at depth d sits at
    depth d-1, d or d+1, so the anti join only needs the last two levels, not
    the whole visited set."""
    spark = g.nodes.sparkSession
    nodes = saved(g.nodes.select("id"), "bfs-nodes")
    if nodes.where(F.col("id") == start).isEmpty():
        raise NodeNotFound(start)
    ends = g.edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = saved(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "bfs-pairs")
    und = pairs.select(_both_ways())
    levels = [spark.createDataFrame([(start,)], "id string")]
    while max_depth is None or len(levels) <= max_depth:
        seen = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])
        reached = und.join(levels[-1].select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        count = Observation()
        found = reached.join(seen, "id", "left_anti").join(nodes, "id", "left_semi")
        found = saved(found.observe(count, F.count(F.lit(1)).alias("n")), "bfs-level")
        if not count.get["n"]:
            break
        levels.append(found)
    out = levels[0].withColumn("depth", F.lit(0))
    for depth, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


# --- G9 / G10 -------------------------------------------------------------------------------

def entities_to_graph(documents: DataFrame, graph_col: str = "graph", id_col: str = "id",
                      existing: Graph | None = None) -> Graph:
    """Document encyclopedias -> nodes (label = entity type, unknown types
    -> Unknown) and edges (label = relation, context kept)."""
    ents = documents.select(F.col(id_col).alias("_doc"), F.explode(F.col(graph_col)["entities"]).alias("e"))
    typ = F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise(F.lit("Unknown"))
    new_nodes = ents.select(F.col("e.id").alias("id"), typ.alias("label"),
                            F.create_map(F.lit("document"), F.col("_doc")).alias("properties"),
                            F.col("_doc").alias("_seq"))
    rels = documents.select(F.col(id_col).alias("_doc"),
                            F.posexplode(F.col(graph_col)["relationships"]).alias("_pos", "r"))
    new_edges = rels.select(F.col("r.source").alias("src"), F.col("r.target").alias("dst"),
                            F.col("r.relation").alias("label"), F.col("r.context").alias("context"),
                            "_doc", "_pos")
    nodes = upsert_nodes(existing.nodes if existing else None, new_nodes, "_seq")
    edges = append_edges(existing.edges if existing else None, new_edges,
                         [F.col("_doc").asc(), F.col("_pos").asc()]).drop("_doc", "_pos")
    return Graph(nodes, edges)


def synthetic_graph(spark: SparkSession, n: int, seed: int = 42, edges_per_node: int = 3) -> Graph:
    """n nodes with two properties and ``edges_per_node * n`` pseudo-random
    edges; deterministic (hash based), generated in parallel."""
    nodes = spark.range(n).select(
        F.concat(F.lit("node-"), F.col("id").cast("string")).alias("id"), F.lit("node").alias("label"),
        F.create_map(F.lit("name"), F.concat(F.lit("Node "), F.col("id").cast("string")),
                     F.lit("index"), F.col("id").cast("string")).alias("properties"))
    pick = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))
    edges = spark.range(edges_per_node * n).select(
        F.col("id").alias("edge_id"),
        F.concat(F.lit("node-"), pick(1).cast("string")).alias("src"),
        F.concat(F.lit("node-"), pick(2).cast("string")).alias("dst"),
        F.lit("link").alias("label"))
    return Graph(nodes, edges)
