from collections import deque

import pytest
from pyspark.sql import functions as F

from feedloom.operators import graph as G
from feedloom.session import saved


def graph(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "id string, label string, properties map<string,string>")
    e = spark.createDataFrame([(i, s, d, l) for i, (s, d, l) in enumerate(edges)],
                              "edge_id bigint, src string, dst string, label string")
    return G.Graph(n, e)


def cycle(spark):
    return graph(spark, [("a", "P", {"k": "1"}), ("b", "P", {"k": "2"}), ("c", "P", None)],
                 [("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r")])


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "query_id string")


def test_neighbors_both_directions(spark):
    g = cycle(spark)
    r = G.neighbors(g, ids(spark, "a", "zz"))
    found = sorted(x.id for x in r.where("found").collect())
    assert found == ["b", "c"]
    miss = r.where(~F.col("found")).collect()
    assert [x.query_id for x in miss] == ["zz"] and miss[0].id is None


def test_snapshot_sizes_and_properties(spark):
    s = G.snapshot(cycle(spark))
    assert s.nodes.count() == 3 and s.edges.count() == 3
    props = {r.id: r.properties for r in s.nodes.collect()}
    assert props["a"] == {"k": "1"}
    assert [r.edge_id for r in s.edges.collect()] == [0, 1, 2]


def test_upsert_replaces_label_and_all_properties(spark):
    n0 = spark.createDataFrame([("a", "Old", {"x": "1", "y": "2"})], "id string, label string, properties map<string,string>")
    new = spark.createDataFrame([("a", "New", {"z": "3"}, 1), ("b", "B", None, 1), ("b", "B2", {"q": "1"}, 2)],
                                "id string, label string, properties map<string,string>, seq int")
    out = {r.id: (r.label, r.properties) for r in G.upsert_nodes(n0, new, "seq").collect()}
    assert out == {"a": ("New", {"z": "3"}), "b": ("B2", {"q": "1"})}
    again = G.upsert_nodes(G.upsert_nodes(None, new, "seq"), new, "seq")
    assert again.count() == 2                                     # idempotent


def test_append_edges_keeps_duplicates_selfloops_dangling(spark):
    g = cycle(spark)
    new = spark.createDataFrame([("a", "b", "r"), ("a", "a", "self"), ("a", "ghost", "r")], "src string, dst string, label string")
    e = G.append_edges(g.edges, new)
    assert e.count() == 6
    assert sorted(r.edge_id for r in e.collect()) == list(range(6))
    g2 = G.Graph(g.nodes, e)
    no_self = sorted(r.id for r in G.neighbors(g2, ids(spark, "a")).collect())
    with_self = sorted(r.id for r in G.neighbors(g2, ids(spark, "a"), include_self=True).collect())
    assert no_self == ["b", "c"] and with_self == ["a", "b", "c"]       # ghost dropped


def test_degrees_and_isolated(spark):
    g = graph(spark, [("a", "P", None), ("b", "P", None), ("lone", "P", None)], [("a", "b", "r"), ("a", "b", "r")])
    d = {r.id: r.degree for r in G.degrees(g).collect()}
    assert d == {"a": 1, "b": 1, "lone": 0}


def test_properties_long_form_round_trip(spark):
    g = cycle(spark)
    long = G.node_properties(g.nodes)
    assert sorted(tuple(r) for r in long.collect()) == [("a", "k", "1"), ("b", "k", "2")]
    back = G.nodes_from_properties(g.nodes.select("id", "label"), long)
    assert {r.id: r.properties for r in back.collect()} == {"a": {"k": "1"}, "b": {"k": "2"}, "c": {}}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_bfs_matches_python_and_depth_one_is_neighbors(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        check_bfs(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def check_bfs(spark):
    g = G.synthetic_graph(spark, 300, seed=7, edges_per_node=2)
    got = {r.id: r.depth for r in G.bfs(g, "node-0").collect()}
    adj = {}
    for r in g.edges.collect():
        adj.setdefault(r.src, set()).add(r.dst)
        adj.setdefault(r.dst, set()).add(r.src)
    seen, q = {"node-0": 0}, deque(["node-0"])
    while q:
        x = q.popleft()
        for y in adj.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                q.append(y)
    assert got == seen
    one = {r.id for r in G.neighbors(g, ids(spark, "node-0")).collect()}
    assert one == {k for k, v in got.items() if v == 1}


def test_bfs_unknown_start(spark):
    with pytest.raises(G.NodeNotFound):
        G.bfs(cycle(spark), "nope")


def test_entities_to_graph(spark):
    docs = spark.createDataFrame(
        [("d1", ([("Acme", "Organization"), ("Ann", "Person"), ("X", "Weird")],
                 [("Ann", "Acme", "works_at", "since 2020")]))],
        "id string, graph struct<entities: array<struct<id: string, type: string>>, "
        "relationships: array<struct<source: string, target: string, relation: string, context: string>>>")
    g = G.entities_to_graph(docs)
    assert sorted((r.id, r.label) for r in g.nodes.collect()) == [("Acme", "Organization"), ("Ann", "Person"), ("X", "Unknown")]
    e = g.edges.first()
    assert (e.src, e.dst, e.label, e.context, e.edge_id) == ("Ann", "Acme", "works_at", "since 2020", 0)


def test_bfs_through_a_hub_is_exact_and_stops_at_a_depth(spark):
    leaves = [f"l{i}" for i in range(400)]
    nodes = [("hub", "H", None)] + [(x, "L", None) for x in leaves] + [("tail", "T", None)]
    edges = [("hub", x, "r") for x in leaves] + [("l7", "tail", "r"), ("tail", "ghost", "r"), ("tail", "tail", "r")]
    g = graph(spark, nodes, edges)
    depth = {r.id: r.depth for r in G.bfs(g, "tail").collect()}
    assert depth["tail"] == 0 and depth["l7"] == 1 and depth["hub"] == 2 and depth["l8"] == 3
    assert len(depth) == 402
    assert {r.id for r in G.bfs(g, "tail", max_depth=2).collect()} == {"tail", "l7", "hub"}
    assert {r.id for r in G.bfs(g, "tail", max_depth=0).collect()} == {"tail"}


def test_snapshot_json_lines(spark):
    import json as _json
    rows = {(r.kind, r.key): _json.loads(r.json) for r in G.snapshot_json(cycle(spark)).collect()}
    assert rows[("node", "a")] == {"id": "a", "label": "P", "properties": {"k": "1"}}
    assert rows[("edge", "0")] == {"from": "a", "to": "b", "label": "r"}
    assert len(rows) == 6


def test_bfs_saves_each_undirected_pair_once(spark, monkeypatch):
    """Repeated, reversed, null-ended and dangling edges; what is saved is one row a pair."""
    held = {}

    def recorded(df, name):
        out = saved(df, name)
        held.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(G, "saved", recorded)
    nodes = spark.createDataFrame([(x, "n", {}) for x in "abcde"], "id string, label string, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "x"), ("x", "d"), (None, "a"), ("e", None)],
                                  "src string, dst string")
    got = G.bfs(G.Graph(nodes, edges), "a")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert held["bfs-pairs"] == [5] and held["bfs-level"] == [1, 1, 0]
