"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its ``places`` nearest pivots out of
``pivots`` (a bounded sample of the vectors: those with the smallest id
hashes). The index deals the vectors into shards of about ``shard_rows`` by
hash, and keeps for each shard a pivot inverted file: for every pivot the
posting list of the vectors that have it among their nearest pivots, with its
place in their order. Every vector is indexed.

A search looks up the posting lists of the query's nearest pivots and adds up
the induced footrule distance of the orders (a pivot that one side lacks
counts as standing at place ``places``). The best ``candidates`` of a shard
(at least ``LEAST_CANDIDATES``, else ``share`` of its vectors) are reranked by
their exact distance; the best ``k`` of all shards are the answer. The share is
wide because nearly isotropic vectors, such as the test tables', have no
structure that a narrow candidate list could use; recall against brute force
is a test.

Work is dealt by shard: a task holds one shard's index while queries stream
past it, so memory does not follow the number of queries, and the queries'
copies (queries x shards rows) are all that is shuffled besides the index.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors whose length is not the commonest;
rows that share an id count once, with the smallest vector; a query is never
its own neighbour; fewer candidates than ``k`` are all returned; ties go to
the smaller id; null ids and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import parts, stored, workers_ready

PIVOTS = 256
PLACES = 64
SHARD_ROWS = 8192
LEAST_CANDIDATES = 1000
SHARE = 0.12
K = 10


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, one row per id."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)))
    top = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), "d").limit(1).collect())
    size = top[0].d if top else 0
    return rows.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].v) if rows else 0)


def orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of every row, nearest first (ties: smaller number)."""
    far = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :places]


def build_index(vectors: DataFrame, pivots: np.ndarray, *, places: int = PLACES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ids, vectors, and its pivot inverted file (posting
    list bounds by pivot; members; their places). ``vectors``: (id, v)."""
    places = min(places, len(pivots))
    total = vectors.count()
    shards = max(1, -(-total // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, now = [], [], None

        def shard():
            x = np.array(rows, dtype=np.float64)
            near = orders(x, pivots, places)
            member = np.repeat(np.arange(len(x), dtype=np.int32), places)
            place = np.tile(np.arange(places, dtype=np.int16), len(x))
            by = np.argsort(near.ravel(), kind="stable")
            start = np.searchsorted(near.ravel()[by], np.arange(len(pivots) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([start.astype("<i4").tobytes()], pa.binary()),
                 pa.array([member[by].astype("<i4").tobytes()], pa.binary()),
                 pa.array([place[by].astype("<i2").tobytes()], pa.binary())],
                names=["shard", "ids", "vectors", "starts", "members", "places"])

        for b in batches:
            for s, i, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if s != now and ids:
                    yield shard()
                    ids, rows = [], []
                now = s
                ids.append(i)
                rows.append(v)
        if ids:
            yield shard()

    return (vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")
            .repartition(min(shards, parts(vectors.sparkSession)), "shard").sortWithinPartitions("shard", "id")
            .mapInArrow(run, "shard bigint, ids binary, vectors binary, starts binary, members binary, places binary"))


class Shard:
    """A shard's index in memory."""

    def __init__(self, row: dict, pivots: np.ndarray, places: int, k: int, share: float, least: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), -1)
        self.starts = np.frombuffer(row["starts"], "<i4")
        self.members = np.frombuffer(row["members"], "<i4")
        self.places = np.frombuffer(row["places"], "<i2").astype(np.int32)
        self.pivots, self.length, self.k = pivots, places, k
        self.take = max(least, int(share * len(self.ids)), k + 1)

    def search(self, query_id: int, q: np.ndarray) -> list[tuple[int, int, float]]:
        length = self.length
        footrule = np.full(len(self.ids), length * (length + 1), dtype=np.int32)
        for place, p in enumerate(orders(q[None, :], self.pivots, length)[0]):
            z = slice(self.starts[p], self.starts[p + 1])
            footrule[self.members[z]] += 2 * (np.maximum(self.places[z], place) - length)
        footrule[self.ids == query_id] = np.iinfo(np.int32).max
        if self.take < len(self.ids):
            worst = np.partition(footrule, self.take - 1)[self.take - 1]
            near = np.flatnonzero(footrule <= worst)               # ties at the border come too
        else:
            near = np.arange(len(self.ids))
        near = near[self.ids[near] != query_id]
        d = np.sqrt(((self.x[near] - q) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[near], d))[:self.k]
        return [(query_id, int(self.ids[near[i]]), float(d[i])) for i in best]


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, *, k: int = K, places: int = PLACES,
           share: float = SHARE, least: int = LEAST_CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``queries`` (id, v)."""
    spark = queries.sparkSession
    places = min(places, len(pivots))
    # Shard numbers come from a hash, so all but the smallest tables fill 0 .. shards - 1.
    last = index.agg(F.max("shard").alias("m")).first().m
    sent = queries.withColumn("all", F.sequence(F.lit(0).cast("bigint"), F.lit(last or 0).cast("bigint")))
    empty = F.lit(None).cast("binary")
    rows = (index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"),
                         F.lit(None).cast("array<double>").alias("v"), "ids", "vectors", "starts", "members", "places")
            .unionByName(sent.select(F.explode("all").alias("shard"), F.lit(1).alias("kind"), "id", "v",
                                     *[empty.alias(c) for c in ("ids", "vectors", "starts", "members", "places")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for b in batches:
            found = []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    shard, number = Shard(row, pivots, places, k, share, least), row["shard"]
                elif number == row["shard"]:
                    found += shard.search(row["id"], np.array(row["v"], dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"])

    found = (rows.repartition(parts(spark), "shard").sortWithinPartitions("shard", "kind", "id")
             .mapInArrow(run, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, **kw) -> DataFrame:
    """Index all vectors, store the index, and search it for those whose id
    satisfies ``is_query`` (a function of the id column)."""
    spark = vectors.sparkSession
    workers_ready(spark)
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    pivots = choose_pivots(rows)
    if not len(pivots):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = stored(build_index(rows, pivots), "permutation-index")
    return search(index, rows.where(is_query(F.col("id"))), pivots, k=k, **kw)
