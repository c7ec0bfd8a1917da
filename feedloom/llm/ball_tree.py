"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector of integers: for every term of the query set, its
saturated frequency ``(10**9 * tf) div (1000 * tf + 8 * m)``, where ``m`` grows
with the document's length. A query is the vector of its terms' integer
weights; the score is the inner product.

1. Items become rows of distinct terms, in blocks of about ``BLOCK_TERMS``
   terms. Each block has an index of its own, over the coordinates that its
   queries use; other coordinates add nothing to any product and would only
   widen the balls.
2. One pass over the whole texts writes every document's frequencies and
   length; totals and document frequencies are partial aggregates over it.
3. ``SHARD_DOCS`` documents at a time (fewer, if long) become a ball tree: a
   node splits its documents at the middle of the line between two far apart
   ones. A node holds a centroid in single precision, the greatest distance of
   its documents from that stored centroid (the ball's radius), and how far
   they reach above it along each coordinate, all rounded upwards, so every
   error of the centroid is inside the radii. One index row is one shard;
   building moves no data between tasks.
4. Seeds: every shard descends to the best leaf of each query. The k-th best
   seed over all shards is a score that the answer reaches for certain.
5. Search: each shard opens nodes in the order of the bound
   ``<query, centroid> + min(|query| * radius, <query, reach>)`` (rounded upwards)
   until the bound is below the k-th best score known. The ball alone is wide in
   many dimensions; a query looks at few of them, and along those the reach is
   short. Leaves are scored in exact integers, so the answer is that of scoring
   every document.

Vectors are scaled by the square root of the term's weight on both sides, which
leaves products as they are and keeps common terms from widening the balls.

Defined results: a null or empty text, or one without terms, is no document and
no query; every row of documents counts by itself, repeated ones too (their
equal scores stand next to each other); every item row is a query of its own; a
null ``doc_id`` comes last among equal scores; other columns are ignored; with
no documents or no items nothing is returned."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import bytes_list, gives_back, stored, workers_ready

K = 10
BLOCK_TERMS = 100_000
SHARD_DOCS = 4096
SHARD_ENTRIES = 4_000_000
LEAF = 32

#: A-Z lower-cased, what is no part of a term (below 0x80 all but letters and digits) blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_LETTERS).split() if text else []


# -- sparse rows ---------------------------------------------------------------------------------

class Rows:
    """Sparse rows: row i has the coordinates ``ids[start[i]:start[i + 1]]``."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.start, self.ids, self.values = start, ids, values

    def __len__(self) -> int:
        return len(self.start) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the entries of ``rows`` one after the other, starts)."""
        size = self.start[rows + 1] - self.start[rows]
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=start[1:])
        return np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1]), start

    def take(self, rows: np.ndarray) -> Rows:
        at, start = self.entries(rows)
        return Rows(start, self.ids[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner products with a dense vector; every row has an entry."""
        return np.add.reduceat(self.values * dense[self.ids], self.start[:-1])


def _ball(rows: Rows, squares: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(centroid and reach above it in single precision, radius, squared distances)."""
    centre = (np.bincount(rows.ids, rows.values, dims) / len(rows)).astype(np.float32)
    wide = centre.astype(np.float64)
    size = float(wide @ wide)
    away = np.maximum(squares - 2 * rows.dot(wide) + size, 0)
    # The slack covers the rounding of the three sums above.
    top = np.zeros(dims)
    np.maximum.at(top, rows.ids, rows.values)
    reach = np.nextafter((top - wide).astype(np.float32), np.float32(np.inf))
    return centre, reach, math.sqrt(float((away + 1e-11 * (squares + size)).max())) * (1 + 1e-9), away


def build(rows: Rows, dims: int, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes) of a ball tree. Nodes: ``lo`` and ``hi`` in
    that order, ``left`` and ``right`` (-1: a leaf), ``radius``, and the
    centroids by coordinate (``c_term``, ``c_node``, ``c_value``, ``c_reach``)."""
    squares = np.add.reduceat(rows.values * rows.values, rows.start[:-1])
    order = np.arange(len(rows))
    lo, hi, left, right, radius, terms, owners, values, reaches = [], [], [], [], [], [], [], [], []
    todo = [(0, len(rows), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node = len(lo)
        if parent >= 0:
            (left, right)[side][parent] = node
        here = order[a:b]
        own = rows.take(here)
        centre, reach, r, away = _ball(own, squares[here], dims)
        at = np.flatnonzero(centre)
        lo.append(a), hi.append(b), left.append(-1), right.append(-1), radius.append(r)
        terms.append(at), owners.append(np.full(len(at), node)), values.append(centre[at]), reaches.append(reach[at])
        if b - a <= leaf or r <= 1e-4 * math.sqrt(float(squares[here].max())):        # few rows, or all alike
            continue
        line = _direction(own, int(away.argmax()), squares[here], dims)
        order[a:b] = here[np.argsort(own.dot(line), kind="stable")]
        middle = (a + b) // 2
        todo += [(a, middle, node, 0), (middle, b, node, 1)]
    term = np.concatenate(terms)
    by_term = np.argsort(term, kind="stable")
    return order, {
        "lo": np.array(lo, np.int32), "hi": np.array(hi, np.int32), "left": np.array(left, np.int32),
        "right": np.array(right, np.int32), "radius": np.array(radius, np.float64),
        "c_term": term[by_term].astype(np.int32), "c_node": np.concatenate(owners)[by_term].astype(np.int32),
        "c_value": np.concatenate(values)[by_term], "c_reach": np.concatenate(reaches)[by_term]}


def _direction(rows: Rows, far: int, squares: np.ndarray, dims: int) -> np.ndarray:
    """From the row farthest from row ``far`` to that row."""
    def dense(i: int) -> np.ndarray:
        a, b = rows.start[i], rows.start[i + 1]
        out = np.zeros(dims)
        out[rows.ids[a:b]] = rows.values[a:b]
        return out
    one = dense(far)
    return one - dense(int((squares - 2 * rows.dot(one)).argmax()))


# -- one shard -----------------------------------------------------------------------------------

#: Arrays of a shard, each a binary column of the index.
ARRAYS = {"doc": np.int64, "no_id": np.bool_, "start": np.int64, "term": np.int32, "value": np.int32,
          "lo": np.int32, "hi": np.int32, "left": np.int32, "right": np.int32, "radius": np.float64,
          "c_term": np.int32, "c_node": np.int32, "c_value": np.float32, "c_reach": np.float32}
INDEX_DDL = ", ".join(f"`{name}` binary" for name in ARRAYS)


class Shard:
    """A ball tree read back from its index row."""

    def __init__(self, arrays: dict[str, np.ndarray], dims: int):
        self.__dict__.update(arrays)
        self.weights = np.zeros(dims, np.int64)
        self.scored = 0

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node a number that no score below it exceeds."""
        a, b = np.searchsorted(self.c_term, terms, "left"), np.searchsorted(self.c_term, terms, "right")
        size = b - a
        ends = np.cumsum(size)
        at = np.repeat(a - ends + size, size) + np.arange(size.sum())
        node, root = self.c_node[at], np.repeat(np.sqrt(weights.astype(np.float64)), size)
        dot = np.bincount(node, self.c_value[at] * root, len(self.radius))
        along = np.bincount(node, self.c_reach[at] * root, len(self.radius))
        return (dot + np.minimum(math.sqrt(float(weights.sum())) * self.radius, along)) * (1 + 1e-9) + 1

    def scores(self, lo: int, hi: int) -> np.ndarray:
        a, b = self.start[lo], self.start[hi]
        self.scored += hi - lo
        return np.add.reduceat(self.weights[self.term[a:b]] * self.value[a:b], self.start[lo:hi] - a)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1,
               seed_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the best ``k`` rows that score ``floor`` or more."""
        bounds = self.bounds(terms, weights)
        self.weights[terms] = weights
        best, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if self.left[node] >= 0:
                children = [(-min(bounds[c], -bound), int(c)) for c in (self.left[node], self.right[node])]
                if seed_only:
                    children = [min(children)]
                for child in children:
                    if -child[0] >= floor:
                        heapq.heappush(heap, child)
                continue
            found = self.scores(self.lo[node], self.hi[node])
            good = np.flatnonzero(found >= floor)
            if len(good):
                best, rows = np.concatenate([best, found[good]]), np.concatenate([rows, good + self.lo[node]])
                if len(best) > k:
                    keep = np.lexsort((self.doc[rows], self.no_id[rows], -best))[:k]
                    best, rows = best[keep], rows[keep]
                if len(best) == k:
                    floor = max(floor, int(best.min()))
        self.weights[terms] = 0
        return best, rows


# -- Spark ---------------------------------------------------------------------------------------

def queries_of(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item, terms) of every item row with a term, with a stable
    number for each row."""
    workers_ready(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(set(terms_of(t))) for t in bytes_list(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    kind = items.schema[item_col].dataType.simpleString()
    rows = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(gives_back(run), f"item {kind}, terms array<binary>").where(F.size("terms") > 0)
    return stored(found.withColumn("query", F.monotonically_increasing_id()), "queries")


def postings(docs: DataFrame, vocabulary: list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, term, tf) of every document with a term; ``term`` and ``tf``
    are int32 arrays over the vocabulary."""
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for b in batches:
            keep, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(bytes_list(b.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                held = Counter(map(number.get, words))
                held.pop(None, None)
                at = np.fromiter(held.keys(), np.int32, len(held))
                by = np.argsort(at)
                keep.append(i), lengths.append(len(words)), terms.append(at[by].tobytes())
                counts.append(np.fromiter(held.values(), np.int32, len(held))[by].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc", "n", "term", "tf"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(gives_back(run), "doc bigint, n bigint, term binary, tf binary"), "postings")


def document_counts(held: DataFrame, dims: int) -> np.ndarray:
    """Documents that hold each term: added up in every task, then by term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=dims)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "df"])

    rows = held.select("term").mapInArrow(gives_back(run), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(dims, np.int64)
    for r in rows.collect():                                    # at most one row for each term of the block
        out[r.term] = r.df
    return out


def build_index(held: DataFrame, weights: np.ndarray, docs: int, terms: int, *, shard_docs: int = SHARD_DOCS,
                leaf: int = LEAF) -> DataFrame:
    """The stored index: one row for each ball tree."""
    dims, root = len(weights), np.sqrt(weights.astype(np.float64))

    def tree(ids: list, lengths: list, term: list, tf: list) -> pa.RecordBatch:
        start = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(t) // 4 for t in term], out=start[1:])
        at, count = (np.frombuffer(b"".join(x), np.int32) for x in (term, tf))
        m = np.repeat([10 + 90 * n * docs // terms for n in lengths], np.diff(start)).astype(np.int64)
        tf64 = count.astype(np.int64)
        value = 1_000_000_000 * tf64 // (1000 * tf64 + 8 * m)
        order, nodes = build(Rows(start, at, value * root[at]), dims, leaf)
        own = Rows(start, at, value).take(order)
        shard = {"doc": np.array([i or 0 for i in ids])[order], "no_id": np.array([i is None for i in ids])[order],
                 "start": own.start, "term": own.ids, "value": own.values, **nodes}
        return pa.RecordBatch.from_arrays(
            [pa.array([np.ascontiguousarray(shard[n].astype(t)).tobytes()], pa.binary()) for n, t in ARRAYS.items()],
            names=list(ARRAYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = ([], [], [], []), 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for column, x in zip(waiting, row):
                    column.append(x)
                size += len(row[2]) // 4
                if len(waiting[0]) >= shard_docs or size >= SHARD_ENTRIES:
                    yield tree(*waiting)
                    waiting, size = ([], [], [], []), 0
        if waiting[0]:
            yield tree(*waiting)

    return stored(held.where(F.length("term") > 0).select("doc", "n", "term", "tf")
                  .mapInArrow(gives_back(run), INDEX_DDL), "balls")


def search(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], dims: int, *, k: int = K,
           floors: dict[int, int] | None = None, seed_only: bool = False) -> DataFrame:
    """(query, doc, score) of the best ``k`` documents of every shard; with
    ``seed_only`` of one leaf a shard. ``queries``: (number, terms, weights)."""
    floors = floors or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard({n: np.frombuffer(row[n], t) for n, t in ARRAYS.items()}, dims)
                number, doc, none, score = [], [], [], []
                for q, terms, weights in queries:
                    best, rows = shard.search(terms, weights, k, floors.get(q, 1), seed_only)
                    number += [q] * len(best)
                    doc.append(shard.doc[rows]), none.append(shard.no_id[rows]), score.append(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array(np.concatenate(doc), mask=np.concatenate(none)),
                     pa.array(np.concatenate(score))], names=["query", "doc", "score"])

    return index.mapInArrow(gives_back(run), "query bigint, doc bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(spark: SparkSession, docs: DataFrame, block: DataFrame, k: int, columns: dict) -> DataFrame | None:
    """The answers to one block of queries: its terms are bounded by ``BLOCK_TERMS``."""
    asked = [(r.query, [bytes(t) for t in r.terms]) for r in block.select("query", "terms").collect()]
    vocabulary = sorted({t for _, terms in asked for t in terms})
    if not vocabulary:
        return None
    number, dims = {t: i for i, t in enumerate(vocabulary)}, len(vocabulary)
    held = postings(docs, vocabulary, **columns)
    total = held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total.docs:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(df) + 1)))
                        for df in document_counts(held, dims)], np.int64)
    index = build_index(held, weights, total.docs, total.terms)
    queries = [(q, at, weights[at]) for q, terms in asked for at in [np.array([number[t] for t in terms], np.int64)]]
    seeds = _best(search(index, queries, dims, k=k, seed_only=True), k).where(F.col("rank") == k)
    floors = {r.query: r.score for r in seeds.select("query", "score").collect()}          # one row a query
    return search(index, queries, dims, k=k, floors=floors)


def ranked(docs: DataFrame, items: DataFrame, *, k: int = K, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item row."""
    spark = docs.sparkSession
    queries = queries_of(items, item_col=item_col, text_col=item_text_col)
    asked = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(asked / block_terms))
    found = [f for i in range(blocks)
             if (f := _block(spark, docs, queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i), k,
                             {"id_col": id_col, "text_col": text_col})) is not None]
    out = found[0] if found else spark.createDataFrame([], "query bigint, doc bigint, score bigint")
    for more in found[1:]:
        out = out.unionByName(more)
    return (_best(out, k).join(queries.select("query", "item"), "query")
            .select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"))
