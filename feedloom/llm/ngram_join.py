"""Exact n-gram Jaccard join by token-combination prefixes.

Two texts link when their sets of ``size``-word shingles (tokens) have a
Jaccard similarity of ``threshold`` or more. The join returns every document's
component (class) of the links.

1. *Sets.* Every document gets its number of tokens and the id of its token
   set; equal sets are one class member from here on.
2. *Sieve.* Tokens in hash order: two linking sets share ``min`` of their
   extensions within prefixes of ``n - ceil(t n) + ext`` tokens (the l-prefix
   rule). Only these prefixes are dealt out, as compact blobs by token range;
   sets whose prefix has too few tokens in common with any other set can link
   with nothing. On ordinary text this leaves the near copies.
3. *Token classes.* For the sets that are left, tokens are counted exactly.
   Tokens in one set only never join; the others are ordered by (frequency,
   hash). Up to ``rare`` sets hold a *rare* token, more hold a *frequent* one.
4. *Combination prefixes.* The prefix of ``n - ceil(t n) + 1`` tokens is
   extended by one token for each of ``g`` parts that the frequent tokens fall
   into by hash. Linking sets share ``1 + g`` tokens of these prefixes: so they
   share a rare token, or two frequent ones of the same part. Rare tokens are
   indexed alone, frequent ones by pairs of a part. ``g`` follows the set's
   size (a set also emits the smaller size's pairs, so partners agree), which
   keeps the number of pairs in proportion to the size.
5. *Verify.* Sets that share a key fall into one cluster; clusters are cut
   into blocks of ``block`` sets and every pair of blocks is one unit of work
   with bounded memory, in which exact intersections decide the links. A unit
   returns a spanning forest of its links, never all pairs.
6. The components of those forests are the classes.

Nothing is capped: long key lists cost no pairs (only the smallest set id per
key is joined back), and large clusters become more units.

Defined results: null, empty and blank texts have no tokens and link with
nothing, not even with each other; fewer words than ``size`` are one token;
repeated rows get a result each; rows that share an id but not the text belong
to the class of their own text; a row without an id gets the class of its text
if a row with an id has an equal one, else null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import bytes_list, gives_back, parts, stored, workers_ready
from feedloom.llm.links import components
from feedloom.llm.shingles import mix, set_id, shingle_sets

SIZE = 5
NUMERATOR, DENOMINATOR = 75, 100
EXTRA = 10                                   # percent of a set by which the sieve's prefix is extended
RARE = 64
BLOCK = 1024
CHUNK_TOKENS = 1_000_000
REF_BITS = 40


class Rule:
    """The threshold as whole numbers."""

    def __init__(self, num: int = NUMERATOR, den: int = DENOMINATOR):
        self.num, self.den = num, den

    def least(self, n):
        """ceil(t n): tokens that a set of n shares with any set it links with."""
        return -(-self.num * n // self.den)

    def spare(self, n):
        return n - self.least(n)

    def extra(self, n):
        return -(-EXTRA * n // 100)

    def sieve_prefix(self, n: int) -> int:
        return min(n, self.spare(n) + self.extra(n))

    def sieve_least(self, n):
        """Shared tokens that a set's sieve prefix must have."""
        return self.extra(self.least(n))

    def links(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)


def level(n: int) -> int:
    return max(0, n.bit_length() - 7)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# -- 1: sets -------------------------------------------------------------------------------------

def token_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, sid) of every row; sid is null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sid = [], []
            for tokens in shingle_sets(bytes_list(b.column(1)), size):
                n.append(len(tokens))
                sid.append(set_id(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64())], names=["id", "n", "sid"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(
        gives_back(run), "id bigint, n bigint, sid bigint")


# -- 2: sieve ------------------------------------------------------------------------------------

def _deal(where: np.ndarray, n_buckets: int, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row per bucket: the columns' values of that bucket as bytes."""
    order = np.argsort(where.astype(np.uint16) if n_buckets <= 65536 else where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    live = np.flatnonzero(np.diff(bounds))
    return pa.RecordBatch.from_arrays(
        [pa.array(live, pa.int32())] + [
            pa.array([c[bounds[k]:bounds[k + 1]].tobytes() for k in live], pa.binary()) for c in columns],
        names=["bucket", *names])


def sieve(docs: DataFrame, id_col: str, text_col: str, size: int, rule: Rule) -> DataFrame:
    """(ref, shared): for every set reference (the low bits of a set id) that
    shares prefix tokens with another set, how many."""
    n_buckets = 2 * parts(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, refs, held = [], [], 0

        def flush():
            t = mix(np.concatenate(tokens) * np.uint64(0xC2B2AE3D27D4EB4F))
            r = np.concatenate(refs)
            return _deal((t >> np.uint64(32)) % np.uint64(n_buckets), n_buckets,
                         [(t & np.uint64(0xFFFFFFFF)).astype("<u4"), (r & np.uint64(0xFFFFFFFF)).astype("<u4"),
                          (r >> np.uint64(32)).astype("u1")], ["tokens", "low", "high"])

        for b in batches:
            for s in shingle_sets(bytes_list(b.column(0)), size):
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in seen:                         # copies within a task are dealt once
                    continue
                seen.add(sid)
                p = s[:rule.sieve_prefix(len(s))]
                tokens.append(p)
                refs.append(np.full(len(p), sid & ((1 << REF_BITS) - 1), dtype=np.uint64))
                held += len(p)
                if held >= CHUNK_TOKENS:
                    yield flush()
                    tokens, refs, held = [], [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _buckets(batches, ("<u4", "<u4", "u1")):
            t, r = cols[0], cols[1].astype(np.uint64) | cols[2].astype(np.uint64) << np.uint64(32)
            order = np.argsort(t, kind="stable")
            t, r = t[order], r[order]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            runs = np.diff(np.append(first, len(t)))
            common = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
            live = np.repeat(common, runs)
            run, r = np.repeat(np.arange(len(first)), runs)[live], r[live]
            order = np.lexsort((r, run))
            run, r = run[order], r[order]
            new = np.concatenate(([True], (run[1:] != run[:-1]) | (r[1:] != r[:-1]))) if len(r) else np.empty(0, bool)
            ref, k = np.unique(r[new], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ref.astype(np.int64), pa.int64()), pa.array(k, pa.int64())], names=["ref", "k"])

    dealt = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(
        gives_back(deal), "bucket int, tokens binary, low binary, high binary")
    counts = _together(dealt, n_buckets).mapInArrow(gives_back(count), "ref bigint, k bigint")
    return counts.groupBy("ref").agg(F.sum("k").alias("shared"))


def _together(dealt: DataFrame, n_buckets: int) -> DataFrame:
    return dealt.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch], types: tuple) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The whole columns of one bucket after the other (rows come sorted by bucket)."""
    now, held = None, [[] for _ in types]
    for b in batches:
        columns = [b.column(k) for k in range(len(types) + 1)]
        for i, bucket in enumerate(columns[0].to_pylist()):
            if bucket != now and now is not None:
                yield now, [np.frombuffer(b"".join(h), dtype=t) for h, t in zip(held, types, strict=True)]
                held = [[] for _ in types]
            now = bucket
            for h, c in zip(held, columns[1:], strict=True):
                h.append(c[i].as_buffer())
    if now is not None:
        yield now, [np.frombuffer(b"".join(h), dtype=t) for h, t in zip(held, types, strict=True)]


# -- 3, 4: token classes and combination prefixes ---------------------------------------------------

def shared_tokens(texts: DataFrame, size: int) -> DataFrame:
    """From (sid, n, t), the texts of the sets left: rows (sid, n, tokens,
    freqs) with the tokens that two or more of these sets hold, in
    (frequency, hash) order, and their frequencies."""
    n_buckets = 2 * parts(texts.sparkSession)
    nb = np.uint64(n_buckets)

    def deal(batches):
        tokens, sids, ns, held = [], [], [], 0

        def flush():
            t = np.concatenate(tokens)
            return _deal(mix(t * np.uint64(0xC2B2AE3D27D4EB4F)) % nb, n_buckets,
                         [t, np.concatenate(sids), np.concatenate(ns)], ["tokens", "sids", "ns"])

        for b in batches:
            for sid, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                 shingle_sets(bytes_list(b.column(2)), size), strict=True):
                if not len(s) or set_id(s) != sid:          # another text under the same id
                    continue
                tokens.append(s)
                sids.append(np.full(len(s), sid, dtype=np.int64))
                ns.append(np.full(len(s), n, dtype="<u4"))
                held += len(s)
                if held >= CHUNK_TOKENS:
                    yield flush()
                    tokens, sids, ns, held = [], [], [], 0
        if held:
            yield flush()

    def count(batches):
        for _, (t, sid, n) in _buckets(batches, ("<u8", "<i8", "<u4")):
            order = np.lexsort((sid, t))
            t, sid, n = t[order], sid[order], n[order]
            once = np.concatenate(([True], (t[1:] != t[:-1]) | (sid[1:] != sid[:-1])))     # repeated rows
            t, sid, n = t[once], sid[once], n[once]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            runs = np.diff(np.append(first, len(t)))
            freq = np.repeat(runs, runs)
            live = freq >= 2
            t, sid, n, freq = t[live], sid[live], n[live], freq[live]
            for a in range(0, len(t), CHUNK_TOKENS):
                z = slice(a, a + CHUNK_TOKENS)
                yield _deal(sid[z].view(np.uint64) % nb, n_buckets,
                            [t[z], sid[z], n[z], freq[z].astype("<u4")], ["tokens", "sids", "ns", "freqs"])

    def regroup(batches):
        for _, (t, sid, n, freq) in _buckets(batches, ("<u8", "<i8", "<u4", "<u4")):
            order = np.lexsort((t, freq, sid))
            t, sid, n, freq = t[order], sid[order], n[order], freq[order]
            first = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
            ends = np.append(first, len(t))[1:]
            for a in range(0, len(first), 500):
                rows = range(a, min(a + 500, len(first)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(sid[first[k]]) for k in rows], pa.int64()),
                     pa.array([int(n[first[k]]) for k in rows], pa.int64()),
                     pa.array([t[first[k]:ends[k]].tobytes() for k in rows], pa.binary()),
                     pa.array([freq[first[k]:ends[k]].tobytes() for k in rows], pa.binary())],
                    names=["sid", "n", "tokens", "freqs"])

    dealt = texts.select("sid", "n", "t").mapInArrow(gives_back(deal), "bucket int, tokens binary, sids binary, ns binary")
    counted = _together(dealt, n_buckets).mapInArrow(
        gives_back(count), "bucket int, tokens binary, sids binary, ns binary, freqs binary")
    return _together(counted, n_buckets).mapInArrow(gives_back(regroup), "sid bigint, n bigint, tokens binary, freqs binary")


def prefix_keys(n: int, tokens: np.ndarray, freqs: np.ndarray, rule: Rule, rare: int = RARE) -> np.ndarray:
    """The index keys of a set: ``tokens`` are its shared tokens in
    (frequency, hash) order; the n - len(tokens) others come before them."""
    lonely = n - len(tokens)
    if len(tokens) < rule.least(n):             # too few tokens that any other set holds
        return np.empty(0, dtype=np.uint64)
    levels = range(level(max(1, rule.least(n))), level(n) + 1)
    longest = min(n, rule.spare(n) + 1 + (1 << levels[-1]))
    prefix = tokens[:max(0, longest - lonely)]
    common = freqs[:len(prefix)] > rare
    keys = [prefix[~common]]
    for lev in levels:
        g = 1 << lev
        reach = max(0, min(n, rule.spare(n) + 1 + g) - lonely)
        often = prefix[:reach][common[:reach]]
        part = mix(often + np.uint64(0x632BE59BD9B4E019)) & np.uint64(g - 1)
        for p in np.unique(part):
            own = np.sort(often[part == p])
            i, j = np.triu_indices(len(own), 1)
            keys.append(mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + mix(own[j]) + np.uint64(lev)))
    return np.unique(np.concatenate(keys))


def index_entries(sets: DataFrame, rule: Rule, rare: int = RARE) -> DataFrame:
    """(key, sid) of every set."""
    def run(batches):
        for b in batches:
            keys, sids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for sid, n, t, f in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                k = prefix_keys(n, np.frombuffer(t, "<u8"), np.frombuffer(f, "<u4"), rule, rare)
                keys.append(k)
                sids.append(np.full(len(k), sid, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys)), pa.int64()), pa.array(np.concatenate(sids), pa.int64())],
                names=["key", "sid"])

    return sets.select("sid", "n", "tokens", "freqs").mapInArrow(gives_back(run), "key bigint, sid bigint")


# -- 5: verify -----------------------------------------------------------------------------------

def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of distinct tokens. Tokens that
    many sets hold go through a matrix product, the others pair by pair."""
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    ta, tb = np.concatenate(left), np.concatenate(right)
    ra = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rb = np.repeat(np.arange(len(right)), [len(x) for x in right])
    vocab, ia = np.unique(ta, return_inverse=True)
    at = np.searchsorted(vocab, tb)
    at[at == len(vocab)] = 0
    known = vocab[at] == tb if len(vocab) else np.zeros(len(tb), bool)
    ib, rb = at[known], rb[known]
    ca, cb = np.bincount(ia, minlength=len(vocab)), np.bincount(ib, minlength=len(vocab))
    dense = np.flatnonzero(ca * cb > 256)
    column = np.full(len(vocab), -1)
    column[dense] = np.arange(len(dense))
    da, db = column[ia], column[ib]
    for a in range(0, len(dense), 2048):
        width = min(2048, len(dense) - a)
        ma, mb = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        pick = (da >= a) & (da < a + width)
        ma[ra[pick], da[pick] - a] = 1
        pick = (db >= a) & (db < a + width)
        mb[rb[pick], db[pick] - a] = 1
        out += (ma @ mb.T).astype(np.int32)
    # The rest: every occurrence on the left meets those on the right.
    pick = db < 0
    order = np.argsort(ib[pick], kind="stable")
    sb, wb = rb[pick][order], ib[pick][order]
    pick = da < 0
    wa, sa = ia[pick], ra[pick]
    lo, hi = np.searchsorted(wb, wa, "left"), np.searchsorted(wb, wa, "right")
    for a in range(0, len(wa), 200_000):
        z = slice(a, a + 200_000)
        count = hi[z] - lo[z]
        rows = np.repeat(sa[z], count)
        cols = sb[np.repeat(lo[z] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        out += np.bincount(rows * len(right) + cols, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def forest(ids_a: list[int], ids_b: list[int], linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between two lists of nodes."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(ids_a):
        for j in np.flatnonzero(linked[i]).tolist():
            x, y = find(a), find(ids_b[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield a, ids_b[j]


def verified(members: DataFrame, rule: Rule, block: int = BLOCK, count: bool = False) -> DataFrame:
    """(a, b): spanning forests of the links within clusters. ``members`` are
    rows (cluster, sid, n, tokens). With ``count`` they also have ``docs``, the
    documents of each set, and (a, null, links) rows follow: every pair of sets
    is looked at once, and there each side adds up the documents of the sets
    that it is linked with."""
    spark = members.sparkSession
    last = ["docs"] if count else []
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    units = (members.join(sizes, "cluster").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                     "sid", "n", "tokens", *last))

    def check(rows: list[tuple]) -> Iterator[tuple]:
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return
        na, nb = np.array([r[5] for r in left]), np.array([r[5] for r in right])
        inter = intersections([r[6] for r in left], [r[6] for r in right])
        linked = rule.links(inter, na[:, None], nb[None, :])
        if i == j:
            linked = np.triu(linked, 1)
        yield from forest([r[4] for r in left], [r[4] for r in right], linked)
        if count:
            sides = [(left, linked @ np.array([r[7] for r in right])), (right, np.array([r[7] for r in left]) @ linked)]
            yield from ((r[4], None, int(c)) for side, sums in sides for r, c in zip(side, sums) if c)

    def run(batches):
        group, now, found = [], None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if len(group) > 1:
                        found.extend(check(group))
                    group, now = [], row[:3]
                group.append((*row[:6], np.frombuffer(row[6], "<u8"), *row[7:]))
            if len(found) > 10_000:
                yield _edges(found, count)
                found = []
        if len(group) > 1:
            found.extend(check(group))
        yield _edges(found, count)

    return (units.repartition(parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "sid")
            .mapInArrow(gives_back(run), "a bigint, b bigint" + (", links bigint" if count else "")))


def _edges(found: list[tuple], count: bool = False) -> pa.RecordBatch:
    columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
    if count:
        columns.append(pa.array([f[2] if len(f) > 2 else None for f in found], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"][:len(columns)])


# -- the join ------------------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       num: int = NUMERATOR, den: int = DENOMINATOR, rare: int = RARE, block: int = BLOCK,
                       count_links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``; with
    ``count_links`` also ``n_links``, the rows with an id that it is linked
    with (those of an equal set among them, itself not)."""
    workers_ready(docs.sparkSession)
    rule = Rule(num, den)
    rows = stored(token_sets(docs, id_col, text_col, size), "token-sets")
    # One document stands for each distinct set.
    held = rows.where("sid is not null and id is not null").groupBy("sid")
    sets = held.agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    ref = F.col("sid").bitwiseAND(F.lit((1 << REF_BITS) - 1))
    n = F.col("n")
    least = -F.floor(-n * num / den)
    few = -F.floor(-least * EXTRA / 100)
    left = stored(sets.withColumn("ref", ref).join(sieve(docs, id_col, text_col, size, rule), "ref")
                  .where(F.col("shared") >= few).select("rep", "sid", "n"), "sieved")
    texts = (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("rep"), F.col(f"`{text_col}`").alias("t"))
             .join(left.hint("merge"), "rep").select("sid", "n", "t"))       # the sets left follow the input: no broadcast
    tokens = stored(shared_tokens(texts, size), "shared-tokens")
    entries = stored(index_entries(tokens, rule, rare), "index")
    heads = entries.groupBy("key").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = entries.join(heads, "key").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    clusters = components(near)
    members = (clusters.withColumnRenamed("node", "sid").withColumnRenamed("root", "cluster")
               .join(tokens.select("sid", "n", "tokens"), "sid"))
    if count_links:
        copies = held.agg(F.count(F.lit(1)).alias("docs"))
        checked = stored(verified(members.join(copies, "sid"), rule, block, count=True), "verified")
        links = (checked.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("near")))
        rows = rows.join(copies.join(links, "sid", "left").select(
            "sid", (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "sid", "left")
        edges = checked.where("b is not null").select("a", "b")
    else:
        edges = verified(members, rule, block)
    classes = components(edges).withColumnRenamed("node", "sid")
    # The smallest id of a class names it.
    named = rows.join(classes, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    firsts = named.where("root is not null").groupBy("root").agg(F.min("id").alias("first"))
    more = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if count_links else []
    return named.join(firsts, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"), *more)


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents without their near copies: of each component exactly one
    row stays, that of the smallest id (rows without an id come last), all
    columns kept. Every row is a document of its own, also where ids repeat."""
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-rows")
    found = jaccard_components(keyed.select(row, F.col(f"`{text_col}`").alias("t")), id_col=row, text_col="t", **kw)
    number = F.col(f"`{id_col}`")
    stay = (found.select(row, "component_id").join(keyed.select(row, number.alias("id")), row).groupBy("component_id")
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("first"))
            .select(F.col(f"first.{row}").alias(row)))
    return keyed.join(stay, row, "left_semi").drop(row)
