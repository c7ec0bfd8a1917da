"""Long repeated passages by a run-length index.

A byte is removed when it lies in a string of ``length`` bytes that starts
anywhere else too, in the same document or another. Strings are judged on the
input; matches never cross documents.

1. *Anchors.* In every window of ``length`` bytes the ``gram``-byte string of
   the smallest hash is its anchor (leftmost of equals). Equal windows have
   equal anchors at equal places. The windows of one anchor are consecutive;
   the bytes that they cover are the anchor's context (at most
   ``2 * length - gram`` bytes). So every window lies in one context, and can
   only be repeated in a context of an equal anchor.
2. *Classes.* Contexts meet by anchor. Contexts of the same bytes that occur
   twice are repeated as a whole; copies within a task are found there and sent
   once, so the copies of a hot passage collapse before the shuffle. Anchors
   that occur once drop out. What is left are contexts that occur once but
   share their anchor with other contexts: the borders of passages and the
   surroundings of edits.
3. *Run-length index.* These contexts (and one of each repeated class beside
   them) are dealt by anchor and indexed in batches of whole anchors: suffix
   order, Burrows-Wheeler transform, its runs, and for each run the suffixes at
   its two ends with their common lengths with the neighbours across the
   border. Between run borders a match just gets shorter by one per byte, so
   streaming over the text from the sampled run ends alone gives the matching
   statistics: at each byte the longest match that starts there and occurs
   elsewhere in the batch. Windows where it is ``length`` or more are marked.
   An anchor whose contexts exceed a batch is *hot*: its contexts are spread
   over the tasks and their windows meet by hash instead (step 2 with windows
   for contexts), so no task ever holds all contexts of one anchor.
4. The marked windows of a document are merged and its other bytes kept.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; repeated rows of one id are documents of their own when they carry
different texts, and equal ones repeat each other (all get the same result);
rows without an id likewise (the null stays); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import bytes_list, parts, stored, workers_ready
from feedloom.llm.shingles import POWERS, mix, prefix_sums

LENGTH = 400
GRAM = 240
SLICE = 4 << 20
BATCH_BYTES = 2 << 20
PLACE_BITS = 24


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every whole window."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


class Contexts:
    """The contexts of a piece of text: anchor keys, content hashes, bounds."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int, gram: int):
        """``ends``: for each byte the end of its document within ``data``."""
        n, w = len(data), length - gram + 1
        empty = np.empty(0, dtype=np.int64)
        self.start = self.end = empty
        self.key = self.content = empty.astype(np.uint64)
        if n < length:
            return
        sums = prefix_sums(data)
        _, down = POWERS.upto(n + 1)
        at = np.arange(n - gram + 1)
        grams = mix((sums[gram:] - sums[:n - gram + 1]) * down[:n - gram + 1])
        place = np.uint64((1 << PLACE_BITS) - 1)
        best = sliding_min((mix(grams ^ np.uint64(0xA5A5)) & ~place) | at.astype(np.uint64), w)
        anchor = (best & place).astype(np.int64)
        s = np.flatnonzero(np.arange(len(best)) + length <= ends[:len(best)])     # windows within a document
        if not len(s):
            return
        anchor = anchor[s]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        self.start, self.end = s[first], s[last] + length
        self.key = grams[anchor[first]]
        self.content = mix((sums[self.end] - sums[self.start]) * down[self.start]
                           + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(ids: list, texts: list, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document ends, document ids, offsets in the document) of
    bounded pieces of the texts; a very long text comes in several pieces
    that overlap by all but one byte of a window."""
    group, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(t for _, t, _ in group), dtype=np.uint8)
        lengths = np.array([len(t) for _, t, _ in group])
        stops = np.cumsum(lengths)
        return (data, np.repeat(stops, lengths), np.repeat(np.array([i for i, _, _ in group], dtype=np.int64), lengths),
                np.arange(len(data)) - np.repeat(stops - lengths, lengths)
                + np.repeat(np.array([o for _, _, o in group], dtype=np.int64), lengths))

    for i, t in zip(ids, texts, strict=True):
        if not t or len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, SLICE):
            part = t[a:a + SLICE + length - 1]
            group.append((i, part, a))
            size += len(part)
            if size >= SLICE:
                yield flush()
                group, size = [], 0
    if group:
        yield flush()


# -- 1, 2: anchors and classes -----------------------------------------------------------------------

_DEALT = "bucket int, kind int, keys binary, contents binary, docs binary, starts binary, ends binary, marked binary"
_FOUND = "kind int, key bigint, doc bigint, start bigint, stop bigint"
SPAN, LONE, TWIN = 0, 1, 2        # a repeated context; one to look at; a repeated one beside such


def dealt(where: np.ndarray, n_buckets: int, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: keys, contents, docs, starts, ends and marks of that bucket as bytes."""
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(n_buckets + 1))
    live = np.flatnonzero(np.diff(bounds))
    key, content, doc, start, end, marked = columns
    cols = [key, content, doc, start.astype("<i8"), end.astype("<i8"), marked.astype("u1")]
    cols = [c[order] for c in cols]
    return pa.RecordBatch.from_arrays(
        [pa.array(live, pa.int32()), pa.array(np.full(len(live), kind), pa.int32())]
        + [pa.array([c[bounds[b]:bounds[b + 1]].tobytes() for b in live], pa.binary()) for c in cols],
        names=["bucket", "kind", "keys", "contents", "docs", "starts", "ends", "marked"])


def dealt_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    d, a, b = merged(doc, start, end)
    zero = np.zeros(len(d), np.uint64)
    return dealt(d.view(np.uint64) % np.uint64(n_buckets), n_buckets, SPAN, [zero, zero, d, a, b, zero])


def collapse(held: list[tuple], n_buckets: int, by_content: bool = False) -> Iterator[pa.RecordBatch]:
    """(key, content, doc, start, end) arrays of a task, dealt by key (or by
    content): those that meet their like within the task come out as spans, and
    one of each goes on, marked."""
    key, content, doc, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((content, key))
    key, content, doc, start, end = key[order], content[order], doc[order], start[order], end[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(key))) > 1
    inside = np.repeat(twice, np.diff(np.append(first, len(key))))
    if inside.any():                       # repeated within the task: spans, merged per document
        yield dealt_spans(doc[inside], start[inside], end[inside], n_buckets)
    where = mix(content[first] if by_content else key[first]) % np.uint64(n_buckets)
    yield dealt(where, n_buckets, LONE, [key[first], content[first], doc[first], start[first], end[first], twice])


def settle(batches: Iterator[pa.RecordBatch], spans_only: bool = False) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def out(kind, key, doc, start, end):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind), pa.int32()), pa.array(key.view(np.int64), pa.int64()),
             pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
            names=["kind", "key", "doc", "start", "stop"])

    def flush():
        key, content, doc, start, end, marked = (
            np.frombuffer(b"".join(x), dtype=t)
            for x, t in zip(zip(*held, strict=True), ("<u8", "<u8", "<i8", "<i8", "<i8", "u1"), strict=True))
        order = np.lexsort((content, key))
        key, content, doc, start, end, marked = (x[order] for x in (key, content, doc, start, end, marked))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], content[1:] != content[:-1]))
        cls, grp = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        many = (np.bincount(cls) > 1) | (np.bincount(cls, weights=marked) > 0)        # classes that occur twice
        wide = np.bincount(grp[np.flatnonzero(new)]) > 1                               # anchors of several classes
        repeated = many[cls]
        todo = repeated & (marked == 0)
        if todo.any():
            d, a, b = merged(doc[todo], start[todo], end[todo])
            yield out(SPAN, np.zeros(len(d), np.uint64), d, a, b)
        lone = ~repeated & wide[grp]
        if lone.any() and not spans_only:
            yield out(LONE, key[lone], doc[lone], start[lone], end[lone])
            asked = np.bincount(grp[lone], minlength=len(wide)) > 0
            twin = new & repeated & asked[grp]
            yield out(TWIN, key[twin], doc[twin], start[twin], end[twin])

    for b in batches:
        columns = [b.column(k) for k in range(8)]
        for i, (bucket, kind) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
            blobs = [c[i].as_buffer() for c in columns[2:]]
            if kind == SPAN:
                yield out(SPAN, *(np.frombuffer(blobs[k], t) for k, t in ((0, "<u8"), (2, "<i8"), (3, "<i8"), (4, "<i8"))))
                continue
            if bucket != now and held:
                yield from flush()
                held = []
            now = bucket
            held.append(blobs)
    if held:
        yield from flush()


def classes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """From (doc, t): rows (kind, key, doc, start, stop)."""
    n_buckets = 2 * parts(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            for data, ends, ids, places in pieces(b.column(0).to_pylist(), bytes_list(b.column(1)), length):
                c = Contexts(data, ends, length, gram)
                if len(c.start):
                    held.append((c.key, c.content, ids[c.start], places[c.start], places[c.end - 1] + 1))
                    size += len(c.start)
                if size > 400_000:
                    yield from collapse(held, n_buckets)
                    held, size = [], 0
        if held:
            yield from collapse(held, n_buckets)

    return (docs.mapInArrow(deal, _DEALT).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
            .mapInArrow(settle, _FOUND))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans merged per document where they touch or overlap."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    _, number = np.unique(doc, return_inverse=True)
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * wide) - number * wide
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


# -- 3: the run-length index ---------------------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more (0 ..
    256, nine bits each), ties by position. Prefix doubling; only suffixes
    whose place is still open are sorted again."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(8, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = (key << 9) | wide[k:k + n]
    order = np.argsort(key, kind="stable")
    sk = key[order]
    first = np.concatenate(([True], sk[1:] != sk[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = start + 1, 0
    size = np.diff(np.append(np.flatnonzero(first), n))
    open_ = order[np.repeat(size, size) > 1]
    h = 7
    while h < depth and len(open_):
        nxt = np.minimum(open_ + h, n)
        key = rank[open_] * (n + 2) + rank[nxt]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        sub = np.maximum.accumulate(np.where(first, at, 0))
        rank[open_] = old + (sub - group)
        size = np.diff(np.append(np.flatnonzero(first), len(open_)))
        open_ = open_[np.repeat(size, size) > 1]
        h *= 2
    return np.argsort(rank[:n], kind="stable")


def common_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most ``most``."""
    n = len(text)
    sums = prefix_sums(text)
    _, down = POWERS.upto(n + 1)
    low, high = np.zeros(len(a), dtype=np.int64), np.minimum(most, n - np.maximum(a, b))
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform with sampled run ends."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        stops = self.starts + lengths
        data[stops] = 0                                        # text ends sort before all bytes
        self.text = data
        self.left = np.repeat(stops, lengths + 1) - np.arange(len(data))     # bytes to the text's end
        depth = int(lengths.max()) + 1
        order = suffix_order(data, depth)
        bwt = data[order - 1]                                  # the symbol before each suffix (cyclic)
        # Every text has an end of its own, so the symbol before a text's first
        # byte differs from any other: its suffix is a border by itself.
        border = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)) + 1
        # Kept: the runs, and the suffixes at both ends of each with the
        # common length across the border.
        self.run_symbols = bwt[np.concatenate(([0], border))]
        self.run_starts = np.concatenate(([0], border))
        self.head, self.tail = order[border], order[border - 1]
        self.across = common_lengths(data, self.head, self.tail, depth)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest string that starts
        there and also elsewhere, within its text: a stream over the text that
        falls by one per symbol and is lifted at the sampled run ends."""
        n = len(self.text)
        lift = np.zeros(n, dtype=np.int64)
        at = np.arange(n)
        for ends in (self.head, self.tail):
            np.maximum.at(lift, ends, self.across + ends)      # where the sampled match ends
        return np.minimum(np.maximum(np.maximum.accumulate(lift) - at, 0), self.left)


def index_marks(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context the merged spans of its windows that occur elsewhere
    in the batch."""
    index = RunLengthIndex(contexts)
    hit = index.matching_statistics() >= length
    out = []
    for a, t in zip(index.starts.tolist(), contexts, strict=True):
        s = np.flatnonzero(hit[a:a + len(t)])
        if not len(s):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(s) > length) + 1
        out.append([(int(x[0]), int(x[-1]) + length) for x in np.split(s, cut)])
    return out


def windows_of(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """(key, content, doc, start, end) of every window of the contexts (key, kind, doc, start, text, hot)."""
    texts = [r[4] for r in rows]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sums = prefix_sums(data)
    _, down = POWERS.upto(len(data) + 1)
    count = np.maximum(sizes - length + 1, 0)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + inside
    start = np.repeat(np.array([r[3] for r in rows], dtype=np.int64), count) + inside
    return (np.repeat(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), count),
            mix((sums[at + length] - sums[at]) * down[at]),
            np.repeat(np.array([r[2] for r in rows], dtype=np.int64), count), start, start + length)


def mark(batches: Iterator[pa.RecordBatch], length: int, batch_bytes: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans and windows, dealt, of sorted (key, kind, doc, start, text, hot) rows."""
    held, size, last = [], 0, None
    crowd, crowd_size = [], 0                               # contexts of hot anchors

    def flush():
        doc, start, stop = [], [], []
        for (_, kind, d, s, _, _), spans in zip(held, index_marks([h[4] for h in held], length), strict=True):
            if kind == LONE:
                for a, b in spans:
                    doc.append(d)
                    start.append(s + a)
                    stop.append(s + b)
        yield dealt_spans(*(np.array(x, dtype=np.int64) for x in (doc, start, stop)), n_buckets)

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if row[5]:
                crowd.append(row)
                crowd_size += len(row[4])
                if crowd_size >= batch_bytes:
                    yield from collapse([windows_of(crowd, length)], n_buckets, by_content=True)
                    crowd, crowd_size = [], 0
                continue
            if size >= batch_bytes and row[0] != last:      # only between anchors
                yield from flush()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield from flush()
    if crowd:
        yield from collapse([windows_of(crowd, length)], n_buckets, by_content=True)


def indexed_spans(docs: DataFrame, found: DataFrame, length: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc, start, stop) of the repeated windows in contexts that occur once."""
    spark = docs.sparkSession
    n_buckets = 2 * parts(spark)
    found = found.where(F.col("kind") != SPAN)
    hot = found.groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("size")).where(
        F.col("size") > batch_bytes).select("key", F.lit(True).alias("hot"))
    # Broadcast: one key at most for every ``batch_bytes`` of contexts.
    asked = (found.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).groupBy("doc")
             .agg(F.collect_list(F.struct("key", "kind", "start", "stop", "hot")).alias("asked")))   # bounded by the text's length

    def cut(batches):
        for b in batches:
            key, kind, doc, start, text, hot = [], [], [], [], [], []
            for d, t, rows in zip(b.column(0).to_pylist(), bytes_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                for r in rows:
                    if t is not None and r["stop"] <= len(t):
                        key.append(r["key"])
                        kind.append(r["kind"])
                        doc.append(d)
                        start.append(r["start"])
                        text.append(t[r["start"]:r["stop"]])
                        hot.append(r["hot"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()),
                 pa.array(start, pa.int64()), pa.array(text, pa.binary()), pa.array(hot, pa.bool_())],
                names=["key", "kind", "doc", "start", "text", "hot"])

    contexts = docs.join(asked.hint("merge"), "doc").select("doc", "t", "asked").mapInArrow(
        cut, "key bigint, kind int, doc bigint, start bigint, text binary, hot boolean")
    spread = F.when(F.col("hot"), F.xxhash64("doc", "start")).otherwise(F.lit(0))       # only hot anchors are parted
    return (contexts.withColumn("spread", spread).repartition(parts(spark), "key", "spread")
            .select("key", "kind", "doc", "start", "text", "hot").sortWithinPartitions("key", "doc", "start")
            .mapInArrow(lambda batches: mark(batches, length, batch_bytes, n_buckets), _DEALT).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
            .mapInArrow(lambda batches: settle(batches, spans_only=True), _FOUND).select("doc", "start", "stop"))


# -- 4: what is kept -----------------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, keep_text: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of every row."""
    spark = docs.sparkSession
    workers_ready(spark)
    number = F.col(f"`{id_col}`").cast("bigint")
    # A row's key comes from its id and text: the same at every reading, and never null.
    rows = docs.select(number.alias("id"), F.xxhash64(number.isNull(), number, F.col(f"`{text_col}`")).alias("doc"),
                       F.col(f"`{text_col}`").alias("t"))
    found = stored(classes(rows.select("doc", "t"), length, gram), "repeat-classes")
    marks = stored(indexed_spans(rows.select("doc", "t"), found, length, batch_bytes), "repeat-marks")
    spans = (found.where(F.col("kind") == SPAN).select("doc", "start", "stop").unionByName(marks)
             .groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))    # bounded by the text's length

    def finish(batches):
        for b in batches:
            n, removed, count, digest, texts, kept_spans = [], [], [], [], [], []
            for t, rows_ in zip(bytes_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                t = t or b""
                a = np.array([r["start"] for r in rows_ or []], dtype=np.int64)
                e = np.array([r["stop"] for r in rows_ or []], dtype=np.int64)
                _, a, e = merged(np.zeros(len(a), dtype=np.int64), a, e)
                kept, at = [], 0
                for x, y in zip(a.tolist(), e.tolist(), strict=True):
                    kept.append(t[at:x])
                    at = y
                kept = b"".join([*kept, t[at:]])
                n.append(len(t))
                removed.append(len(t) - len(kept))
                count.append(len(a))
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if keep_text else None)
                kept_spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                                  if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(texts, pa.binary()),
                 pa.array(kept_spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    out = (rows.join(spans.hint("merge"), "doc", "left").select("id", "t", "spans")
           .mapInArrow(finish, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                               "kept_sha256 string, kept binary, spans array<struct<start:bigint,stop:bigint>>"))
    return out if keep_text else out.drop("kept", "spans")
