"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``window`` consecutive words of a benchmark item
(an item of fewer words is one window). Documents are searched with the
Wu-Manber scheme, a "character" being a word and a block two words:

* the shift table says for the block that ends at the current position how far
  the search may jump without passing a test string (``window - 1`` words for
  a block that no test string holds);
* a block of shift 0 ends some test string; its bucket lists the strings that
  end so;
* direct comparison of the words confirms an occurrence.

Test strings of each length have tables of their own, so a short item never
shortens the jumps of the others. The tables go to the tasks in blocks of at
most ``max_block_words`` words of items: a benchmark of any size is searched
exactly, block after block, and what travels with a task is bounded.

Defined results: a null or empty text (or one without words) has no words and
is never contaminated; null and wordless items match nothing; repeated items
count under each of their ids; repeated document rows give repeated result
rows; other columns of either table are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import bytes_list, gives_back, workers_ready

# A word is a run of a-z, 0-9 and bytes above ASCII; A-Z count as a-z.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
WINDOW = 10
MAX_BLOCK_WORDS = 2_000_000


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; null has none."""
    return data.translate(WORD_BYTES).split() if data else []


class WuManber:
    """Tables for test strings of one length ``m`` (in words)."""

    def __init__(self, m: int, strings: dict[tuple[bytes, ...], tuple]):
        self.m = m
        self.block = min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for s, ids in strings.items():
            for end in range(self.block, m + 1):
                key = s[end - 1] if self.block == 1 else (s[end - 2], s[end - 1])
                jump = m - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
            key = s[-1] if self.block == 1 else (s[-2], s[-1])
            self.bucket.setdefault(key, []).append((s, ids))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, item ids) of every occurrence."""
        m, get, default, n = self.m, self.shift.get, self.default, len(words)
        i = m - 1
        if self.block == 1:
            while i < n:
                if words[i] in self.shift:
                    for _, ids in self.bucket[words[i]]:
                        yield i, ids
                i += 1
            return
        while i < n:
            key = (words[i - 1], words[i])
            jump = get(key, default)
            if jump:
                i += jump
                continue
            here = tuple(words[i - m + 1:i + 1])
            for s, ids in self.bucket[key]:
                if s == here:
                    yield i - m + 1, ids
            i += 1


def tables_for(items: list[tuple], window: int) -> list[WuManber]:
    """Search tables of (item_id, text bytes) pairs."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, data in items:
        words = words_of(data)
        m = min(window, len(words))
        if m:
            strings = by_length.setdefault(m, {})
            for i in range(len(words) - m + 1):
                strings.setdefault(tuple(words[i:i + m]), set()).add(item)
    return [WuManber(m, {s: tuple(ids) for s, ids in strings.items()}) for m, strings in sorted(by_length.items())]


def find(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged [start, end) word spans that test strings cover, and the items found."""
    found, items = [], set()
    for t in tables:
        for start, ids in t.search(words):
            found.append((start, start + t.m))
            items.update(ids)
    spans: list[list[int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans], items


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> list[list[tuple]]:
    """The items in blocks of bounded size. Items stream to the driver one
    partition at a time and are cut into blocks as they come."""
    blocks: list[list[tuple]] = []
    size = max_words + 1
    rows = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.encode(F.col(f"`{text_col}`"), "UTF-8").alias("t"))
    for r in rows.toLocalIterator():
        data = bytes(r.t) if r.t is not None else None
        n = len(words_of(data))
        if not n:
            continue
        if size + n > max_words or not blocks:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, data))
        size += n
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """One row per document row: id, ``n_words``, ``spans`` (merged word spans
    that test strings cover), ``n_hit`` (words in them) and ``items`` (ids of
    the items found, in ascending order as strings)."""
    spark = docs.sparkSession
    workers_ready(spark)
    blocks = _item_blocks(benchmark, item_col, item_text_col, max_block_words) or [[]]
    id_type = dict(docs.dtypes)[id_col]
    out_schema = (f"`{id_col}` {id_type}, n_words bigint, spans array<struct<start:int,end:int>>, "
                  "n_hit bigint, items array<string>")
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    if len(blocks) == 1:
        return rows.mapInArrow(gives_back(_searcher(blocks[0], window)), out_schema)
    # More than one block: the hits of a row meet again by a row key.
    from feedloom.llm.common import stored
    keyed = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    found = None
    for block in blocks:
        part = keyed.select("_row", "_text").mapInArrow(
            gives_back(_searcher(block, window)), out_schema.replace(f"`{id_col}` {id_type}", "_row bigint"))
        found = part if found is None else found.unionByName(part)
    merged = (found.groupBy("_row")
              .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    merge = F.aggregate(
        F.array_sort("s"), F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["start"].alias("start"),
                                  F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    merged = merged.withColumn("spans", F.when(F.size("s") > 0, merge).otherwise(F.col("s")))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["end"] - x["start"]))
    return (keyed.select("_row", f"`{id_col}`").join(merged, "_row")
            .select(f"`{id_col}`", "n_words", "spans", hit.alias("n_hit"), "items"))


def _searcher(items: list[tuple], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_for(items, window)
        for batch in batches:
            n_words, spans, n_hit, found = [], [], [], []
            for data in bytes_list(batch.column(1)):
                words = words_of(data)
                s, ids = find(words, tables)
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                n_hit.append(sum(b - a for a, b in s))
                found.append(sorted(map(str, ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN),
                 pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                names=[batch.schema.names[0], "n_words", "spans", "n_hit", "items"])
    return run


def items_digest(items):
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256)


def digest_of(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold no test string, all columns kept. Rows are
    searched in place and dropped where found; nothing is joined."""
    spark = docs.sparkSession
    workers_ready(spark)
    text = kw.get("text_col", "text")
    blocks = _item_blocks(benchmark, kw.get("item_col", "item_id"), kw.get("item_text_col", "text"),
                          kw.get("max_block_words", MAX_BLOCK_WORDS))
    window = kw.get("window", WINDOW)
    out = docs
    for block in blocks:
        out = out.mapInArrow(gives_back(_keeper(block, window, docs.columns.index(text))), docs.schema)
    return out


def _keeper(items: list[tuple], window: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_for(items, window)
        for batch in batches:
            keep = [not any(True for t in tables for _ in t.search(words_of(d))) if d else True
                    for d in bytes_list(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run
