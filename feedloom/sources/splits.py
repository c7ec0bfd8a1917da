"""Items of feed files, each file read by many tasks.

A file is cut into byte ranges. Where a range begins, a reader cannot know
whether it stands in text, in a CDATA section, a comment or a processing
instruction: so each range is first scanned under each of the four
assumptions, which gives the state behind it and the number of items that
begin in it. A running pass over the ranges of a file, in order, then knows
the true state and the number of items before every range, and a second scan
cuts the items out. Ranges begin at a ``<``, so no mark is ever cut in two;
an item belongs to the range it begins in, whose task reads on to its end.

What a task holds is a range, and the stretch without a ``<`` or the item
behind it; between tasks only one narrow row for each range is moved."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import ship_package

SPLIT_BYTES = 16 * 1024 * 1024
STEP = 256 * 1024

TEXT, CDATA, COMMENT, INSTRUCTION = range(4)
_CLOSE = {CDATA: b"]]>", COMMENT: b"-->", INSTRUCTION: b"?>"}
_OPEN = {b"<![CDATA[": CDATA, b"<!--": COMMENT, b"<?": INSTRUCTION}
_MARK = re.compile(rb"<!\[CDATA\[|<!--|<\?|<item(?=[\s/>])")
_INSIDE = re.compile(rb"<!\[CDATA\[|<!--|<\?|<item(?=[\s/>])|</item\s*>|</channel\s*>")
_TAG = re.compile(rb"<item(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")


def scan(data: bytes, state: int) -> tuple[int, list[int]]:
    """(state behind ``data``, places where an item begins) for the state before it."""
    at, items = 0, []
    while True:
        if state != TEXT:
            end = data.find(_CLOSE[state], at)
            if end < 0:
                return state, items
            at, state = end + len(_CLOSE[state]), TEXT
        mark = _MARK.search(data, at)
        if mark is None:
            return TEXT, items
        at, state = mark.end(), _OPEN.get(mark.group(), TEXT)
        if state == TEXT:
            items.append(mark.start())


def item_end(data: bytes, start: int) -> tuple[int, bool] | None:
    """(end, whether it is finished) of the item at ``start``; None when
    ``data`` ends before that can be told."""
    tag = _TAG.match(data, start)
    if tag is None:
        return None
    if tag.group().endswith(b"/>"):
        return tag.end(), True
    at = tag.end()
    while True:
        mark = _INSIDE.search(data, at)
        if mark is None:
            return None
        state = _OPEN.get(mark.group(), TEXT)
        if state == TEXT:                                  # the next item or the channel's end: this one is unfinished
            return (mark.end(), True) if mark.group().startswith(b"</item") else (mark.start(), False)
        end = data.find(_CLOSE[state], mark.end())
        if end < 0:
            return None
        at = end + len(_CLOSE[state])


class Bytes:
    """Byte ranges of a file on any file system that pyarrow opens."""

    def __init__(self, path: str):
        from pyarrow import fs
        if path.startswith("file:"):
            path = re.sub(r"^file:/*", "/", path)
        if "://" in path:
            system, path = fs.FileSystem.from_uri(path)
        else:
            system = fs.LocalFileSystem()
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        return self.file.read_at(stop - start, start) if stop > start else b""

    def mark_from(self, start: int, stop: int) -> int | None:
        """The first ``<`` in [start, stop)."""
        while start < min(stop, self.size):
            piece = self.read(start, min(start + STEP, stop))
            at = piece.find(b"<")
            if at >= 0:
                return start + at
            start += len(piece)
        return None

    def bounds(self, start: int, stop: int) -> tuple[int, int] | None:
        """From the first ``<`` of a range to the first one behind it."""
        first = 0 if start == 0 else self.mark_from(start, stop)
        if first is None:
            return None
        last = self.size if stop >= self.size else self.mark_from(stop, self.size)
        return first, self.size if last is None else last

    def items(self, start: int, stop: int, state: int) -> Iterator[tuple[int, bytes, bool]]:
        """(offset, bytes, finished) of the items that begin in a range."""
        found = self.bounds(start, stop)
        if found is None:
            return
        first, upto = found
        data = self.read(first, upto)
        for at in scan(data, state)[1]:
            end = item_end(data, at)
            more = STEP
            while end is None and first + len(data) < self.size:
                data += self.read(first + len(data), first + len(data) + more)
                more *= 2
                end = item_end(data, at)
            stop_at, finished = end or (len(data), False)
            yield first + at, data[at:stop_at], finished

    def close(self) -> None:
        self.file.close()


_PLACE = "path string, feed_url string, start bigint, stop bigint"


def file_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None) -> DataFrame:
    """(path, feed_url, start, stop) of all files under ``path``; no content is read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path).select("path", F.col("_metadata.file_path").alias("feed_url"), "length")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    ranges = files.withColumn("start", start)
    return ranges.select("path", "feed_url", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)],
                                      schema=schema)


_PLACES = [("path", pa.string()), ("feed_url", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]
_SCANNED = pa.schema(_PLACES + [("states", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
_KNOWN = pa.schema(_PLACES + [("state", pa.int32()), ("before", pa.int64())])
_ITEMS = pa.schema([("feed_url", pa.string()), ("position", pa.int64()), ("offset", pa.int64()), ("xml", pa.string()),
                    ("finished", pa.bool_())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, url, start, stop in _places(batches):
        f = Bytes(path)
        found = f.bounds(start, stop)
        data = f.read(*found) if found else b""
        f.close()
        ends = [scan(data, s) if found else (s, []) for s in range(4)]
        yield _rows([(path, url, start, stop, [s for s, _ in ends], [len(i) for _, i in ends])], _SCANNED)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, before = None, TEXT, 0
    for b in batches:
        rows = []
        for path, url, start, stop, states, items in zip(*(c.to_pylist() for c in b.columns)):
            if path != now:
                now, state, before = path, TEXT, 0
            rows.append((path, url, start, stop, state, before))
            state, before = states[state], before + items[state]
        yield _rows(rows, _KNOWN)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, url, start, stop, state, before in _places(batches):
        f, rows, size = Bytes(path), [], 0
        for i, (offset, data, finished) in enumerate(f.items(start, stop, state)):
            rows.append((url, before + i, offset, data.decode("utf-8", "replace"), finished))
            size += len(data)
            if size > STEP:
                yield _rows(rows, _ITEMS)
                rows, size = [], 0
        f.close()
        if rows:
            yield _rows(rows, _ITEMS)


def item_texts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None) -> DataFrame:
    """(feed_url, position, offset, xml, finished): the items of all files,
    with their place in the file. An item that the next one, the channel's end
    or the end of the file cuts off is not finished."""
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = file_ranges(spark, path, split_bytes, glob).repartition(n, "path", "start")
    known = (ranges.mapInArrow(_scanned, _PLACE + ", states array<int>, items array<bigint>")
             .repartition(n, "path").sortWithinPartitions("path", "start")
             .mapInArrow(_running, _PLACE + ", state int, before bigint"))
    return known.repartition(n, "path", "start").mapInArrow(
        _cut, "feed_url string, position bigint, offset bigint, xml string, finished boolean")
