"""Token-id files: every document's ids compressed on their own with one
shared zstandard dictionary.

Format. A file set is a Parquet folder of block rows, written through Spark's
own committer (a lost executor's task is simply run again) to any file system
Spark can write. A block holds consecutive documents of one part:

=============  ==================================================================
part, block    position of the block; parts and blocks ascend with the document id
doc_ids        ids of the documents, ascending
offsets        byte offset of each document's frame in ``frames``, plus the end
n_tokens       ids of each document, the end id included
width          bytes of one serialized id (2 or 4, little endian, unsigned)
dict_hash      SHA-256 of the dictionary the frames need
frames         the zstandard frames of the documents, one after the other
=============  ==================================================================

The dictionary (at most ``DICT_BYTES``) lies beside the blocks as a one-row
table. It is trained on the serialized ids of the ``DICT_DOCS`` documents with
the smallest id hashes (a bounded, documented sample; it only affects size).
``fetch`` reads single documents: the Parquet statistics of the block's first
and last id choose the block, the offset index the frame.

Tokenizing. The byte-level vocabulary splits a text before a lone space or
around a lone line feed between non-blank characters, whatever stands beside
it. Words between those points therefore get their ids one by one from the
tokenizers library, once per distinct word and worker (a bounded cache, asked
once for each distinct word of a batch); any
line with other white space, and any text with an added token in it, goes to
the library whole. The ids equal those of the whole text.

Defined results: a null text is empty; an empty text has the end id only;
repeated rows are written repeatedly, next to each other (rows of one id in an
unspecified order); a null document id sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import gives_back, parts, shared_path, workers_ready

END_ID = 2
DICT_BYTES = 64 * 1024
DICT_DOCS = 1000
BLOCK_DOCS = 256
BLOCK_BYTES = 4 * 1024 * 1024
CACHE_WORDS = 250_000
GROUP_CHARS = 4 * 1024 * 1024
STEP_WORDS = 4096
LONGEST = 100_000_000        # characters whose ids Arrow's 32-bit offsets surely span
LEVEL = 3

BLOCK_DDL = ("part int, block int, first_doc bigint, last_doc bigint, doc_ids array<bigint>, offsets array<int>, "
             "n_tokens array<int>, width int, dict_hash string, frames binary")


class ByteLetters(dict):
    """str.translate table of the byte-level alphabet, asked from the library
    one character at a time."""

    def __init__(self):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(p for p, _ in self.level.pre_tokenize_str(chr(code)))
        return out


# Punctuation that may end a word; none of it starts a contraction.
TAIL = ",.;:!?*$%&#|()[]\"-"
#: Letters up to here are letters in every version of the character tables.
PLAIN = "\u024f"


class WordIds(dict):
    """word -> serialized ids, filled from the library on demand. When full it
    becomes the older generation, from which words still in use come back.
    ``lead`` is what stands before every word ("" or a blank); a
    word may begin with a line feed of its own, and is then looked up in
    ``bare``, where nothing stands before a word. Letters, and punctuation
    behind them, are encoded apart: the vocabulary never joins them, and only
    the letters are kept. Any other word is encoded as a text of its own."""

    def __init__(self, tokenizer, lead: str, letters: ByteLetters, limit: int = CACHE_WORDS,
                 bare: WordIds | None = None):
        super().__init__()
        self.tokenizer, self.lead, self.letters, self.limit, self.bare = tokenizer, lead, letters, limit, bare
        self.model, self.tails, self.old = tokenizer.model, {}, {}
        self.lead_letters = lead.translate(letters)
        self.line_feed = self.text("\n")

    def __missing__(self, word: str) -> bytes:
        if word[0] == "\n" and self.bare is not None:      # no blank stands before it or behind it
            return self.line_feed + (self.bare[word[1:]] if len(word) > 1 else b"")
        head = word.rstrip(TAIL)
        plain = head.isalpha() and (head.isascii() or max(head) <= PLAIN)
        if plain and len(head) < len(word):
            return self[head] + self.tail(word[len(head):])
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
            self.tails.clear()
        out = self.old.get(word)
        if out is None:
            out = self.one(self.lead_letters, word) if plain else self.text(self.lead + word)
        self[word] = out
        return out

    def tail(self, tail: str) -> bytes:
        out = self.tails.get(tail)
        if out is None:
            out = self.tails[tail] = self.one("", tail)
        return out

    def text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, lead: str, token: str) -> bytes:
        """Ids of what the vocabulary never splits before its merges. Letters
        and punctuation of ASCII stand for themselves in its alphabet."""
        token = token if token.isascii() else token.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(lead + token)]).tobytes()


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file."""

    def __init__(self, tokenizer_file: str, end_id: int = END_ID):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = ByteLetters()
        self.first = WordIds(self.tokenizer, "", letters, CACHE_WORDS // 10)
        self.rest = WordIds(self.tokenizer, " ", letters, bare=self.first)
        self.end = array("I", [end_id]).tobytes()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def splits(self, text: str) -> bool:
        """Whether every white space character of ``text`` is a lone blank or
        a lone line feed between two other characters, and no added token
        stands in it."""
        if any(a in text for a in self.added):
            return False
        lone = " ".join(text.split())
        return lone == text or lone == text.replace("\n", " ")

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The serialized 32-bit ids of each text, the end id included."""
        for group in bounded(texts, GROUP_CHARS):
            words = [i for i, t in enumerate(group) if t and len(t) <= LONGEST and self.splits(t)]
            by_words = iter(self.by_words([group[i] for i in words]))
            words = set(words)
            for i, t in enumerate(group):
                if i in words:
                    yield next(by_words)
                else:
                    yield (array("I", self.whole(t)).tobytes() if t else b"") + self.end

    def by_words(self, texts: list[str]) -> Iterator[bytes]:
        """Every distinct word of the texts is looked up once; Arrow finds
        them and puts their ids where the words stood."""
        if not texts:
            return
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        bounds, flat = words.offsets.to_numpy(), words.flatten()
        distinct = flat.dictionary_encode()
        all_words = distinct.dictionary
        known = [pa.array([self.rest[w] for w in all_words.slice(k, STEP_WORDS).to_numpy(zero_copy_only=False)], pa.binary())
                 for k in range(0, len(all_words), STEP_WORDS)]              # few of them are Python objects at a time
        where = distinct.indices.to_numpy().copy()
        where[bounds[:-1]] = len(all_words) + np.arange(len(texts))          # no blank stands before a first word
        known.append(pa.array([self.first[w] for w in flat.take(pa.array(bounds[:-1])).to_pylist()], pa.binary()))
        joined = pa.concat_arrays(known).take(pa.array(where))
        _, ends, data = joined.buffers()
        at = np.frombuffer(ends, dtype=np.int32)[bounds].tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield data[a:b].to_pybytes() + self.end


def bounded(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """The texts in order, in groups of at most ``chars`` characters (or one text)."""
    group, size = [], 0
    for t in texts:
        size += len(t or "")
        if group and size > chars:
            yield group
            group, size = [], len(t or "")
        group.append(t)
    if group:
        yield group


_ENCODERS: dict = {}


def encoder(tokenizer_file: str, end_id: int) -> Encoder:
    """One encoder (and its word caches) per worker process."""
    key = (tokenizer_file, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_file, end_id)
    return _ENCODERS[key]


def serialized(ids: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID, width: int = 2, sample_docs: int = DICT_DOCS,
                     dict_bytes: int = DICT_BYTES) -> bytes:
    """The shared dictionary; empty when there is too little text to train on."""
    workers_ready(docs.sparkSession)
    chosen = (docs.select(F.col(f"`{id_col}`").alias("_id")).distinct()
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_docs))

    def run(batches):
        enc = encoder(tokenizer_file, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([serialized(x, width)[:dict_bytes] for x in enc.ids(b.column(0).to_pylist())], pa.binary())],
                names=["s"])

    few = (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
           .join(F.broadcast(chosen), "_id", "left_semi").select("_text"))     # at most sample_docs ids
    samples = [bytes(r.s) for r in few.mapInArrow(gives_back(run), "s binary").limit(sample_docs).collect()]
    samples.sort()
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(dict_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:                            # too uniform to learn from
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, width: int = 2,
                      num_parts: int | None = None) -> None:
    """Encode every whole text and write the file set under ``path``. The
    documents are dealt by ranges of their id, so that parts ascend with it
    and no part holds more than its share."""
    spark = docs.sparkSession
    workers_ready(spark)
    dictionary = train_dictionary(docs, tokenizer_file, id_col=id_col, text_col=text_col, end_id=end_id, width=width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, comp, block = encoder(tokenizer_file, end_id), _compressor(dictionary), 0
        ids: list = []
        offsets, counts, frames = [0], [], []

        def flush():
            nonlocal block, ids, offsets, counts, frames
            row = {"part": part, "block": block, "first_doc": ids[0], "last_doc": ids[-1], "doc_ids": ids,
                   "offsets": offsets, "n_tokens": counts, "width": width, "dict_hash": dict_hash,
                   "frames": b"".join(frames)}
            block += 1
            ids, offsets, counts, frames = [], [0], [], []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist()), strict=True):
                frame = comp.compress(serialized(x, width))
                if ids and (len(ids) >= BLOCK_DOCS or offsets[-1] + len(frame) > BLOCK_BYTES):
                    yield flush()
                ids.append(doc)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                counts.append(len(x) // 4)
        if ids:
            yield flush()

    (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
     .repartitionByRange(num_parts or parts(spark), "_id").sortWithinPartitions("_id")
     .mapInArrow(gives_back(run), BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


_BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())),
    ("width", pa.int32()), ("dict_hash", pa.string()), ("frames", pa.binary())])


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    return r.dict_hash, bytes(r.dictionary)


def _frames(batch: pa.RecordBatch, dict_hash: str, decomp) -> Iterator[tuple[dict, int, bytes]]:
    """(block row, position, serialized ids) of every document."""
    for row in batch.to_pylist():
        if row["dict_hash"] != dict_hash:
            raise ValueError("a block needs another dictionary than the one beside it")
        for i in range(len(row["doc_ids"])):
            yield row, i, decomp.decompress(row["frames"][row["offsets"][i]:row["offsets"][i + 1]])


def read_token_ids(spark: SparkSession, path: str, where=None) -> DataFrame:
    """Rows (part, block, pos, doc_id, ids) of the file set. ``where`` is a
    condition on block columns, pushed down to the Parquet scan."""
    workers_ready(spark)
    dict_hash, dictionary = read_dictionary(spark, path)

    def run(batches):
        decomp = _decompressor(dictionary)
        for b in batches:
            for group in range(b.num_rows):
                rows = [(r["part"], r["block"], i, r["doc_ids"][i],
                         np.frombuffer(raw, dtype=f"<u{r['width']}").astype(np.int32))
                        for r, i, raw in _frames(b.slice(group, 1), dict_hash, decomp)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in rows], t) for k, t in enumerate(
                        (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())))],
                    names=["part", "block", "pos", "doc_id", "ids"])

    blocks = _blocks(spark, path)
    return (blocks if where is None else blocks.where(where)).mapInArrow(
        gives_back(run), "part int, block int, pos int, doc_id bigint, ids array<int>")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: only their blocks are read. Null ids
    sort first, so a block that begins with one has no lower bound."""
    cond = None
    for d in doc_ids:
        c = (F.col("first_doc").isNull() | (F.col("first_doc") <= d)) & (F.col("last_doc") >= d)
        cond = c if cond is None else cond | c
    out = read_token_ids(spark, path, cond if cond is not None else F.lit(False))
    return out.where(F.col("doc_id").isin([int(d) for d in doc_ids])).select("doc_id", "ids")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files: every
    frame is decompressed and its ids summed up; ``start`` counts the ids of
    all documents before, from the totals of parts and blocks."""
    workers_ready(spark)
    dict_hash, dictionary = read_dictionary(spark, path)

    def run(batches):
        decomp = _decompressor(dictionary)
        for b in batches:
            for group in range(b.num_rows):
                part, block, doc, before, n, crc, total = [], [], [], [], [], [], 0
                for r, i, raw in _frames(b.slice(group, 1), dict_hash, decomp):
                    ids = np.frombuffer(raw, dtype=f"<u{r['width']}").astype("<u4")
                    part.append(r["part"])
                    block.append(r["block"])
                    doc.append(r["doc_ids"][i])
                    before.append(total)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    total += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(doc, pa.int64()),
                     pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"])

    docs = _blocks(spark, path).mapInArrow(
        gives_back(run), "part int, block int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    sums = _blocks(spark, path).select(
        "part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    running = sums.withColumn("in_part", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n"))
    totals = sums.groupBy("part").agg(F.sum("n").alias("t"))          # one row a part
    of_part = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("to_part"))
    offsets = running.join(of_part, "part").select("part", "block", (F.col("in_part") + F.col("to_part")).alias("o"))
    return (docs.join(offsets, ["part", "block"])
            .select("doc_id", (F.col("o") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def token_index(docs: DataFrame, tokenizer_file: str, **kw) -> DataFrame:
    """Write the file set of ``docs`` into the shared folder and return its
    document index, read back from the files."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file, **kw)
    return document_index(docs.sparkSession, path)
