"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same
bytes, and how often over the corpus.

A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model
with byte fallback that puts a blank before every text. Both encode every whole
text; A gets the text with that blank. Two tokens whose byte ranges overlap are
linked; a group ends where tokens of both end.

1. First pass: align the documents and write, task by task, the id pairs with
   the number of their links.
2. The distinct pairs become a minimal perfect hash, shard by shard (a pair's
   hash deals it to a shard of about ``SHARD_KEYS``), with the key of every slot
   for verification.
3. Each task adds its pairs up in one dense vector indexed by the hash; vectors
   are summed as a tree of bounded fan-in, chunk by chunk.
4. Second pass: align the documents again and look the counts up.

Shards are worked on in groups of at most ``GROUP_KEYS`` slots: what a task gets
of the hash is bounded, and the sums of a document add up over the groups (a
further group reads the rows that the group before has written).

Units. Neither vocabulary joins a letter or mark with a lone blank before it,
a lone line feed around it, or marks behind a word with its last letter; a
text in which all white space is of that kind is aligned word by word, and a
worker remembers the alignment of a bounded number of words (when there are too
many, those it has met most often stay). Arrow cuts the texts of a batch and
finds its distinct words, so that each is looked up once. B is asked whether
this holds: its pieces are searched for ones that would reach over.
Any other text is aligned whole. The ids equal those of the whole text.

Defined results: texts null or empty, or whose tokens do not spell the blank
and the text byte for byte, have no tokens (zeros, an empty digest) and count
nowhere; repeated rows count and return each by itself; a null ``doc_id`` stays
null; other columns are ignored; no documents give no rows."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import gives_back, stored, workers_ready
from feedloom.llm.perfect_hash import Slots, mix
from feedloom.llm.token_files import GROUP_CHARS, PLAIN, TAIL, ByteLetters, bounded
from feedloom.llm.tree_sum import DDL, chunks, tree_sum

BLANK = "▁"
MARK = "\x01"
#: Marks behind a letter, at the end of a word; the second form is Arrow's, which cannot look around.
_LETTER, _TAIL = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-" + PLAIN + "]", "[" + re.escape(TAIL) + "]+"
_MARKS = re.compile("(?<=" + _LETTER + ")" + _TAIL + r"(?= |\Z)")
_ARROW_MARKS = f"({_LETTER})({_TAIL})( |\\z)"
UNITS = 600_000
UNIT_BYTES = 64 * 1024 * 1024
PAIRS_A_ROW = 262_144
SHARD_KEYS = 262_144
GROUP_KEYS = 4_194_304
SHARD_SEED = 1000                                               # a seed that no level of the hash uses

#: Bytes that the byte-level alphabet shows as the character of the same number; the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of_letter() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in _SHOWN]
    return {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both vocabularies: ids and bytes of texts."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.model, self.letters = self.a.model, ByteLetters()
        self.blank = " ".translate(self.letters)
        byte, self.bytes_a = byte_of_letter(), [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        #: Neighbouring characters inside a piece: between any others the model never merges.
        near = {p[i:i + 2] for p in plain for i in range(len(p) - 1)}
        self.by_word = not any("\n" in p or (p[1] == BLANK and p[0] != BLANK) or (p[0].isalpha() and p[1] in TAIL) for p in near)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.line_feed = self.a.encode("\n", add_special_tokens=False).ids
        #: Every id with the mark behind it: inside a group, at its end.
        self.written = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self.written += [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"]

    def cuts(self, text: str) -> bool:
        """Whether a text can be aligned word by word."""
        if not self.by_word or MARK in text:
            return False
        lone = " ".join(text.split())
        return lone == text or lone == text.replace("\n", " ")

    def units(self, text: str) -> list[str]:
        """The parts of a text: a word stands for a blank and the word,
        ``MARK`` for nothing before the marks behind it, and the words behind
        a line feed begin with it. A text that cannot be cut is one unit: a
        blank and the text."""
        if self.cuts(text):
            return _MARKS.sub(" " + MARK + r"\g<0>", text.replace("\n", " \n")).split(" ")
        return [" " + text]

    def units_of(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``units`` of several texts: the units that occur in them, where
        among these the units of one text after the other are, and where each
        text's end."""
        fits = np.fromiter(map(self.cuts, texts), bool, len(texts))
        cut = pa.array([t for t, f in zip(texts, fits.tolist()) if f], pa.large_string())
        cut = pc.replace_substring_regex(pc.replace_substring(cut, "\n", " \n"), _ARROW_MARKS, r"\1 " + MARK + r"\2\3")
        words = pc.split_pattern(cut, " ")
        distinct = words.flatten().dictionary_encode()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        sizes = np.ones(len(texts), np.int64)
        sizes[fits] = np.diff(words.offsets.to_numpy())
        ends = np.cumsum(sizes)
        where, single = np.empty(sizes.sum(), np.int64), np.zeros(sizes.sum(), bool)
        single[(ends - sizes)[~fits]] = True
        where[~single] = distinct.indices.to_numpy()
        where[single] = len(names) + np.arange(np.count_nonzero(single))
        return names + [" " + t for t, f in zip(texts, fits.tolist()) if not f], where, ends

    def letters_only(self, word: str) -> bool:
        """Whether the vocabulary never splits a word before its merges."""
        return word.isalpha() and (word.isascii() or max(word) <= PLAIN)

    def ids_a(self, unit: str) -> list[int]:
        if self.letters_only(unit):                                 # letters of ASCII stand for themselves in its alphabet
            return [t.id for t in self.model.tokenize(self.blank + (unit if unit.isascii() else unit.translate(self.letters)))]
        if unit[0] == MARK:
            return [t.id for t in self.model.tokenize(unit[1:])]
        if unit[0] == "\n":
            rest = unit[1:]
            if self.letters_only(rest):
                return self.line_feed + [t.id for t in self.model.tokenize(rest if rest.isascii() else rest.translate(self.letters))]
            return self.line_feed + (self.a.encode(rest, add_special_tokens=False).ids if rest else [])
        return self.a.encode(unit if unit[0] == " " else " " + unit, add_special_tokens=False).ids

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """The model puts a blank before each; it does not belong to units
        that begin with a line feed, nor, with a line feed, to marks."""
        skip = [2 if u[0] == MARK else u[0] == "\n" for u in units]
        asked = ["\n" + u[1:] if k == 2 else u[1:] if u[0] == " " else u for u, k in zip(units, skip)]
        return [ids[k:] if k else ids for k, ids in zip(skip, self.b.encode(asked, num_threads=1))]

    @staticmethod
    def spelt(unit: str) -> bytes:
        return (unit[1:] if unit[0] == MARK else unit if unit[0] in " \n" else " " + unit).encode()


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after the other, how many each unit has)."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts


def aligned(flat_a: np.ndarray, n_a: np.ndarray, flat_b: np.ndarray, v: Vocabularies,
            groups: bool = True) -> tuple[np.ndarray, np.ndarray, list[str] | None]:
    """For units that spell the same bytes in both: linked id pairs of all
    units one after the other, where each unit's end, and its groups as text
    (None without ``groups``), with a semicolon behind each."""
    end_a, end_b = np.cumsum(v.size_a[flat_a]), np.cumsum(v.size_b[flat_b])
    ends = end_a[np.cumsum(n_a) - 1]
    # Between two neighbouring token ends lies exactly one linked pair.
    both = np.sort(np.concatenate([end_a, end_b]), kind="stable")         # two runs, each in order
    again = both[1:] == both[:-1]
    cuts, common = both[np.append(~again, True)], both[1:][again]
    pairs = flat_a[np.searchsorted(end_a, cuts)] * len(v.bytes_b) + flat_b[np.searchsorted(end_b, cuts)]
    stops = np.searchsorted(cuts, ends, "right")
    if not groups:
        return pairs, stops, None
    last = np.searchsorted(common, ends, "right")
    return pairs, stops, shown(flat_a, flat_b, end_a, end_b, common, last, v)


def shown(flat_a: np.ndarray, flat_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, common: np.ndarray,
          last: np.ndarray, v: Vocabularies) -> list[str]:
    """The groups of each unit as text: every id is written with the mark
    behind it (a comma inside a group, a bar or a semicolon at its end), A's
    ids of a group before B's."""
    upto_a, upto_b = (np.searchsorted(e, common, "right") for e in (end_a, end_b))
    code = np.empty(len(flat_a) + len(flat_b), np.int64)
    group = np.searchsorted(common, end_a)                              # the group of each token of A
    before = np.concatenate([[0], upto_b[:-1]])                         # tokens of B in the groups before
    code[np.arange(len(flat_a)) + before[group]] = 2 * flat_a + (common[group] == end_a)
    group = np.searchsorted(common, end_b)
    code[np.arange(len(flat_b)) + upto_a[group]] = 2 * (len(v.bytes_a) + flat_b) + (common[group] == end_b)
    written = list(map(v.written.__getitem__, code.tolist()))
    stops = (upto_a + upto_b)[last - 1].tolist()
    return ["".join(written[x:y]) for x, y in zip([0, *stops], stops)]


def same(ids: list[list[int]], flat: np.ndarray, counts: np.ndarray, spell: list[bytes], size: np.ndarray,
         spelt: list[bytes]) -> np.ndarray:
    """Which units' ids spell their bytes."""
    if counts.all() and b"".join(map(spell.__getitem__, flat.tolist())) == b"".join(spelt):
        if (np.add.reduceat(size[flat], np.cumsum(counts) - counts) == np.fromiter(map(len, spelt), np.int64, len(spelt))).all():
            return np.ones(len(spelt), bool)
    return np.array([b"".join(map(spell.__getitem__, x)) == s for x, s in zip(ids, spelt)], bool)


class Units:
    """Alignments of the units a worker has met. ``use(pairs)`` gives, for
    every linked pair, columns whose sums a unit keeps. Without ``groups`` none
    are written or counted: the text of a unit with tokens is empty."""

    COLUMNS = 6                                             # n_a, n_b, n_groups, n_links, n_best, count_sum

    def __init__(self, v: Vocabularies, use=None, keep_pairs: bool = False, groups: bool = True):
        self.v, self.use, self.keep_pairs, self.groups = v, use, keep_pairs, groups
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}                    # in ascending order
        self.texts: list[bytes | None] = []
        self.sums = np.zeros((1024, self.COLUMNS), np.int64)
        self.met = np.zeros(1024, np.int64)
        self.pairs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.bytes = 0

    @property
    def full(self) -> bool:
        return len(self.texts) > UNITS or self.bytes > UNIT_BYTES

    def shrink(self) -> None:
        """Forget all but those units, at most half of them, that were met more than once and most often."""
        met, names, spelt = self.met[:len(self.texts)], list(self.number), self.v.spelt
        kept = np.argsort(-met, kind="stable")[:UNITS // 2]
        kept = np.sort(kept[met[kept] > 1])
        lengths = np.cumsum([len(spelt(names[i])) for i in kept.tolist()])
        kept = kept[:np.searchsorted(lengths, UNIT_BYTES // 2, "right")]
        names, texts, sums, met = [names[i] for i in kept.tolist()], [self.texts[i] for i in kept.tolist()], self.sums[kept], met[kept]
        place = np.full(len(self.texts), -1)
        place[kept] = np.arange(len(kept))
        pairs, sizes, owners = self.pairs, self.sizes, self.owners
        self.clear()
        self.number, self.texts = dict(zip(names, range(len(names)))), texts
        self.bytes = int(lengths[len(kept) - 1]) if len(kept) else 0
        self.sums, self.met = np.concatenate([sums, self.sums]), np.concatenate([met // 2, self.met])
        if pairs:
            sizes, owners = np.concatenate(sizes), place[np.concatenate(owners)]
            self.pairs = [np.concatenate(pairs)[np.repeat(owners >= 0, sizes)]]
            self.sizes, self.owners = [sizes[owners >= 0]], [owners[owners >= 0]]

    def learn(self, names: list[str]) -> None:
        """Align units that are new."""
        v, first = self.v, len(self.texts)
        a, b, spelt = list(map(v.ids_a, names)), v.ids_b(names), list(map(v.spelt, names))
        (flat_a, n_a), (flat_b, n_b) = flattened(a), flattened(b)
        good = same(a, flat_a, n_a, v.bytes_a, v.size_a, spelt) & same(b, flat_b, n_b, v.bytes_b, v.size_b, spelt)
        while len(self.sums) < first + len(names):
            self.sums, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.met))
        sums = self.sums[first:first + len(names)]
        texts: list[bytes | None] = [None] * len(names)
        at = np.flatnonzero(good)
        if len(at):
            pairs, ends, groups = aligned(flat_a[np.repeat(good, n_a)], n_a[good], flat_b[np.repeat(good, n_b)], v, self.groups)
            sizes = np.diff(ends, prepend=0)
            sums[at, 0], sums[at, 1], sums[at, 3] = n_a[good], n_b[good], sizes
            if self.use:
                sums[at, 4:] = np.add.reduceat(self.use(pairs), ends - sizes, axis=0)
            if groups is not None:
                sums[at, 2] = [t.count(";") for t in groups]
            for i, t in zip(at.tolist(), groups or [""] * len(at)):
                texts[i] = t.encode()
            if self.keep_pairs:
                self.pairs.append(pairs), self.sizes.append(sizes), self.owners.append(at + first)
        self.texts += texts
        self.number.update(zip(names, range(first, first + len(names))))
        self.bytes += sum(map(len, spelt))

    def numbers(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
        """(rows with a text, unit numbers of each)."""
        rows, out = [i for i, t in enumerate(texts) if t], []
        for group in bounded([texts[i] for i in rows], GROUP_CHARS):
            names, where, ends = self.v.units_of(group)
            new = [n for n in dict.fromkeys(names) if n not in self.number]
            if new:
                self.learn(new)
            known = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
            np.add.at(self.met, known, np.bincount(where, minlength=len(names)))
            out += np.split(known[where], ends[:-1])
        return rows, out

    def flat(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units of all rows, where each row's begin, which rows have tokens):
        a row has tokens if all its units have."""
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        units = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        good = np.minimum.reduceat(self.sums[units, 0], starts) > 0 if len(numbers) else np.zeros(0, bool)
        return units, starts, good

    def totals(self, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs, links of each) when unit i was met ``uses[i]`` times."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        times = np.repeat(uses[np.concatenate(self.owners)], np.concatenate(self.sizes))
        pairs = np.concatenate(self.pairs)[times > 0]
        keys, back = np.unique(pairs, return_inverse=True)
        return keys, np.bincount(back, times[times > 0], len(keys)).astype(np.int64)


_WORKER: dict = {}


def worker_units(key: tuple, files: tuple[str, str], **how) -> Units:
    """The units of one pass, kept from task to task of a worker."""
    if _WORKER.get("files") != files:
        _WORKER.clear()
        _WORKER.update(files=files, vocabularies=Vocabularies(*files))
    if _WORKER.get("key") != key:
        _WORKER.update(key=key, units=Units(_WORKER["vocabularies"], **how))
    return _WORKER["units"]


# -- pairs, hash and counts ----------------------------------------------------------------------

def pair_parts(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(keys, links) rows of every task: distinct pairs and their links in
    the documents the task has read."""
    pass_id = uuid.uuid4().hex

    def emit(keys: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), PAIRS_A_ROW):
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + PAIRS_A_ROW].tobytes()], pa.binary()) for x in (keys, links)],
                                             names=["keys", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units((pass_id,), files, keep_pairs=True, groups=False)
        uses = np.zeros(len(units.texts), np.int64)
        for b in batches:
            rows, numbers = units.numbers(b.column(0).to_pylist())
            if len(uses) < len(units.texts):
                uses = np.concatenate([uses, np.zeros(len(units.texts) - len(uses), np.int64)])
            own, starts, good = units.flat(numbers)
            uses += np.bincount(own[np.repeat(good, np.diff(starts, append=len(own)))], minlength=len(uses))
            if units.full:
                yield from emit(*units.totals(uses))
                units.shrink()
                uses = np.zeros(len(units.texts), np.int64)
        yield from emit(*units.totals(uses))

    return stored(docs.select("text").mapInArrow(gives_back(run), "keys binary, links binary"), "pair-parts")


def hashed_pairs(parts: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(shard, slots, bits, keys): the minimal perfect hash of the distinct
    pairs of each shard, and the pairs in the order of their slots."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64))], names=["pair"])

    pairs = stored(parts.select("keys").mapInArrow(spread, "pair bigint").distinct(), "pairs")
    shards = max(1, math.ceil(pairs.count() / shard_keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = mix(b.column(0).to_numpy(), SHARD_SEED) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), b.column(0)], names=["shard", "pair"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shard = None

        def out():
            s = Slots.of(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([s.size], pa.int64()), pa.array([s.pack()], pa.binary()),
                 pa.array([s.keys.tobytes()], pa.binary())], names=["shard", "slots", "bits", "keys"])
        for b in batches:
            own, pair = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and own[i] != shard:
                    yield out()
                    held = []
                shard = int(own[i])
                held.append(pair[i:j].copy())
        if held:
            yield out()

    return stored(pairs.mapInArrow(deal, "shard int, pair bigint").repartition("shard").sortWithinPartitions("shard")
                  .mapInArrow(build, "shard int, slots bigint, bits binary, keys binary"), "pair-hash")


class PairTable:
    """The hashes of some shards: a slot of the whole, -1 for other pairs."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.slots, self.first, self.size = shards, {}, {}, 0
        for r in sorted(rows, key=lambda r: r.shard):
            self.slots[r.shard] = Slots.unpack(bytes(r.bits), np.frombuffer(bytes(r.keys), np.int64))
            self.first[r.shard] = self.size
            self.size += r.slots

    def find(self, pairs: np.ndarray) -> np.ndarray:
        shard = (mix(pairs, SHARD_SEED) % np.uint64(self.shards)).astype(np.int64)
        out = np.full(len(pairs), -1, np.int64)
        for s, slots in self.slots.items():
            at = np.flatnonzero(shard == s) if self.shards > 1 else np.arange(len(pairs))
            if len(at):
                slot = slots.find(pairs[at])
                out[at] = np.where(slot >= 0, slot + self.first[s], -1)
        return out

    def keys(self) -> np.ndarray:
        return np.concatenate([self.slots[s].keys for s in sorted(self.slots)])


def dense_counts(parts: DataFrame, table: PairTable) -> np.ndarray:
    """Links of every slot: one dense vector a task, summed as a tree."""
    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total, node = np.zeros(table.size, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for keys, links in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                slot = table.find(np.frombuffer(keys, np.int64))
                held = slot >= 0
                total[slot[held]] += np.frombuffer(links, np.int64)[held]     # a row holds a pair once
        yield from chunks(node, total)

    return tree_sum(parts.mapInArrow(vector, DDL), parts.rdd.getNumPartitions(), table.size, np.int64)


def _grouped(hashes: DataFrame, group_keys: int) -> list[list[int]]:
    """Shards in groups of at most ``group_keys`` slots."""
    out, size = [], 0
    for r in sorted(hashes.select("shard", "slots").collect(), key=lambda r: r.shard):
        if not out or size + r.slots > group_keys:
            out.append([])
            size = 0
        out[-1].append(r.shard)
        size += r.slots
    return out


# -- the operator --------------------------------------------------------------------------------

OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def looked_up(docs: DataFrame, files: tuple[str, str], table: PairTable | None, counts: np.ndarray,
              best: np.ndarray, last: bool) -> DataFrame:
    """Second pass over (doc_id, text, n_best, count_sum): the sums of this
    group of pairs are added to what the groups before have found. All but
    the last group's rows carry the text on."""
    pass_id, kept = uuid.uuid4().hex, ["doc_id"] if last else ["doc_id", "text"]

    def use(pairs: np.ndarray) -> np.ndarray:
        if table is None:
            return np.zeros((len(pairs), 2), np.int64)
        slot = table.find(pairs)
        held = slot >= 0
        return np.stack([held & best[slot], np.where(held, counts[slot], 0)], axis=1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units((pass_id,), files, use=use)
        for b in batches:
            rows, numbers = units.numbers(b.column(1).to_pylist())
            sums, digest = np.zeros((b.num_rows, Units.COLUMNS), np.int64), [""] * b.num_rows
            own, starts, good = units.flat(numbers)
            if len(rows):
                sums[rows] = np.add.reduceat(units.sums[own], starts, axis=0) * good[:, None]
            for i, of, fine in zip(rows, numbers, good.tolist()):
                if fine:
                    digest[i] = hashlib.sha256(b"".join(map(units.texts.__getitem__, of.tolist()))[:-1]).hexdigest()
            sums[:, 4] += b.column(2).to_numpy()
            sums[:, 5] += b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], *(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(digest, pa.string())],
                names=[*kept, *OUT, "groups_sha256"])
            if units.full:
                units.shrink()

    return docs.select("doc_id", "text", "n_best", "count_sum").mapInArrow(
        gives_back(run), "doc_id bigint, " + ("" if last else "text string, ") + ", ".join(f"{c} bigint" for c in OUT)
        + ", groups_sha256 string")


def alignment(docs: DataFrame, file_a: str, file_b: str, *, id_col: str = "doc_id", text_col: str = "text",
              shard_keys: int = SHARD_KEYS, group_keys: int = GROUP_KEYS) -> DataFrame:
    """One row for every document: sizes and sums of its alignment, and the
    digest of its groups."""
    spark: SparkSession = docs.sparkSession
    workers_ready(spark)
    files = (file_a, file_b)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    parts = pair_parts(rows, files)
    hashes = hashed_pairs(parts, shard_keys)
    shards = max(1, math.ceil(hashes.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0] / shard_keys))
    groups, counts = _grouped(hashes, group_keys), []

    def table_of(group: list[int]) -> PairTable:
        return PairTable(hashes.where(F.col("shard").isin(group)).collect(), shards)    # at most group_keys slots

    n_b = pieces(file_b)
    highest = np.zeros(n_b, np.int64)                            # one number for each id of B
    for group in groups:
        table = table_of(group)
        links = dense_counts(parts, table)
        np.maximum.at(highest, table.keys() % n_b, links)
        counts.append(stored(spark.createDataFrame([(bytearray(links.tobytes()),)], "links binary"), "pair-counts"))
    out = rows
    for i, group in enumerate(groups):
        table, links = table_of(group), np.frombuffer(bytes(counts[i].first().links), np.int64)
        out = looked_up(stored(out, "aligned") if i else out, files, table, links, links == highest[table.keys() % n_b],
                        i + 1 == len(groups))
    if not groups:                                               # no pair anywhere: every row has no tokens
        out = looked_up(out, files, None, np.zeros(0, np.int64), np.zeros(0, np.bool_), True)
    return out.select("doc_id", *OUT, "groups_sha256")


def pieces(file_b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=file_b).get_piece_size()
