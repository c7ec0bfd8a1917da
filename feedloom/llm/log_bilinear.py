"""Language-model scores from a log-bilinear neural model.

The model predicts a word's vector from the vectors of the ``ORDER`` words
before it, each weighted position by position; the word's log-odds are the
product with its output vector plus a bias. Outcomes are the ``HEAD`` most
frequent words, the end of a text, and classes of all other words by their
last ``SUFFIX`` letters (the ``CLASSES`` most frequent endings, and one class
for the rest). Within a class a word has its share of the class's training
count, every word half a count more and half a count for what was never seen,
so the probabilities of all words after any context sum to one.

1. Word counts of the training documents: added up in every task, then by word.
2. Encoding: every document becomes the numbers of its outcomes. Arrow cuts the
   texts, and the distinct words of a step are looked up once. Words beyond
   the ``COMMON`` most frequent ones (whose counts every task holds) are kept
   with the document and meet their counts in a join.
3. Training by noise-contrastive estimation in numpy: a task goes through its
   documents once, tells each word from ``NOISE`` words drawn from the counts,
   and steps by AdaGrad. After each of ``ROUNDS`` equal shares of the
   documents the tasks' models are averaged, weighted by tokens, through a
   tree of sums. Every training token is used once.
4. Scoring: matrix products over batches of contexts give the log-odds of all
   outcomes; subtracting the logarithm of the sum of their exponentials
   normalises them. That sum depends on the context alone, so a task works it
   out once for contexts that it remembers. Every token of every text is scored.

Defined results: a null text is empty, and a text without words has its end
only; repeated rows are scored each by itself (and count each in training); a
null id is learnt from; without training documents all counts are zero and the
model is its starting point; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gives_back, stored, workers_ready
from feedloom.llm.tree_sum import DDL, chunks, tree_sum

HEAD = 191
CLASSES = 127
SUFFIX = 2
COMMON = 131_072
FLUSH = 200_000
ORDER = 3
WIDTH = 16
NOISE = 96
BATCH = 2048
ROUNDS = 4
RATE = 0.15
BUFFER = 65_536
SCORED = 512
SLOTS = 1 << 21
STEP_BYTES = 4 << 20

END = b""                                                       # no word is empty


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Steps of some ``STEP_BYTES`` of a column of texts: (first row, the
    first token of each text and the number of tokens, tokens as numbers of
    distinct words, these words). Tokens are the lower-cased (A-Z) words between
    ASCII white space, and the end of each text; a null text is empty."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + STEP_BYTES, "right")))
        step = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(first, last - first), pa.scalar("", texts.type))))
        # What follows the blank at the end of a text is empty, as is all of an empty text: its end.
        ended = pc.binary_join_element_wise(step, *(pa.scalar(x, step.type) for x in ("", " ")))
        step = pc.if_else(pc.equal(pc.binary_length(step), 0), step, ended)
        cut = pc.ascii_split_whitespace(step)
        coded = cut.flatten().dictionary_encode()
        starts = cut.offsets.to_numpy().astype(np.int64)
        words = coded.dictionary
        yield (first, starts - starts[0], coded.indices.to_numpy(),
               words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).cast(pa.binary()))
        first = last


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


# -- counts --------------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over (text) rows; the end of each text counts as a token."""
    def added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([t[x].chunk(0) for x in ("word", "c_sum")], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, _, numbers, words in tokens_of(b.column(0)):
                held.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)))],
                                                       names=["word", "c"]))
                size += len(words)
                if size > 2 * FLUSH:
                    held = [added(held)]
                    if (size := held[0].num_rows) > FLUSH:
                        yield held[0]
                        held, size = [], 0
        if held:
            yield added(held)

    return stored(docs.select("text").mapInArrow(gives_back(run), "word binary, c bigint")
                  .groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def _ending(word: bytes, letters: int = SUFFIX) -> str:
    return word.decode("utf-8", "replace")[-letters:]


@dataclass
class Outcomes:
    """What the model predicts, and the counts that every task holds."""
    head: list[bytes]                       # the end comes last
    endings: dict[str, int]                 # ending -> outcome; the rest is the last outcome
    counts: np.ndarray                      # training tokens of each outcome
    shares: np.ndarray                      # log10 of each class's total of (c + 0.5) and 0.5; 0 for the head
    common: dict[bytes, int]                # count of the most frequent words
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.counts)


def least_count(words: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach: counts are looked at
    in steps of a sixteenth of a power of two, so a table of some hundred
    rows decides, and no task sends its own best words to the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(),
                    key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.c
    return least if least is not None else 2 ** 62


def outcomes(counts: DataFrame, head: int = HEAD, classes: int = CLASSES, common: int = COMMON) -> Outcomes:
    """The outcomes from stored word counts. At most ``common`` and ``head``
    words and some ``classes`` endings come to the driver. No word is left out:
    what is beyond ``common`` meets its count in a join, and endings beyond
    ``classes`` are one outcome in which each word has its own share."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = counts.where(F.length("word") > 0)
    held = {bytes(r.word): r.c for r in words.where(F.col("c") >= least_count(words, common)).collect()}
    ends = counts.where(F.length("word") == 0).select("c").first()
    # By themselves: where more than ``common`` words share the highest counts, none of them is held.
    top = [(bytes(r.word), r.c) for r in words.orderBy(F.desc("c"), "word").limit(head).collect()]
    ending = F.coalesce(F.right(F.col("word").cast("string"), F.lit(SUFFIX)), F.lit(""))
    tail = words.where(~F.col("word").isin([bytearray(w) for w, _ in top])) if top else words
    by_ending = tail.groupBy(ending.alias("ending")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    rest = tail.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("v")).first()
    chosen = by_ending.orderBy(F.desc("c"), "ending").limit(classes).collect()     # a task sends ``classes`` rows at most
    of_class = [(r.c, r.v) for r in chosen]
    of_class.append((rest.c - sum(c for c, _ in of_class), rest.v - sum(v for _, v in of_class)))
    names = [w for w, _ in top] + [END]
    each = [c for _, c in top] + [ends.c if ends else 0]
    return Outcomes(
        names, {r.ending: len(names) + i for i, r in enumerate(chosen)},
        np.array(each + [c for c, _ in of_class], np.int64),
        np.array([0.0] * len(names) + [np.log10(c + 0.5 * (v + 1)) for c, v in of_class]),
        held | dict(top) | {END: each[-1]}, total.n, total.v)


class Lookup:
    """Outcomes and counts of distinct words."""

    def __init__(self, o: Outcomes):
        self.outcomes = o
        self.head, self.common = pa.array(o.head, pa.binary()), pa.array(list(o.common), pa.binary())
        self.endings = pa.array(list(o.endings), pa.string())
        self.of_ending = np.array([*o.endings.values(), o.size - 1])
        self.logs = np.append(np.log10(np.array(list(o.common.values()), np.float64) + 0.5), np.nan)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The outcome of each word."""
        try:
            text = words.cast(pa.string())                  # refuses what is not UTF-8
            ending = pc.utf8_slice_codeunits(text, start=-SUFFIX)
        except pa.ArrowInvalid:
            ending = pa.array([_ending(w) for w in words.to_pylist()], pa.string())
        top = _index(words, self.head)
        return np.where(top >= 0, top, self.of_ending[_index(ending, self.endings)]).astype(np.uint16)

    def log_counts(self, words: pa.Array) -> np.ndarray:
        """log10(c + 0.5) of the common words; nan for any other."""
        return self.logs[_index(words, self.common)]


def _index(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each value, -1 where it is missing."""
    return pc.fill_null(pc.index_in(values, among), -1).to_numpy(zero_copy_only=False)


ENCODED = ("doc_id bigint, held_out boolean, n_tokens bigint, ids binary, head_log double, tail_log double, "
           "class_log double, known bigint, rare array<binary>, times array<int>")


def encoded(docs: DataFrame, o: Outcomes) -> DataFrame:
    """The stored rows of (doc_id, held_out, text): outcome numbers, sums of
    log10(c + 0.5) over the words of the head and over other words of known
    count, and the words to be looked up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, head = Lookup(o), len(o.head)
        for b in batches:
            for row, starts, tokens, words in tokens_of(b.column(2)):
                number, log, n = lookup.numbers(words), lookup.log_counts(words), len(starts) - 1
                unknown, top = np.isnan(log), number < head
                log[unknown] = 0

                def total(of_word: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(of_word[tokens], starts[:-1])         # no text is without a token
                missing = np.flatnonzero(unknown[tokens])
                text = np.searchsorted(starts, missing, "right") - 1
                pairs, times = np.unique(text * len(words) + tokens[missing], return_counts=True)
                each = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(words)), pa.int32())
                known = np.diff(starts) - np.bincount(text, minlength=n)
                if not o.counts[head - 1]:                  # the end was never seen in training
                    known = known - 1
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * starts).astype(np.int32)),
                                                             pa.py_buffer(number[tokens])])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array(np.diff(starts)), ids,
                     pa.array(total(np.where(top, log, 0))), pa.array(total(np.where(top, 0, log))), pa.array(total(o.shares[number])),
                     pa.array(known), pa.ListArray.from_arrays(each, words.take(pa.array(pairs % len(words)))),
                     pa.ListArray.from_arrays(each, pa.array(times, pa.int32()))],
                    names=["doc_id", "held_out", "n_tokens", "ids", "head_log", "tail_log", "class_log", "known", "rare", "times"])

    rows = docs.mapInArrow(gives_back(run), ENCODED).withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "encoded")


# -- the model -----------------------------------------------------------------------------------

def contexts(ids: list[bytes], pad: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(outcomes, the ``order`` outcomes before each, nearest first) of texts."""
    before = np.full(order, pad, np.int64)
    line = np.concatenate([x for t in ids for x in (before, np.frombuffer(t, np.uint16))]).astype(np.int64)
    at = np.flatnonzero(line != pad)
    return line[at], line[at[:, None] - np.arange(1, order + 1)]


class Model:
    """Vectors of the log-bilinear model as views of one flat array."""

    def __init__(self, size: int, order: int = ORDER, width: int = WIDTH, flat: np.ndarray | None = None):
        self.size, self.order, self.width = size, order, width
        shapes = [(size + 1, width), (order, width), (size, width), (size,)]
        lengths = [int(np.prod(s)) for s in shapes]
        self.flat = np.zeros(sum(lengths), np.float32) if flat is None else flat.astype(np.float32)
        self.context, self.weight, self.output, self.bias = (
            x.reshape(s) for x, s in zip(np.split(self.flat, np.cumsum(lengths)[:-1]), shapes))

    @classmethod
    def start(cls, counts: np.ndarray, order: int = ORDER, width: int = WIDTH) -> Model:
        """Small vectors from a fixed seed, biases that give the word shares."""
        m, r = cls(len(counts), order, width), np.random.default_rng(12)
        m.context[:] = r.normal(0, 0.3, m.context.shape)
        m.output[:] = r.normal(0, 0.1, m.output.shape)
        m.weight[:] = 1 / order
        m.bias[:] = np.log(noise_of(counts))
        return m

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("bod,od->bd", self.context[before], self.weight)

    def guesses(self, before: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The predicted vectors of ``SCORED`` contexts at a time (the memory
        is used again), and a one that takes the bias."""
        near = [self.context * w for w in self.weight]
        guess = np.ones((SCORED, self.width + 1), np.float32)
        for i in range(0, len(before), SCORED):
            n = min(SCORED, len(before) - i)
            part = np.take(near[0], before[i:i + n, 0], axis=0)
            for k in range(1, self.order):
                part += np.take(near[k], before[i:i + n, k], axis=0)
            guess[:n, :-1] = part
            yield slice(i, i + n), guess[:n]

    @property
    def vectors(self) -> np.ndarray:
        """The output vectors, with the bias as a further coordinate."""
        return np.concatenate([self.output, self.bias[:, None]], axis=1)

    def log_probabilities(self, words: np.ndarray, before: np.ndarray, seen: Seen | None = None) -> np.ndarray:
        """Natural logarithm of the normalised probability of each word.
        ``seen`` holds log sums of this model from call to call."""
        vectors, own = self.vectors, np.empty(len(words))
        for at, g in self.guesses(before):
            own[at] = np.einsum("bd,bd->b", g, np.take(vectors, words[at], axis=0))
        return own - (Seen(0) if seen is None else seen).log_sums(self, before)

    def log_sums(self, before: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of the exponentials of all log-odds after each
        context; one product gives all log-odds of a batch."""
        vectors, out = self.vectors, np.empty(len(before))
        longest = float(np.sqrt((self.output ** 2).sum(axis=1).max())) if self.size else 0.0
        top, ones = float(np.abs(self.bias).max()), np.ones(self.size, np.float32)
        odds = np.empty((SCORED, self.size), np.float32)
        for at, g in self.guesses(before):
            o, shift = np.matmul(g, vectors.T, out=odds[:len(g)]), 0.0
            if longest * float(np.sqrt((g[:, :-1] ** 2).sum(axis=1).max())) + top > 60:    # else no exponential overflows
                shift = o.max(axis=1)
                o -= shift[:, None]
            np.exp(o, out=o)
            out[at] = shift + np.log((o @ ones).astype(np.float64))
        return out


class Seen:
    """Log sums of contexts met before, by context; of several contexts of
    one slot the latest stays."""

    def __init__(self, slots: int = SLOTS):
        self.keys, self.sums = np.full(slots, -1, np.int64), np.empty(slots)

    def log_sums(self, model: Model, before: np.ndarray) -> np.ndarray:
        key = before @ ((model.size + 1) ** np.arange(model.order))      # 16-bit outcomes: three of them fit
        out, new = np.empty(len(key)), np.arange(len(key))
        if len(self.keys):
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(len(self.keys))
            met = self.keys[slot] == key
            out[met], new = self.sums[slot[met]], np.flatnonzero(~met)
        distinct, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        sums = model.log_sums(before[new[first]])
        out[new] = sums[back]
        if len(self.keys):
            at = slot[new[first]]
            self.keys[at], self.sums[at] = distinct, sums
        return out


def noise_of(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts.sum() + 0.5 * len(counts))


def _scatter(rows: np.ndarray, values: list[np.ndarray], size: int) -> np.ndarray:
    """Sums by row number of values that come column by column."""
    return np.stack([np.bincount(rows, v, size) for v in values], axis=1)


class Trainer:
    """One task's steps of noise-contrastive estimation with AdaGrad."""

    def __init__(self, model: Model, squares: np.ndarray, counts: np.ndarray, seed: int):
        self.model, self.tokens = model, 0
        self.squares = Model(model.size, model.order, model.width, squares)
        self.random = np.random.default_rng(seed)
        self.noise = noise_of(counts)
        self.upto = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.odds = np.empty((BATCH, NOISE), np.float32)

    def learn(self, ids: list[bytes]) -> None:
        words, before = contexts(ids, self.model.size, self.model.order)
        mixed = self.random.permutation(len(words))
        for i in range(0, len(words), BATCH):
            at = mixed[i:i + BATCH]
            self.step(words[at], before[at])
        self.tokens += len(words)

    def step(self, words: np.ndarray, before: np.ndarray) -> None:
        m = self.model
        drawn = np.minimum(np.searchsorted(self.upto, self.random.random(NOISE)), m.size - 1)
        near = np.take(m.context, before, axis=0)                           # batch, order, width
        guess = np.einsum("bod,od->bd", near, m.weight)
        own, other = m.output[words], m.output[drawn]
        true = np.einsum("bd,bd->b", guess, own) + m.bias[words] - self.log_noise[words]
        false = np.matmul(guess, other.T, out=self.odds[:len(words)])
        false += m.bias[drawn] - self.log_noise[drawn]
        d_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        np.negative(np.clip(false, -30, 30, out=false), out=false)
        np.exp(false, out=false)
        false += 1
        d_false = np.divide(1, false, out=false)
        d_guess = d_true[:, None] * own + d_false @ other
        self.move("output", _scatter(np.concatenate([words, drawn]),
                                     [np.concatenate(x) for x in zip((d_true[:, None] * guess).T, (d_false.T @ guess).T)], m.size))
        self.move("bias", np.bincount(np.concatenate([words, drawn]),
                                      np.concatenate([d_true, d_false.sum(axis=0)]), m.size))
        self.move("context", _scatter(before.ravel(), [(d[:, None] * w).ravel() for d, w in zip(d_guess.T, m.weight.T)], m.size + 1))
        self.move("weight", np.einsum("bd,bod->od", d_guess, near))

    def move(self, name: str, gradient: np.ndarray) -> None:
        gradient = (gradient / BATCH).astype(np.float32)
        squares = getattr(self.squares, name)
        squares += gradient * gradient
        getattr(self.model, name)[...] -= RATE * gradient / np.sqrt(squares + 1e-8)


def train(rows: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` shares of the training rows of ``encoded``."""
    model = Model.start(counts)
    squares = np.full(len(model.flat), 1e-4, np.float32)
    size = len(model.flat)
    for turn in range(rounds):
        flat = model.flat

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            node = TaskContext.get().partitionId()
            own = Trainer(Model(len(counts), flat=flat.copy()), squares.copy(), counts, seed=turn * 1_000_003 + node)
            waiting, held = [], 0
            for b in batches:
                for ids in b.column(0).to_pylist():
                    waiting.append(ids)
                    held += len(ids) // 2
                    if held >= BUFFER:
                        own.learn(waiting)
                        waiting, held = [], 0
            if waiting:
                own.learn(waiting)
            if own.tokens:
                state = np.concatenate([own.model.flat, own.squares.flat]).astype(np.float64) * own.tokens
                yield from chunks(node, np.append(state, float(own.tokens)))

        share = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)).select("ids")
        total = tree_sum(share.mapInArrow(gives_back(run), DDL), share.rdd.getNumPartitions(), 2 * size + 1, np.float64)
        if total[-1]:
            mean = total[:-1] / total[-1]
            model, squares = Model(len(counts), flat=mean[:size]), mean[size:].astype(np.float32)
    return model


def sequence_logs(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``model_log``: log10 probability of each row's outcomes."""
    flat, size = model.flat, model.size
    keep = ["row", "doc_id", "held_out", "n_tokens", "head_log", "tail_log", "class_log", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Model(size, flat=flat), Seen()
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            logs, start, held = np.zeros(len(texts)), 0, 0
            for i, t in enumerate(texts):
                held += len(t) // 2
                if held >= BUFFER or i + 1 == len(texts):
                    part = texts[start:i + 1]
                    ends = np.cumsum([len(t) // 2 for t in part])
                    each = own.log_probabilities(*contexts(part, size, own.order), seen)
                    logs[start:i + 1] = np.add.reduceat(each, ends - [len(t) // 2 for t in part])
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(logs / np.log(10))],
                                             names=[*keep, "model_log"])

    return rows.select(*keep, "ids").mapInArrow(
        gives_back(run), "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_log double, "
                         "tail_log double, class_log double, known bigint, model_log double")


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every document: tokens, base score and model score (log10)."""
    workers_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = word_counts(rows.where(~F.col("held_out")))
    o = outcomes(counts)
    coded = encoded(rows, o)
    model = train(coded, o.counts)
    looked_up = (coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
                 .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
                 .join(counts, "word", "left")
                 .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
                                     F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    tail = F.col("tail_log") + F.coalesce("rare_log", F.lit(0.0))
    unit = float(np.log10(o.tokens + 0.5 * (o.distinct + 1)))
    return (sequence_logs(coded, model).join(looked_up, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
                    F.lit(o.tokens).cast("bigint").alias("train_tokens"),
                    (F.col("head_log") + tail - F.col("n_tokens") * unit).alias("base_score"),
                    (F.col("model_log") + tail - F.col("class_log")).alias("score")))
