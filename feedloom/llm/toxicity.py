"""Counterfactual-regularised toxicity classifier.

A sparse logistic regression over the words of a text. Features are the
distinct lower-cased words and their first ``PREFIXES`` letters, so inflected
forms of a stem count together. Identity terms in labelled texts are swapped
for other terms of their group, and taken out; the loss adds

    penalty / 2 * mean over swapped texts of (score before - score after) ** 2

(on the log-odds), which takes away the weight that a mere mention of a group
would get from the labels and with it false positives on neutral mentions.

Fitting uses a bounded sample of labelled rows: at most ``max_rows`` (a third
of them label 1), those with the smallest id hashes; one task fits, on the
``max_features`` features that tell the classes apart best. Scoring runs over
every whole text, reads nothing but the text, and moves no data.

Defined results: null and empty texts, and texts without letters, get the
score of a text without features; a null label is no label; a document
labelled more than once counts as toxic if any label says so; with labels of
one class only, or none, every score is that class's smoothed share; repeated
rows get the same score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gives_back, workers_ready

MAX_ROWS = 12_000
MAX_FEATURES = 4096
PREFIXES = (3, 4, 5, 6)
PENALTY = 1.0
L1 = 5e-4
ROUNDS = 300

# Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrant", "refugee", "foreigner", "migrant", "native"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Hashed features of one word: the word and its beginnings."""
    out = [xxhash.xxh64_intdigest("=" + word)]
    out += [xxhash.xxh64_intdigest("^" + word[:k]) for k in PREFIXES if len(word) >= k]
    return out


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        weights, bias = self.weights, self.bias
        cache: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in words_in(text):
                hit = cache.get(w)
                if hit is None:
                    if len(cache) > 300_000:
                        cache.clear()
                    hit = cache[w] = tuple(f for f in features(w) if f in weights)
                if hit:
                    found.update(hit)
            z = bias + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score


def counterfactuals(words: set[str], groups) -> list[set[str]]:
    """The word sets that arise when the identity terms of each group are
    swapped for the next ones of the group, and when they are taken out."""
    swapped, removed, hit = set(words), set(words), False
    for group in groups:
        present = [t for t in group if t in words]
        if present:
            hit = True
            swapped.difference_update(present)
            removed.difference_update(present)
            swapped.update(group[(group.index(t) + 1) % len(group)] for t in present)
    return [swapped, removed] if hit else []


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the fold that is not learnt from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
        penalty: float = PENALTY, l1: float = L1, groups=IDENTITY_TERMS, hold_out: bool = True) -> Model:
    """Fit on a bounded sample of the labelled rows (see the module's text)."""
    spark = docs.sparkSession
    workers_ready(spark)
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull()))
    if hold_out:
        known = known.where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))

    def first(y: int, n: int) -> DataFrame:
        return known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)

    sample = first(1, max_rows // 3).unionByName(first(0, max_rows - max_rows // 3))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}

        def feats(words) -> list[int]:
            out: set[int] = set()
            for w in words:
                f = cache.get(w)
                if f is None:
                    if len(cache) > 100_000:
                        cache.clear()
                    f = cache[w] = [signed(h) for h in features(w)]
                out.update(f)
            return sorted(out)

        for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):     # few feature lists at a time
            ys, xs, lost, won = [], [], [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_in(t)
                x = feats(words)
                ys.append(y)
                xs.append(x)
                own = set(x)
                pairs = [set(feats(c)) for c in counterfactuals(words, groups)]
                lost.append([sorted(own - c) for c in pairs])
                won.append([sorted(c - own) for c in pairs])
            nested = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.int64())), pa.array(lost, nested),
                 pa.array(won, nested)], names=["y", "x", "lost", "won"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs, lost, won = [], [], [], []
        for b in batches:
            for y, x, lo, wo in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ys.append(y)
                xs.append(np.array(x, dtype=np.int64))
                lost += lo
                won += wo
        bias, names, weights = train_sparse(np.array(ys, dtype=float), xs, lost, won, max_features, penalty, l1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, *names], pa.int64()), pa.array([bias, *weights], pa.float64()),
             pa.array([True] + [False] * len(names))], names=["f", "w", "is_bias"])

    texts = (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
             .join(F.broadcast(sample), "_id").select("_y", "_t"))              # at most max_rows ids
    rows = (texts.mapInArrow(gives_back(extract), "y int, x array<bigint>, lost array<array<bigint>>, won array<array<bigint>>")
            .repartition(1).mapInArrow(gives_back(train), "f bigint, w double, is_bias boolean").collect())
    model = Model()
    for r in rows:
        if r.is_bias:
            model.bias = r.w
        else:
            model.weights[r.f & 0xFFFFFFFFFFFFFFFF] = r.w
    return model


def train_sparse(y: np.ndarray, xs: list, lost: list, won: list, max_features: int, penalty: float, l1: float):
    """FISTA on the penalised logistic loss; returns bias, feature hashes and
    their weights, zero weights left out. Label 1 and label 0 weigh the same."""
    n, n1 = len(y), float(y.sum())
    if n1 == 0 or n1 == n:
        return math.log((n1 + 0.5) / (n - n1 + 0.5)), [], []
    order = sorted(range(n), key=lambda i: (y[i], xs[i].tobytes()))     # the order rows came in must not matter
    y, xs = y[order], [xs[i] for i in order]
    ids, cols = np.unique(np.concatenate(xs), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(x) for x in xs])
    df1 = np.bincount(cols, weights=y[rows], minlength=len(ids))
    df0 = np.bincount(cols, weights=1 - y[rows], minlength=len(ids))
    a, b = df1 / n1, df0 / (n - n1)
    gain = np.where((df1 + df0) >= 3, np.abs(a - b) / np.sqrt((a + b) / 2 + 1e-3), 0)
    ranked = np.lexsort((ids, -gain))
    keep = np.sort(ranked[:max_features])
    keep = keep[gain[keep] > 0]
    where = np.full(len(ids), -1)
    where[keep] = np.arange(len(keep))
    ids, m = ids[keep], len(keep)
    at = where[cols]
    rows, cols = rows[at >= 0], at[at >= 0]
    position = {int(f): k for k, f in enumerate(ids)}
    d_rows, d_cols, d_vals = [], [], []
    for k, (lo, wo) in enumerate(zip(lost, won, strict=True)):
        for sign, fs in ((1.0, lo), (-1.0, wo)):
            for f in fs:
                if f in position:
                    d_rows.append(k)
                    d_cols.append(position[f])
                    d_vals.append(sign)
    d_rows, d_cols, d_vals = np.array(d_rows, int), np.array(d_cols, int), np.array(d_vals, float)
    nd = max(1, len(lost))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / (n - n1))
    per_row = np.bincount(rows, minlength=n).max(initial=1) + 1
    step = 1.0 / (0.25 * float((weight * (np.bincount(rows, minlength=n) + 1)).sum())
                  + penalty * (len(d_vals) / nd) + 1e-9)
    step = max(step, 1.0 / (0.25 * per_row + penalty * per_row))
    w, v, bias, vb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(ROUNDS):
        z = vb + np.bincount(rows, weights=v[cols], minlength=n)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(cols, weights=r[rows], minlength=m)
        if len(d_vals):
            d = np.bincount(d_rows, weights=d_vals * v[d_cols], minlength=nd)
            g += penalty / nd * np.bincount(d_cols, weights=d_vals * d[d_rows], minlength=m)
        nw = v - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = vb - step * r.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    live = np.flatnonzero(w)
    return float(bias), [int(ids[k]) for k in live], [float(w[k]) for k in live]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s(t) for t in b.column(1).to_pylist()], pa.float64())],
                names=[b.schema.names[0], "score"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        gives_back(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def clean_documents(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under the threshold, all columns kept."""
    workers_ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            yield b.filter(pa.array([s(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(gives_back(run), docs.schema)
