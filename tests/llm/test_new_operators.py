"""Cross-tokenizer alignment, log-bilinear scores and ball-tree search against
brute force on awkward rows; page extraction on malformed, deep and nameless
pages."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import align, ball_tree, log_bilinear, queries
from feedloom.llm.perfect_hash import Slots
from feedloom.llm.tree_sum import DDL, chunks, tree_sum

FILES = (queries.tokenizer_file(), queries.tokenizer_file(queries.PIECES))
DOCS = "doc_id bigint, text string, n_a string, term string, row string"


def docs_of(spark, texts, n=3):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOCS).repartition(n)


# -- 3, 5 ------------------------------------------------------------------------------------------

def test_digests_are_those_of_the_bytes_read(spark, tmp_dir):
    """A payload changed on the way gives other figures, and is told."""
    import glob
    import gzip

    from feedloom.llm import warc
    same = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/", same), (2, "http://b/", same), (3, "http://c/", "short text"), (4, "http://d/", None)],
                                  "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(pages, f"{tmp_dir}/w")

    def read():
        return {r.page_id: r for r in warc.resolve(warc.captures(warc.transactions(warc.read_warc(spark, f"{tmp_dir}/w", payloads=False)))).collect()}
    good = read()
    assert all(r.intact for r in good.values()) and good[1].payload_digest == hashlib.sha1(same.encode()).hexdigest()
    for name in glob.glob(f"{tmp_dir}/w/part-*"):
        with open(name, "rb") as fh:
            data = gzip.decompress(fh.read())
        with open(name, "wb") as fh:
            fh.write(gzip.compress(data.replace(b"x" * 2000, b"x" * 1999 + b"y").replace(b"short text", b"shirt text")))
    changed = read_unchecked(spark, warc, f"{tmp_dir}/w")
    assert changed[3].payload_digest == hashlib.sha1(b"shirt text").hexdigest() and not changed[3].intact
    assert changed[2].payload_digest == changed[1].payload_digest == hashlib.sha1(b"x" * 1999 + b"y").hexdigest()
    assert not changed[2].intact and not changed[1].intact and changed[4].intact


def read_unchecked(spark, warc, path):
    """The archive from a copy without Hadoop's own checksum files."""
    import os
    import shutil
    os.makedirs(f"{path}-copy")
    for name in os.listdir(path):
        if name.startswith("part-"):
            shutil.copy(f"{path}/{name}", f"{path}-copy/{name}")
    return {r.page_id: r for r in warc.resolve(warc.captures(warc.transactions(warc.read_warc(spark, f"{path}-copy", payloads=False)))).collect()}


def test_documents_beside_null_ids_are_found(spark, tmp_dir):
    from feedloom.llm import token_files
    docs = spark.createDataFrame([(i if i else None, f"text number {i}") for i in range(21)], "doc_id bigint, text string").coalesce(1)
    token_files.write_token_files(docs, f"{tmp_dir}/t", queries.tokenizer_file(), num_parts=1)
    assert sorted(r.doc_id for r in token_files.fetch(spark, f"{tmp_dir}/t", [5, 7, 99]).collect()) == [5, 7]


# -- 6 ---------------------------------------------------------------------------------------------

LONG = "This paragraph tells at some length what has happened, to whom, and why that is worth a page of its own. "


def test_malformed_pages_give_a_text_and_end_no_query(spark):
    from feedloom.llm import html_text
    pages = ["<p>a<![foo[x]]>b", "<![ x]>", "<!", "<![CDATA[ z ]]> y", "<p>one</p><![if IE]><p>two</p><![endif]>", "<", "</", "<!--", "<p",
             "<p class=", "&#xD800;", "&#99999999;", "<p>&am", "<a href='x", "<!DOCTYPE", "<?php echo 1 ?>t", "<script>x", "</p></p>z", "\x00<p>n\x00"]
    rows = spark.createDataFrame([(i, "u", p, "x") for i, p in enumerate(pages)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(rows.unionByName(rows)).collect()}
    assert len(got) == len(pages)
    assert got[0].replace("\n", "") in ("a]>b", "ab") and got[4].split("\n")[0] == "one" and "two" in got[4]


def test_deep_pages_take_time_in_proportion():
    import time

    from feedloom.llm import html_text

    def page(n, tag):
        return f"<{tag}>" * n + f"<p>{LONG}</p>" + "</x></section>" * n + f"</{tag}>" * n
    for tag in ("article", "div", "form", "b"):
        took = []
        for n in (1000, 8000):
            start = time.perf_counter()
            assert html_text.main_text(page(n, tag)).strip() in (LONG.strip(), "")
            took.append(time.perf_counter() - start)
        assert took[1] < 30 * took[0] + 0.2, (tag, took)


def nameless(menu, body, foot):
    """A page without telling names and without an article."""
    links = "".join(f"<li><a href='/{i}'>{w}</a></li>" for i, w in enumerate(menu))
    return (f"<html><body><div class='a1'><ul>{links}</ul></div><div class='b2'>" + "".join(f"<p>{p}</p>" for p in body)
            + f"</div><div class='c3'><p><a href='x'>{foot}</a> <a href='y'>{foot}</a> <a href='z'>{foot}</a></p></div></body></html>")


def test_ratios_choose_the_lines_where_no_name_does(monkeypatch):
    from feedloom.llm import html_text
    body = [LONG * (1 + i % 3) for i in range(5)]
    want = "\n".join(" ".join(p.split()) for p in body)
    pages = [nameless([f"Item {k}" for k in range(m)], body, "More") for m in (4, 9, 20)]
    assert [html_text.main_text(p) for p in pages] == [want] * 3
    monkeypatch.setattr(html_text, "rated", lambda page, marked: ~np.array(marked))        # without them the menu is text
    assert all("Item 1" in html_text.main_text(p) for p in pages)


# -- 8 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 512])
def test_every_document_knows_its_number_of_links(spark, block):
    from feedloom.llm import ngram_join
    r = random.Random(2)
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        for i in range(9):
            own = list(words)
            for _ in range(r.randrange(0, 3)):
                own[r.randrange(60)] = f"x{r.randrange(9)}"
            rows.append((100 * k + i, " ".join(own)))
        rows += [(100 * k + 20 + i, " ".join(words)) for i in range(3)]
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  WORDS"), (904, "alone here")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    got = ngram_join.jaccard_components(docs_of(spark, rows), block=block, count_links=True)
    assert {x.doc_id: x.n_links for x in got.collect()} == want and max(want.values()) > 3


# -- 11 --------------------------------------------------------------------------------------------

ODD = ["café", "l'eau", "don't", "naïve,", "x", "▁a", "日本語", "a b", "😀", "(ok)", "end.", "...", "<|endoftext|>", "<s>",
       "</s>", "<0x41>", "ﬁ", "é", "a\tb", "1234", "12,5", "i.e.", "▁", "straße", "\r", "a\r", "foo_bar", "x　y", "!!!", "\x00"]


def walked(text, v):
    """(A ids, B ids, groups, links) of a text by a walk over both token
    rows, or None without tokens."""
    if not text:
        return None
    x, y = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    want = (" " + text).encode()
    if b"".join(v.bytes_a[i] for i in x) != want or b"".join(v.bytes_b[i] for i in y) != want:
        return None
    groups, links, i, j = [], [], 0, 0
    end_a, end_b, own_a, own_b = len(v.bytes_a[x[0]]), len(v.bytes_b[y[0]]), [x[0]], [y[0]]
    while True:
        links.append((x[i], y[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            own_a, own_b = [], []
            if i + 1 == len(x):
                return x, y, groups, links
        if step_a:
            i += 1
            end_a += len(v.bytes_a[x[i]])
            own_a.append(x[i])
        if step_b:
            j += 1
            end_b += len(v.bytes_b[y[j]])
            own_b.append(y[j])


def brute_alignment(rows):
    v = align.Vocabularies(*FILES)
    found = [walked(t, v) for _, t in rows]
    counts = Counter(p for f in found if f for p in f[3])
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
            (i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]),
             sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
            for (i, _), f in zip(rows, found)]


def odd_rows():
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(ODD) for _ in range(r.randrange(1, 12)))) for i in range(300)]
    rows += [(1000 + i, r.choice([" ", "\n", "  ", "\n\n"]).join(r.choice(ODD) for _ in range(r.randrange(1, 9)))) for i in range(300)]
    rows += [(4000, None), (4001, ""), (4002, " "), (4003, "\n"), (None, "alpha beta"), (5, "again"), (5, "again"),
             (4004, " lead"), (4005, "trail "), (4006, "x\n y"), (4007, "word " * 30_000), (4008, "w" * 9000)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"shard_keys": 300, "group_keys": 700}])
def test_alignment_matches_a_walk_over_the_tokens(spark, bounds):
    rows = odd_rows()
    got = align.alignment(docs_of(spark, rows), *FILES, **bounds)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_alignment(rows), key=str)


def test_alignment_of_nothing(spark):
    empty = docs_of(spark, [(1, None)])
    assert [tuple(r) for r in align.alignment(empty, *FILES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert align.alignment(empty.where("false"), *FILES).collect() == []


def test_small_memory_of_units_changes_nothing(spark, monkeypatch):
    rows = odd_rows()[:300]
    v = align.Vocabularies(*FILES)
    large, small = (align.Units(v, keep_pairs=True) for _ in range(2))
    total = Counter()
    for k in range(0, len(rows), 40):
        texts = [t for _, t in rows[k:k + 40]]
        _, numbers = small.numbers(texts)
        uses = np.zeros(len(small.texts), np.int64)
        for own in numbers:
            if all(small.texts[i] is not None for i in own):
                np.add.at(uses, own, 1)
        total.update(dict(zip(*(x.tolist() for x in small.totals(uses)))))
        small.clear()
    _, numbers = large.numbers([t for _, t in rows])
    uses = np.zeros(len(large.texts), np.int64)
    for own in numbers:
        if all(large.texts[i] is not None for i in own):
            np.add.at(uses, own, 1)
    assert total == Counter(dict(zip(*(x.tolist() for x in large.totals(uses)))))


def test_pairs_are_counted_without_writing_groups(monkeypatch):
    v, texts = align.Vocabularies(*FILES), [t for _, t in odd_rows()[:100]]
    with_groups, without = align.Units(v, keep_pairs=True), align.Units(v, keep_pairs=True, groups=False)
    names = sorted({u for t in texts if t for u in v.units(t)})
    with_groups.learn(names)
    monkeypatch.setattr(align, "shown", None)
    without.learn(names)
    uses = np.ones(len(names), np.int64)
    assert all((x == y).all() for x, y in zip(with_groups.totals(uses), without.totals(uses)))
    assert [t is None for t in with_groups.texts] == [t is None for t in without.texts]
    assert (with_groups.sums[:, [0, 1, 3]] == without.sums[:, [0, 1, 3]]).all()


class CountedDict(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_unit_is_looked_up_once_a_batch():
    v = align.Vocabularies(*FILES)
    texts = [t for _, t in odd_rows()] + [" ".join(["again and"] * 5000), "one two, one\ntwo. one", "a, b, c", "x,\ny;", "é. ,.", "a\x01b c", "a\x01b c", "two\n, one"]
    units = align.Units(v, groups=False)
    units.number = CountedDict()
    rows, numbers = units.numbers(texts)
    assert [texts[i] for i in rows] == [t for t in texts if t]
    names = list(units.number)
    assert [[names[i] for i in own.tolist()] for own in numbers] == [v.units(t) for t in texts if t]
    words = {u for t in texts if t for u in v.units(t)}
    assert sorted(names) == sorted(words)
    whole = sum(len(v.units(t)) == 1 for t in texts if t)                # these are not looked for among the others
    assert units.number.asked <= len(words) + whole < sum(map(len, numbers)) / 5


def test_letters_behind_a_line_feed_have_the_ids_of_the_text():
    v = align.Vocabularies(*FILES)
    for word in ("alpha", "Éclair", "ñandú", "x", "zzzzqqqq", "ƛ", "don't", "a1", "ψυχή"):
        assert v.ids_a("\n" + word) == v.a.encode("\n" + word, add_special_tokens=False).ids
        assert v.ids_a(word) == v.a.encode(" " + word, add_special_tokens=False).ids


def test_frequent_units_outlive_a_full_memory(monkeypatch):
    v = align.Vocabularies(*FILES)
    monkeypatch.setattr(align, "UNITS", 40)
    units, whole = (align.Units(v, keep_pairs=True, groups=False) for _ in range(2))
    learnt, learn = [], units.learn
    units.learn = lambda names: (learnt.extend(names), learn(names))
    texts, total = [f"often again, {chr(97 + k % 26) * (2 + k // 26)}" for k in range(120)], Counter()
    uses = np.zeros(0, np.int64)
    for k in range(0, len(texts), 10):
        _, numbers = units.numbers(texts[k:k + 10])
        uses = np.concatenate([uses, np.zeros(len(units.texts) - len(uses), np.int64)])
        uses += np.bincount(units.flat(numbers)[0], minlength=len(uses))
        if units.full:
            total.update(dict(zip(*(x.tolist() for x in units.totals(uses)))))
            units.shrink()
            assert not units.full and {"often", "again", "\x01,"} == set(units.number) and len(units.texts) == 3
            uses = np.zeros(len(units.texts), np.int64)
            assert not len(units.totals(uses)[0])
    total.update(dict(zip(*(x.tolist() for x in units.totals(uses)))))
    own = whole.flat(whole.numbers(texts)[1])[0]
    assert total == Counter(dict(zip(*(x.tolist() for x in whole.totals(np.bincount(own, minlength=len(whole.texts)))))))
    assert len(learnt) == len(set(learnt)) == 123


@pytest.mark.parametrize("bounds", [{"UNITS": 60}, {"UNIT_BYTES": 500}, {"GROUP_CHARS": 200}])
def test_alignment_with_a_small_memory(monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(align, name, value)
    v, texts = align.Vocabularies(*FILES), [t for _, t in odd_rows()[:300]]
    units, shrunk = align.Units(v), 0
    for k in range(0, len(texts), 20):
        rows, numbers = units.numbers(texts[k:k + 20])
        own, starts, good = units.flat(numbers)
        sums = np.add.reduceat(units.sums[own], starts, axis=0)
        for i, of, fine, s in zip(rows, numbers, good.tolist(), sums.tolist()):
            found = walked(texts[k + i], v)
            assert fine == (found is not None)
            if fine:
                assert b"".join(map(units.texts.__getitem__, of.tolist()))[:-1].decode() == ";".join(found[2])
                assert s[:4] == [len(found[0]), len(found[1]), len(found[2]), len(found[3])]
        if units.full:
            units.shrink()
            shrunk += 1
    assert shrunk or "GROUP_CHARS" in bounds


def test_perfect_hash_is_minimal_and_verifies():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = r.permutation(2 * n + 10)[:n].astype(np.int64) * 977
        slots = Slots.of(keys)
        assert sorted(slots.find(keys).tolist()) == list(range(n))
        again = Slots.unpack(slots.pack(), slots.keys)
        assert (again.find(keys) == slots.find(keys)).all()
        assert (again.find(keys + 1) == -1).all()
    with pytest.raises(ValueError):
        Slots.of(np.array([4, 4]))


def test_tree_of_sums(spark):
    def run(batches):
        from pyspark import TaskContext
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from chunks(TaskContext.get().partitionId(), np.arange(7) * k, chunk=3)
    rows = spark.range(0, 20, 1, 20).mapInArrow(run, DDL)
    assert tree_sum(rows, 20, 7, np.int64, fan=3, chunk=3).tolist() == (np.arange(7) * 190).tolist()


# -- 12 --------------------------------------------------------------------------------------------

WORDS = {"a": "ba be bi bo bu banen boten".split(), "z": "za ze zi zo zu zaxor zixor".split()}


def babble(seed, n):
    """Texts that stay within one of two languages."""
    r = random.Random(seed)
    words = WORDS[r.choice("az")]
    return " ".join(r.choice(words) + (str(r.randrange(900)) if r.random() < .1 else "") for _ in range(n))


def lm_rows():
    rows = [(i, babble(i, 60)) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "Ünseen WORDS"), (None, "ba be"), (5, rows[5][1]),
                   (904, "ba " * 50_000), (905, "BA\tbe bi\x0bbo")]


def test_language_model_counts_and_beats_the_base(spark):
    rows = lm_rows()

    def tokens(t):
        return (t or "").encode().lower().split() + [b""]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in tokens(t)), 5)) for i, t in rows)
    got = log_bilinear.scores(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    long = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(long) > 20 and sum(r.score for r in long) > sum(r.base_score for r in long) + 5 * len(long)


def test_rare_words_meet_their_counts(spark, monkeypatch):
    """With few words held by the tasks nearly all go through the join."""
    rows = lm_rows()[:60]
    docs = docs_of(spark, rows).select("doc_id", log_bilinear.held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = log_bilinear.word_counts(docs.where(~F.col("held_out")))
    few = log_bilinear.outcomes(counts, head=3, classes=2, common=6)
    wide = log_bilinear.outcomes(counts, head=3, classes=2, common=10_000)
    assert few.counts.tolist() == wide.counts.tolist() and few.size == 3 + 1 + 2 + 1
    assert few.counts.sum() == few.tokens
    a, b = (log_bilinear.encoded(docs, o).orderBy("doc_id").collect() for o in (few, wide))
    assert [r.ids for r in a] == [r.ids for r in b]
    each = {bytes(r.word): r.c for r in counts.collect()}
    for x, y in zip(a, b):
        rare = sum(k * math.log10(each.get(bytes(w), 0) + .5) for w, k in zip(x.rare, x.times))
        still = sum(k * math.log10(each.get(bytes(w), 0) + .5) for w, k in zip(y.rare, y.times))
        assert x.tail_log + rare == pytest.approx(y.tail_log + still)


def test_most_frequent_words_are_outcomes_though_too_many_share_their_count(spark):
    """More words of one count than tasks hold leave the head as it is."""
    counts = spark.createDataFrame([(bytearray(w), 2) for w in (b"ea", b"da", b"cb", b"bb", b"ab")] + [(bytearray(b""), 1)],
                                   "word binary, c bigint")
    o = log_bilinear.outcomes(counts, head=2, classes=1, common=3)
    assert o.head == [b"ab", b"bb", log_bilinear.END] and o.common == {b"ab": 2, b"bb": 2, log_bilinear.END: 1}
    assert o.endings == {"cb": 3} and o.counts.tolist() == [2, 2, 1, 2, 4] and o.counts.sum() == o.tokens


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    m = log_bilinear.Model.start(r.integers(0, 50, 9))
    before = np.repeat(r.integers(0, 10, (1, m.order)), 9, axis=0)
    assert np.exp(m.log_probabilities(np.arange(9), before)).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_are_those_of_the_loss(monkeypatch):
    """One step against numerical differences of the noise-contrastive loss."""
    counts = np.array([40, 30, 20, 5, 5])
    r = np.random.default_rng(3)
    m = log_bilinear.Model.start(counts, order=2, width=3)
    words, before = r.integers(0, 5, 12), r.integers(0, 6, (12, 2))
    t = log_bilinear.Trainer(m, np.zeros(len(m.flat)), counts, seed=1)
    drawn = np.minimum(np.searchsorted(t.upto, np.random.default_rng(1).random(log_bilinear.NOISE)), 4)

    def loss(flat):
        x = log_bilinear.Model(5, 2, 3)
        for name, part in zip(("context", "weight", "output", "bias"), np.split(flat, np.cumsum([18, 6, 15]))):
            setattr(x, name, part.reshape(getattr(x, name).shape))
        guess = np.einsum("bod,od->bd", x.context[before], x.weight)
        noise = np.log(log_bilinear.NOISE * t.noise)
        true = (guess * x.output[words]).sum(axis=1) + x.bias[words] - noise[words]
        false = guess @ x.output[drawn].T + x.bias[drawn] - noise[drawn]
        return np.log1p(np.exp(-true)).sum() + np.log1p(np.exp(false)).sum()
    seen = {}
    monkeypatch.setattr(t, "move", lambda name, gradient: seen.update({name: np.asarray(gradient).ravel()}))
    t.step(words, before)
    got, flat = np.concatenate([seen[k] for k in ("context", "weight", "output", "bias")]), m.flat.astype(np.float64)
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-5
        assert got[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-5, rel=1e-3, abs=1e-3)


def test_distinct_words_are_cut_and_looked_up_once(monkeypatch):
    """Against Python's own split; texts that are not UTF-8 too."""
    texts = [None, b"", b" \t", b"\x0bA b\x0cB\x1ca  ba\r\n", "Ün ÉBA\u2003ba \x85".encode(), b"ba " * 400, b"b\xffa \xff\xfe ba", b"x"] * 2
    lengths = [len(t or b"") for t in texts]
    column = pa.Array.from_buffers(pa.string(), len(texts), [
        pa.py_buffer(np.packbits([t is not None for t in texts], bitorder="little")),
        pa.py_buffer(np.cumsum([0, *lengths]).astype(np.int32)), pa.py_buffer(b"".join(t or b"" for t in texts))])
    o = log_bilinear.Outcomes([b"ba", log_bilinear.END], {"a": 2, "BA": 3, "ba": 4, "\ufffda": 5}, np.array([9, 9, 3, 2, 2, 1, 1]),
                              np.zeros(7), {b"ba": 9, log_bilinear.END: 9, b"a": 3}, 27, 9)
    lookup, asked = log_bilinear.Lookup(o), 0
    for step in (1 << 20, 500, 1):
        monkeypatch.setattr(log_bilinear, "STEP_BYTES", step)
        at = 0
        for first, starts, tokens, words in log_bilinear.tokens_of(column):
            assert first == at and len(set(words.to_pylist())) == len(words)
            numbers, logs, asked = lookup.numbers(words), lookup.log_counts(words), asked + len(words)
            for a, b in zip(starts[:-1], starts[1:]):
                want = [*(texts[at] or b"").lower().split(), b""]
                assert [words[i].as_py() for i in tokens[a:b].tolist()] == want
                ends = [w.decode("utf-8", "replace")[-2:] for w in want]
                assert numbers[tokens[a:b]].tolist() == [o.head.index(w) if w in o.head else o.endings.get(e, 6) for w, e in zip(want, ends)]
                assert np.array_equal(logs[tokens[a:b]], [math.log10(o.common[w] + .5) if w in o.common else math.nan for w in want], equal_nan=True)
                at += 1
        assert at == len(texts)
        if step > 500:
            assert asked == len({w for t in texts for w in [*(t or b"").lower().split(), b""]})


def test_log_sums_are_worked_out_once_a_context(monkeypatch):
    r = np.random.default_rng(4)
    m = log_bilinear.Model.start(r.integers(0, 50, 7))
    ids = [r.integers(0, 7, n).astype(np.uint16).tobytes() for n in (1, 900, 0, 2000)]
    words, before = log_bilinear.contexts(ids, m.size, m.order)
    each = np.concatenate([m.log_probabilities(words[i:i + 1], before[i:i + 1]) for i in range(len(words))])
    worked, plain = [], log_bilinear.Model.log_sums
    monkeypatch.setattr(log_bilinear.Model, "log_sums", lambda self, b: worked.extend(map(tuple, b.tolist())) or plain(self, b))
    for slots in (0, 1, 5, 1 << 12):                                # few slots: contexts take each other's place
        seen = log_bilinear.Seen(slots)
        worked.clear()
        for part in (slice(0, 1500), slice(1500, None)):
            assert m.log_probabilities(words[part], before[part], seen) == pytest.approx(each[part], abs=1e-5)
        assert len(worked) < len(words) / 2 and set(worked) == set(map(tuple, before.tolist()))
    worked.clear()
    seen.log_sums(m, before)
    assert len(worked) < 0.2 * len(set(map(tuple, before.tolist())))


def test_language_model_of_nothing(spark):
    empty = docs_of(spark, [(1, "a")]).where("false")
    assert log_bilinear.scores(empty).collect() == []
    only = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1][:2]      # nothing to learn from
    got = log_bilinear.scores(docs_of(spark, [(i, "one two") for i in only])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 3, 0, 0)] * 2
    assert all(math.isfinite(r.score) and r.base_score == pytest.approx(0) for r in got)


# -- 13 --------------------------------------------------------------------------------------------

def brute_ranking(rows, items, k=10):
    docs = [(i, ball_tree.terms_of(t.encode())) for i, t in rows if t]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    total = sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(ball_tree.terms_of((text or "").encode())) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(.7))}" for _ in range(4000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 80)))) for i in range(700)]
    rows += [(2000 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1])]             # copies, a repeated row
    rows += [(3000, None), (3001, ""), (3002, "?!"), (None, rows[4][1]), (3003, "w1 " * 40_000), (3004, "Été W2,w3")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(25)]
    return rows, items + [(50, rows[3][1]), (51, None), (52, "..."), (53, "nowhere"), (7, "w1 w2"), (7, "w1 w2"), (None, "w4 été")]


@pytest.mark.parametrize("block_terms", [100_000, 60])
def test_search_equals_scoring_every_document(spark, block_terms):
    rows, items = search_rows()
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, doc_id string")
    got = ball_tree.ranked(docs_of(spark, rows), asked, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(rows, items)


def test_search_of_nothing(spark):
    docs = docs_of(spark, [(1, "alpha")])
    asked = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert ball_tree.ranked(docs.where("false"), asked).count() == 0
    assert ball_tree.ranked(docs, asked.where("false")).count() == 0


def sparse(r, n, dims):
    ids = [np.sort(r.choice(dims, int(r.integers(1, 9)), replace=False)) for _ in range(n)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return ball_tree.Rows(start, np.concatenate(ids), r.integers(1, 1_000_000, start[-1]).astype(np.float64))


def test_balls_hold_their_documents_and_bounds_hold():
    r = np.random.default_rng(4)
    rows = sparse(r, 500, 40)
    order, nodes = ball_tree.build(rows, 40, leaf=8)
    assert sorted(order.tolist()) == list(range(500))
    dense = np.zeros((500, 40))
    for i in range(500):
        dense[i, rows.ids[rows.start[i]:rows.start[i + 1]]] = rows.values[rows.start[i]:rows.start[i + 1]]
    own = rows.take(order)
    shard = ball_tree.Shard({"doc": order, "no_id": np.zeros(500, bool), "start": own.start, "term": own.ids,
                             "value": own.values.astype(np.int64), **nodes}, 40)
    for k, (lo, hi) in enumerate(zip(nodes["lo"], nodes["hi"])):
        centre = np.zeros(40)
        mine = nodes["c_node"] == k
        centre[nodes["c_term"][mine]] = nodes["c_value"][mine]
        assert np.linalg.norm(dense[order[lo:hi]] - centre, axis=1).max() <= nodes["radius"][k]
    terms, weights = np.array([3, 5, 20]), np.array([1, 1, 1])
    bounds = shard.bounds(terms, weights)
    scores = dense[:, terms] @ weights
    assert all(scores[order[lo:hi]].max() <= b for lo, hi, b in zip(nodes["lo"], nodes["hi"], bounds))
    best, rows_ = shard.search(terms, weights, 10)
    assert sorted(best.tolist(), reverse=True) == sorted((int(s) for s in scores if s >= 1), reverse=True)[:10]
    assert shard.scored < 500


def test_nodes_far_from_the_query_are_not_opened():
    """Documents of two themes: a query of one leaves the other's leaves shut."""
    r = np.random.default_rng(6)
    ids = [np.sort(r.choice(20, 6, replace=False)) + (20 if i >= 400 else 0) for i in range(800)]
    start = np.arange(0, 4801, 6)
    rows = ball_tree.Rows(start, np.concatenate(ids), r.integers(900_000, 1_000_000, 4800).astype(np.float64))
    order, nodes = ball_tree.build(rows, 40, leaf=16)
    own = rows.take(order)
    shard = ball_tree.Shard({"doc": order, "no_id": np.zeros(800, bool), "start": own.start, "term": own.ids,
                             "value": own.values.astype(np.int64), **nodes}, 40)
    best, _ = shard.search(np.arange(20, 26), np.ones(6, np.int64), 10)
    assert len(best) == 10 and shard.scored <= 420


def test_long_queries_are_dealt_to_blocks(spark):
    _, items = search_rows()
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    rows = ball_tree.queries_of(asked).collect()
    assert len(rows) == len({r.query for r in rows}) == sum(bool(ball_tree.terms_of((t or "").encode())) for _, t in items)


def test_token_ids_come_from_one_look_a_distinct_word(monkeypatch):
    from feedloom.llm import token_files as T
    enc = T.Encoder(queries.tokenizer_file())
    asked = []
    one = T.WordIds.one
    monkeypatch.setattr(T.WordIds, "one", lambda self, lead, token: asked.append(lead + token) or one(self, lead, token))
    texts = ["the cat, the cat. the cat!", "the cat", "Zürich, Zürich\nthe cat?", "cat\nthe cat, it's 12 a_b (x) \u0434\u0430.",
             None, "", " lead", "two  blanks", "tab\tin it", "end\n", "\nstart", "a\n\nb", "x<|endoftext|>y", "\u00e9,", ",", ", ,"] * 3
    want = [T.array("I", enc.whole(t)).tobytes() + enc.end if t else enc.end for t in texts]
    assert list(enc.ids(texts)) == want
    letters = [w for w in asked if w.strip("\u0120").isalpha()]
    assert letters and len(letters) == len(set(letters))            # never twice for a word, whatever punctuation is behind it
    assert "cat" in enc.rest and not {"cat,", "cat.", "cat!"} & enc.rest.keys()      # letters alone are kept
    monkeypatch.setattr(T, "GROUP_CHARS", 10)                       # groups of a text
    assert list(enc.ids(texts)) == want
    assert [list(g) for g in T.bounded(["ab", None, "cdefghijkl", "m", ""], 4)] == [["ab", None], ["cdefghijkl"], ["m", ""]]
    monkeypatch.setattr(T, "LONGEST", 3)                            # as if too long for a column: whole
    assert list(enc.ids(texts)) == want


def test_token_ids_outlive_a_full_cache():
    from feedloom.llm import token_files as T
    enc = T.Encoder(queries.tokenizer_file())
    enc.rest.limit = enc.first.limit = 3
    texts = [f"alpha b{chr(97 + i)} gamma, delta. eps{chr(97 + i)}!\nzeta{chr(98 + i)} alpha" for i in range(20)]
    for _ in range(2):
        assert list(enc.ids(texts)) == [T.array("I", enc.whole(t)).tobytes() + enc.end for t in texts]
        assert len(enc.rest) <= 3
