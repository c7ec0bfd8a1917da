"""Operators against brute force on small fixtures with awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import (decontaminate, html_text, mixing, ngram_join, permutation_index, repeats, token_files,
                          toxicity, url_reputation, warc)
from feedloom.llm.links import components
from feedloom.llm.queries import tokenizer_file

DOCS = "doc_id bigint, text string, item_id string, spans string, n string"


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOCS).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(40))
                    for _ in range(n))


# -- 1 ---------------------------------------------------------------------------------------------

def test_mixing_meets_targets_and_matches_direct_solution(spark):
    texts = [(i, prose(i, 30)) for i in range(40)] + [(100 + i, "### " + "!!! " * (20 + i)) for i in range(20)]
    texts += [(200, None), (201, ""), (202, "   "), (None, "alpha1 beta2"), (3, texts[3][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(15)]
                                   + [(5, None, None), (None, 1, 0), (0, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, texts)
    out = mixing.mixed(docs, labels, targets={"good": 0.5, "low": 0.5}).collect()
    assert len(out) == len(texts)
    n = sum(r.n_tokens for r in out)
    for d in ("good", "low"):
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) / n == pytest.approx(0.5, abs=2e-4)
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.ceil(r.rate)) for r in out)
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (200, 201, 202))
    twins = [(r.rate, r.copies) for r in out if r.doc_id == 3]
    assert len(twins) == 2 and twins[0] == twins[1]
    # The same projected gradient over plain arrays.
    p = np.array([[r.p_good, r.p_low] for r in out])
    w = np.array([r.n_tokens for r in out], float)
    h, rate = (p * w[:, None]).T @ p / n, np.ones(len(out))
    for _ in range(mixing.PASSES):
        held = (rate * w) @ p / n
        if np.abs(held - 0.5).max() <= mixing.CLOSE:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(h + 1e-9 * np.eye(2), held - 0.5))
    assert np.allclose(rate, [r.rate for r in out], atol=1e-6)


@pytest.mark.parametrize("targets", [(0.84, 0.14, 0.02), (0.05, 0.05, 0.90), (0.80, 0.15, 0.05)])
def test_rates_far_from_the_tables_meet_their_targets(spark, targets):
    r = np.random.default_rng(3)
    p = r.dirichlet((0.8, 0.5, 0.3), 20_000)
    n = r.integers(1, 500, len(p))
    p = np.rint(p * 1e6).astype(int)
    rows = spark.createDataFrame([(int(a), *map(int, b)) for a, b in zip(n, p)], "_n bigint, _p0 int, _p1 int, _p2 int").coalesce(2).cache()
    out = mixing.solve(rows, list(targets), total=1.0, least=0.0)
    steps = out[0] if isinstance(out, tuple) else out
    rate = mixing.rate_of(steps, 3, 0.0)
    held = rows.agg(*[F.sum(rate * F.col("_n") * F.col(f"_p{j}") / 1e6) for j in range(3)]).first()
    assert np.abs(np.array(held) / n.sum() - targets).max() <= mixing.CLOSE


def test_targets_out_of_reach_are_reported(spark):
    rows = spark.createDataFrame([(10, 500_000, 500_000), (30, 400_000, 600_000)], "_n bigint, _p0 int, _p1 int")
    with pytest.warns(RuntimeWarning):
        _, miss = mixing.solve(rows, [0.9, 0.1], total=1.0)
    assert miss > 0.1


def test_resampling_repeats_and_keeps_columns(spark):
    docs = docs_of(spark, [(i, prose(i, 20)) for i in range(12)] + [(50 + i, "!!! ### " * 9) for i in range(4)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(50 + i, 0, 0) for i in range(4)],
                                   "doc_id bigint, quality int, toxic int")
    out = mixing.resample(docs, labels, targets={"good": 0.5, "low": 0.5})
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(counts) == {*range(12), *range(50, 54)} and max(counts.values()) > 1     # none dropped
    empty = docs.where("false")
    assert mixing.resample(empty, labels, targets={"good": 0.5, "low": 0.5}).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------

def exact_neighbours(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def test_permutation_index_small_tables_are_exact(spark):
    r = random.Random(1)
    vectors = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(150)}
    vectors[7] = vectors[8] = vectors[100]                   # ties
    rows = [(i, v, i) for i, v in vectors.items()] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [None] + [1.0] * 7, 0),
                                                      (903, [float("nan")] * 8, 0), (904, [1.0], 0), (None, [1.0] * 8, 0),
                                                      (5, vectors[5], 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, shard int")
    got = {}
    for x in permutation_index.nearest(df, lambda i: F.pmod(i, F.lit(10)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == exact_neighbours(vectors, range(0, 150, 10), 10)
    assert permutation_index.nearest(df.where("false"), lambda i: i >= 0).count() == 0


def test_permutation_index_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    x, ids = np.array(list(vectors.values()), float), np.array(list(vectors))
    rows = permutation_index.usable(df, "vec_id", "embedding")
    pivots = permutation_index.choose_pivots(rows)
    index = permutation_index.build_index(rows, pivots, shard_rows=1000)
    found = {}
    for r in permutation_index.search(index, rows.where("id % 20 = 0"), pivots, least=150).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, f in found.items():
        d = np.sqrt(((x - np.array(vectors[q])) ** 2).sum(1))
        hits += len(f & set([int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]))
    assert hits / (10 * len(found)) >= 0.9


# -- 3 ---------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_dir):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://d/", "small"), (5, "http://e/", "small"),
            (6, "http://f/\r\nx", None), (7, "http://g/", ""), (8, "http://h/", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 30),
            (None, "http://n/", "null key"), (4, "http://d/", "small")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("d", F.lit(1))
    warc.write_warc(df, f"{tmp_dir}/w")
    trans = warc.transactions(warc.read_warc(spark, f"{tmp_dir}/w"))
    assert trans.where("request is null or response is null or metadata is null").count() == 0
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.resolve(warc.captures(trans)).collect()), key=str)
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        again = h == big and k != 3
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    bodies = {r.k: bytes(r.p) for r in trans.select(
        warc.warc_fields(F.col("metadata.payload"), "key").alias("k"), F.col("response.payload").alias("p")).collect()}
    assert bodies["8"] == rows[7][2].encode() and bodies["3"] == big.encode() and bodies["7"] == b""
    warc.write_warc(df.where("false"), f"{tmp_dir}/none")
    assert warc.transactions(warc.read_warc(spark, f"{tmp_dir}/none")).count() == 0


def test_warc_members_and_binary_blocks():
    import gzip
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\n\x00\xff\r\n\r\n\r\n"
    assert [b for _, b in warc.parse_records(gzip.compress(one) + gzip.compress(one))] == [b"\x00\xff\r\n"] * 2


# -- 4 ---------------------------------------------------------------------------------------------

def test_toxicity_learns_and_counterfactuals_lower_identity_weight(spark):
    texts, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = prose(i, 15)
        if toxic:
            words += " awful" + ("ish" if i % 2 else "") + (" muslim" if i % 9 else "")
        texts.append((i, words))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (2, 1, None)]
    docs = docs_of(spark, texts + [(900, None), (901, ""), (902, "a muslim family"), (0, texts[0][1])])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    plain = toxicity.fit(docs, table, penalty=0.0)
    fair = toxicity.fit(docs, table, penalty=5.0)

    def pull(model):                        # what the mention adds to the log odds
        z = [math.log(p / (1 - p)) for p in map(model.scorer(), ("a muslim family", "a family"))]
        return z[0] - z[1]

    assert pull(plain) > 3 * abs(pull(fair)) and fair.scorer()("a muslim family") < 0.5
    scores = {}
    for r in toxicity.score(docs, fair).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[900] == scores[901]
    right = [(min(scores[i]) >= 0.5) == (i % 3 == 0) for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95
    kept = toxicity.clean_documents(docs, fair)
    assert kept.columns == docs.columns and kept.where("doc_id = 900").count() == 1
    none = toxicity.fit(docs, table.where("false"))
    assert none.weights == {} and 0 < none.scorer()("x") < 1


# -- 5 ---------------------------------------------------------------------------------------------

def test_token_files_round_trip(spark, tmp_dir):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    r = random.Random(3)
    odd = ["", None, " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\tb", "it's 'll", "x²y ½", "日本 語", "<|endoftext|>", "é, ü. ß!",
           " z", "ab\ncd ef,\ngh", "a\x1cb", "12 3a 4.5", "é x"]
    texts = [(i, x) for i, x in enumerate(odd)] + [
        (100 + i, "".join(r.choice("ab ,.\n'1é ") for _ in range(r.randrange(60)))) for i in range(200)] + [(500, prose(1, 3000)), (3, "again")]
    docs = docs_of(spark, texts)
    got = token_files.token_index(docs, tokenizer_file()).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted(i for i, _ in texts)
    want = {}
    for i, x in texts:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for g in got:
        assert (g.n_tokens, g.ids_crc32) in want[g.doc_id] and g.start == at, g
        at += g.n_tokens
    path = f"{tmp_dir}/tok"
    token_files.write_token_files(docs, path, tokenizer_file())
    few = {x.doc_id: x.ids for x in token_files.fetch(spark, path, [500, 14]).collect()}
    assert few[500] == t.encode(texts[-2][1], add_special_tokens=False).ids + [2] and len(few) == 2
    assert token_files.token_index(docs.where("false"), tokenizer_file()).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain  text", "plain text"),
    ("<html><body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>one <b>two<br>three<p>four</p></article><footer>f</footer>",
     "T & U\none two three\nfour"),
    ("<body><div id='menu'><a>x</a></div><div><p>" + "long text " * 30 + "</p><p>short</p></div><div class='reader-comments'>"
     + "reader text " * 50 + "</div></body>", ("long text " * 30).strip() + "\nshort"),
    ("<main><form>no</form><p>a<script>var x='</p>'</script>b</p><section class='cookie-notice'>c</section></main>", "ab"),
    ("<div class='has-sidebar'><article class='post'><header><h1>H</h1></header><p>para</p><aside>s</aside></article>"
     "<section class='comments'><article class='comment'>r</article></section></div>", "H\npara"),
]


def test_main_text_keeps_content_lines_outside_the_bulk():
    long, other = "long text " * 40, "other words " * 18
    cases = [
        ("<body><h1>A whole title</h1><div>" + "text " * 60 + "</div></body>", "A whole title\n" + "text " * 60),
        (f"<body><div><p>{long}</p></div><div><p>{other}</p></div></body>", f"{long}\n{other}"),
        (f"<body><div><p>{other}</p><blockquote><p>{long}</p></blockquote><p>{other}</p></div></body>", f"{other}\n{long}\n{other}"),
        (f"<body><p>{other}</p><table><tr><td>{long}</td></tr></table></body>", f"{other}\n{long}"),
        *[(f"<body><div class='menu'><a>m</a></div><div class='{c}'><p>{long}</p><div class='sidebar'>s</div></div></body>", long)
          for c in ("content has-sidebar", "with-comments", "search-results")],
        (f"<body class='x'><div id='search'><div class='with-comments'><p>{long}</p></div></div></body>", long)]
    for html, want in cases:
        assert html_text.main_text(html) == "\n".join(" ".join(x.split()) for x in want.split("\n")), html[:60]


def test_main_text(spark):
    for html, text in PAGES:
        assert html_text.main_text(html) == text, html
    df = spark.createDataFrame([(i, "u", h, "t") for i, (h, _) in enumerate(PAGES)],
                               "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.where("false")).count() == 0


def test_clusters_and_smoothing():
    assert html_text.threshold(np.array([1.0, 2.0, 50.0, 60.0])) == pytest.approx(28.25)
    flat = html_text.smoothed(np.full(5, 7.0))
    assert np.allclose(flat, 7.0)


# -- 7 ---------------------------------------------------------------------------------------------

def test_url_rules_and_reputation(spark):
    urls = [(1, "http://A.Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://b.net/es/1"), (4, "http://c.org"),
            (5, None), (6, "no scheme"), (7, "http://x.com"), (8, "ftp://h.net#f"), (9, "http://notexample.com/en/")]
    urls += [(100 + i, f"http://bad.site.org/{i}") for i in range(60)] + [(200 + i, f"http://ok{i % 4}.good.org/{i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(4, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    rep = url_reputation.reputation(url_reputation.outcomes(pages, labels))
    got = {r.page_id: r for r in url_reputation.judge(pages, rep).collect()}
    assert len(got) == len(urls)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block")
    assert got[7].rule is None and got[8].host == "h.net" and got[9].rule == "com/"
    assert got[5].host == got[6].host == "" and got[5].rule is None
    assert got[100].verdict == "block" and got[200].verdict == "allow" and got[100].bound > got[200].bound
    assert url_reputation.judge(pages.where("false"), rep).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------

def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[k:] for k in range(5))))


def brute_components(texts):
    sets = {i: sets_of(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rare,block", [(64, 1024), (2, 4)])
def test_ngram_join_matches_all_pairs(spark, rare, block):
    r = random.Random(5)
    texts = [(0, None), (1, ""), (2, "  \t"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, prose(9, 4000))]
    shared = prose(77, 30)
    for k in range(90):
        base = prose(k % 4, 120).split()
        for _ in range(r.randrange(8)):
            base[r.randrange(len(base))] = f"edit{r.randrange(1000)}"
        texts.append((10 + k, " ".join(base)))
    texts += [(200 + k, shared + " " + prose(300 + k, 60)) for k in range(20)] + [(300 + k, texts[20][1]) for k in range(10)]
    docs = docs_of(spark, texts + [(20, texts[17][1])])
    got = {x.doc_id: (x.n_shingles, x.component_id)
           for x in ngram_join.jaccard_components(docs, rare=rare, block=block).collect()}
    assert got == brute_components(texts)
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, c) in got.items() if c == i}
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0


def test_first_of_each_keeps_one_row_of_each_group(spark):
    base, other = prose(501, 200), prose(502, 200)
    near = base + " one more word"
    texts = [(5, base), (5, base), (9, near), (5, other), (7, other), (None, near), (None, prose(503, 50)),
             (None, prose(503, 50)), (8, prose(503, 50) + " x"), (None, prose(504, 60)), (None, prose(504, 60) + " y"),
             (None, None), (20, "")]
    docs = docs_of(spark, texts)
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    last = [t for i, t in got if i is None and t and t.startswith(prose(504, 60))]
    assert len(last) == 1 and got == sorted([(5, base), (5, other), (8, prose(503, 50) + " x"), (None, last[0]), (None, None),
                                             (20, "")], key=str)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (2, 1), *[(k, k + 1) for k in range(100, 160)]], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 100 for k in range(100, 161)}}


# -- 9 ---------------------------------------------------------------------------------------------

def brute_removed(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s:s + length], []).append((i, s))
    hit = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                hit[i][s:s + length] = True
    return hit


def test_repeats_match_brute_force(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdé \n") for _ in range(700))
    texts = [(0, None), (1, ""), (2, "short"), (3, "x" * 399), (4, "y" * 401), (5, passage + "tail"), (6, "head" + passage),
             (7, passage[:450] + "!" + passage[450:]), (8, passage * 2), (9, "ab" * 900)]
    texts += [(20 + k, "".join(r.choice("pqrs ") for _ in range(300)) + passage[k * 5:k * 5 + 420]) for k in range(12)]
    texts += [(40, "zz" + passage), (41, "zz" + passage)]
    docs = docs_of(spark, texts)
    data = [(t or "").encode() for _, t in texts]
    hits = brute_removed(data, 400)
    for x in repeats.remove_repeats(docs, keep_text=True).collect():
        k = [i for i, _ in texts].index(x.doc_id)
        kept = np.frombuffer(data[k], np.uint8)[~hits[k]].tobytes()
        runs = int((np.diff(np.concatenate(([0], hits[k].astype(int)))) == 1).sum())
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) == (
            len(data[k]), int(hits[k].sum()), runs, hashlib.sha256(kept).hexdigest(), kept), x.doc_id
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def test_contexts_of_one_hot_anchor_are_parted(spark, monkeypatch):
    r = random.Random(31)
    noise = lambda n: "".join(r.choice("pqrstuv ") for _ in range(n))      # noqa: E731
    footer, near = noise(330), [noise(60) for _ in range(4)]
    texts = [(k, noise(200) + near[k % 4] + footer + near[k * 7 % 3] + noise(200)) for k in range(60)]
    texts += [(100 + k, noise(30) + texts[k][1][150:720]) for k in range(3)]
    data = [t.encode() for _, t in texts]
    hits = brute_removed(data, 400)
    assert sum(h.any() for h in hits) > 40 and not all(h.all() for h in hits)
    for x in repeats.remove_repeats(docs_of(spark, texts), keep_text=True, batch_bytes=2000).collect():
        k = [i for i, _ in texts].index(x.doc_id)
        assert bytes(x.kept) == np.frombuffer(data[k], np.uint8)[~hits[k]].tobytes(), x.doc_id
    # No call of the index takes more than a batch and one anchor under the bound.
    sizes = []
    plain = repeats.index_marks
    monkeypatch.setattr(repeats, "index_marks", lambda c, n: sizes.append(sum(map(len, c))) or plain(c, n))
    rows = [(5, repeats.LONE, k, 0, data[k][150:700], True) for k in range(60)]
    rows += [(6, repeats.LONE, 90, 0, data[0][150:700], False), (6, repeats.LONE, 91, 0, data[1][150:700], False)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["key", "kind", "doc", "start", "text", "hot"])
    dealt = list(repeats.mark(iter([batch]), 400, 2000, 4))
    assert sizes == [1100] and len(dealt) > 10


def test_repeats_null_and_equal_ids(spark):
    r = random.Random(41)
    noise = lambda n: "".join(r.choice("pqrstuv ") for _ in range(n))      # noqa: E731
    passage = noise(500)
    texts = [(None, noise(900)), (None, passage + noise(300)), (1, noise(600) + passage), (1, noise(1300)),
             (2, passage[:450] + noise(500)), (2, noise(950)), (None, "tiny"), (1, None)]
    twin = noise(700)
    texts += [(3, twin), (3, twin), (None, twin)]
    data = [(t or "").encode() for _, t in texts]
    hits = brute_removed(data, 400)
    want = [(i, len(d), int(h.sum()), np.frombuffer(d, np.uint8)[~h].tobytes()) for (i, _), d, h in zip(texts, data, hits)]
    got = [(x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept))
           for x in repeats.remove_repeats(docs_of(spark, texts), keep_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run_length_index_matches_brute_force():
    r = random.Random(1)
    for _ in range(40):
        base = bytes(r.choice(b"ab c") for _ in range(120))
        texts = []
        for _ in range(12):
            t = bytearray(base[r.randrange(40):r.randrange(60, 120)] * r.choice([1, 1, 2]))
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(b"abcx\0")
            texts.append(bytes(t))
        for t, spans, hit in zip(texts, repeats.index_marks(texts, 20), brute_removed(texts, 20)):
            mark = np.zeros(len(t), bool)
            for a, b in spans:
                mark[a:b] = True
            assert (mark == hit).all()


# -- 10 --------------------------------------------------------------------------------------------

def brute_contamination(text, items, window=10):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words_of((t or "").encode())
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for s in range(len(words) - m + 1):
                if words[s:s + m] == w[i:i + m]:
                    hit.update(range(s, s + m))
                    found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("most", [2_000_000, 25])
def test_decontamination_matches_brute_force(spark, most):
    items = [(1, prose(1, 25)), (2, prose(2, 10)), (3, "short item"), (4, None), (5, "?!"), (6, prose(1, 25)), (7, "Ünï x1"), (8, "solo9")]
    texts = [(0, None), (1, ""), (2, prose(50, 200)), (3, prose(60, 20) + " " + prose(1, 25).upper() + "! " + prose(61, 5)),
             (4, prose(2, 10)), (5, prose(2, 9)), (6, "a short-item b solo9"), (7, " ".join(prose(1, 25).split()[5:16])), (8, "ünï x1 Ünï, x1")]
    docs = docs_of(spark, texts + [(4, texts[4][1])])
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.contamination(docs, bench, max_block_words=most).select(
        "*", decontaminate.items_digest(F.col("items")).alias("sha")).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        n, hit, found = brute_contamination(dict(texts)[x.doc_id], items)
        assert (x.n_words, x.n_hit, set(x["items"]), x.sha) == (n, hit, {str(i) for i in found}, decontaminate.digest_of(found)), x
        assert sum(s.end - s.start for s in x.spans) == hit
    kept = {x.doc_id for x in decontaminate.clean_documents(docs, bench, max_block_words=most).collect()}
    assert kept == {x.doc_id for x in got if x.n_hit == 0}
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


# -- pipeline --------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_to_targets", "token_files"]
    left = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "t")
        assert docs.columns == columns
        left[name] = [r.doc_id for r in docs.collect()]
    comps = brute_components([(i, before[i]) for i in left["toxicity"]])
    assert sorted(left["ngram_jaccard_join"]) == sorted(i for i, (_, c) in comps.items() if c == i)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(left["benchmark_decontamination"]) == sorted(
        i for i in left["ngram_jaccard_join"] if not brute_contamination(before[i], bench)[1])
    assert set(left["mixing_to_targets"]) == set(left["benchmark_decontamination"])
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(left["mixing_to_targets"])
