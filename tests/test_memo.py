import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from feedloom.operators import memo as M
from feedloom.operators.ordered import row_rank, running_sum

T0 = dt.datetime(2024, 1, 1)
ART = "key string, kind string, value string, size_bytes bigint, last_used timestamp"


def art(spark, rows):
    return spark.createDataFrame([(k, "t", v, len(v.encode()), T0 + dt.timedelta(hours=h)) for k, v, h in rows], ART)


def test_round_trip_replace_and_miss(spark):
    store = M.memo_put(None, art(spark, [("k1", "v1", 0), ("k2", "v2", 0)]))
    store = M.memo_put(store, art(spark, [("k1", "new", 1)]))
    q = spark.createDataFrame([("k1",), ("k2",), ("k3",), (None,)], "key string")
    hits, misses = M.memo_lookup(q, store)
    assert sorted((r.key, r.value) for r in hits.collect()) == [("k1", "new"), ("k2", "v2")]
    assert sorted((r.key or "") for r in misses.collect()) == ["", "k3"]


def test_disabled_store_is_all_misses(spark):
    q = spark.createDataFrame([("k1",)], "key string")
    hits, misses = M.memo_lookup(q, None)
    assert hits.count() == 0 and misses.count() == 1


def test_key_rules(spark):
    keys = ["", "..", "a/b", "../x", ".hidden", "x" * 201, "transcript-" + "a" * 64, "ok_key-1.2", "tab\tkey", "a\n"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    r = [x[0] for x in df.orderBy("i").select(M.key_reason("k")).collect()]
    assert r == ["empty", "starts with a dot", "invalid character", "starts with a dot", "starts with a dot",
                 "longer than 200 bytes", None, None, "invalid character", "invalid character"]


def test_lru_budget_drops_oldest(spark):
    a = art(spark, [("old", "x" * 400, 0), ("mid", "y" * 400, 1), ("new", "z" * 400, 2)])
    assert sorted(r.key for r in M.memo_evict(a, 1024).collect()) == ["mid", "new"]
    assert M.memo_evict(a, 10 ** 9).count() == 3          # evict(inf) = identity


def test_read_refreshes_recency(spark):
    a = art(spark, [("a", "x" * 400, 0), ("b", "y" * 400, 1), ("c", "z" * 400, 2)])
    log = spark.createDataFrame([("a", T0 + dt.timedelta(hours=5))], "key string, accessed_at timestamp")
    kept = M.memo_evict(M.memo_refresh(a, log), 1024)
    assert sorted(r.key for r in kept.collect()) == ["a", "c"]


def test_oversize_value_refused_and_others_evicted(spark):
    old = art(spark, [("a", "x" * 600, 0), ("b", "y" * 600, 1)])
    new = art(spark, [("big", "z" * 2000, 3)])
    stored, refused = M.memo_put_bounded(old, new, 1000)
    assert [r.key for r in refused.collect()] == ["big"]
    assert [r.key for r in stored.collect()] == ["b"]


def test_zero_size_rows_and_ties(spark):
    a = art(spark, [("a", "", 0), ("b", "x" * 10, 0), ("c", "y" * 10, 0)])
    kept = sorted(r.key for r in M.memo_evict(a, 10).collect())
    # same time: the smaller key is evicted first, so the zero-size "a" and
    # then "b" go before the total fits
    assert kept == ["c"]


def test_running_sum_matches_pandas_with_a_hot_group(spark):
    rows = [("hot", i, (i * 7) % 13) for i in range(3000)] + [(f"g{i % 5}", i, i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint")
    got = running_sum(df, [F.col("k").asc()], ["v"], ["g"], num_partitions=6).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["g", "k"])
    pdf["cum_v"] = pdf.groupby("g")["v"].cumsum()
    m = got.merge(pdf, on=["g", "k"], suffixes=("", "_x"))
    assert len(m) == len(rows) and (m["cum_v"] == m["cum_v_x"]).all()
    ranked = row_rank(df, [F.col("k").desc()], num_partitions=4).toPandas()
    assert sorted(ranked["rank"]) == list(range(len(rows)))


def test_store_settings(monkeypatch):
    monkeypatch.setenv("FEEDLOOM_CACHE_DIR", "/x")
    monkeypatch.setenv("FEEDLOOM_CACHE_MAX_BYTES", "-5")
    s = M.StoreSettings().resolved()
    assert s.path == "/x" and s.max_bytes == M.DEFAULT_MAX_BYTES
    assert M.StoreSettings(path="/opt", max_bytes=10).resolved().path == "/opt"
    monkeypatch.setenv("FEEDLOOM_CACHE_MAX_BYTES", "oops")
    assert M.StoreSettings().resolved().max_bytes == M.DEFAULT_MAX_BYTES
    monkeypatch.delenv("FEEDLOOM_CACHE_DIR")
    assert not M.StoreSettings().enabled
    assert os.environ.get("FEEDLOOM_CACHE_DIR") is None


def test_eviction_by_spans_equals_the_ordered_sum(spark):
    import random
    r = random.Random(4)
    rows = [(f"k{i:04d}", "x" * r.choice([0, 1, 7, 40]), r.choice([3, 3, 3, 5, 900, r.randrange(1000)])) for i in range(700)]
    a = art(spark, rows).repartition(3).cache()
    for budget in (0, 5, 900, 4000, 7000, 10 ** 6):
        kept, total = set(), 0
        for k, v, h in sorted(rows, key=lambda x: (x[2], x[0]), reverse=True):
            total += len(v)
            if total > budget:
                break
            kept.add(k)
        for buckets, few in ((4096, 200_000), (3, 0), (7, 20)):
            got = M.memo_evict(a, budget, buckets=buckets, few=few)
            assert {x.key for x in got.collect()} == kept, (budget, buckets, few)
    plan = M.memo_evict(a, 4000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_put_moves_no_value_to_sort_it_and_returns_refused_rows(spark):
    store = M.memo_put(None, art(spark, [("k1", "v1", 5), ("k2", "v2", 0), ("k1", "older", 1), ("k1", "v1", 5)]))
    assert sorted((x.key, x.value) for x in store.collect()) == [("k1", "v1"), ("k2", "v2")]
    new = art(spark, [("k1", "late no more", 2), ("k2", "tie", 0), ("a/b", "bad", 0), ("k3", "y" * 90, 0)])
    put = M.memo_put(store, new.where("key <> 'k3'"))
    assert sorted((x.key, x.value) for x in put.collect()) == [("k1", "v1"), ("k2", "tie")]
    assert "SortAggregate" not in put._jdf.queryExecution().executedPlan().toString()
    _, refused = M.memo_put_bounded(store, new, 50)
    assert sorted((x.key, x.reason) for x in refused.collect()) == [("a/b", "invalid character"), ("k3", M.TOO_LARGE)]


def test_pick_breaks_every_tie(spark):
    from feedloom.operators.latest import pick
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 1, "p"), (None, 3, "q"),
                                  ("c", 1, "abcdefgh1"), ("c", 1, "abcdefgh0")], "k string, n int, t string").coalesce(1)
    p = pick(rows, "k", [F.col("n"), F.col("t")])
    assert sorted(map(str, p.kept.select("k", "t").collect())) == sorted(map(str, [r for r in spark.createDataFrame(
        [("a", "z"), ("b", "n"), (None, "q"), ("c", "abcdefgh1")], "k string, t string").collect()]))
    assert p.kept.count() + p.lost.count() == rows.count()
    low = {r.k: r.t for r in pick(rows, "k", [F.struct("n", "t")], smallest=True).kept.collect()}
    assert low == {"a": "x", "b": "n", None: "p", "c": "abcdefgh0"}
    assert {r.k: r.t for r in pick(rows, "k").kept.collect()}["a"] == "z"
