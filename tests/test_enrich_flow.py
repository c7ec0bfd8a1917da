import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.functions import jsonfn as J
from feedloom.operators import memo as M
from feedloom.operators.enrich import enrich, extract, transcribe
from feedloom.operators.status import RunFailed
from feedloom.plans.flow import DocumentFlow, FlowError, RunOptions, process_episodes, read_documents, row_transform
from feedloom.session import BATCH_BYTES
from feedloom.sinks import artifacts as K

EP = "feed_url string, position int, id string, title string, audio_url string, description string, transcript string, pub_date string"


def episodes(spark):
    return spark.createDataFrame([
        ("f", 0, "g0", "Zero", "https://a/0.mp3", "desc zero", "", "d0"),
        ("f", 1, "g1", "One", "https://a/1.mp3", "desc one", "", "d1"),
        ("f", 2, "g2", "Two", "https://a/bad.mp3", "desc two", "", "d2"),
        ("f", 3, "g3", "Three", "https://a/3.mp3", "desc", "already here", "d3"),
        ("f", 4, "", "NoId", "https://a/4.mp3", "x", "", "d4"),
    ], EP)


def asr(req: str) -> str:
    url = json.loads(req)["audio_url"]
    if "bad" in url:
        raise RuntimeError("timeout talking to ASR")
    return json.dumps({"transcript": "words of " + url})


def model(req: str) -> str:
    prompt = json.loads(req)["messages"][1]["content"]
    content = '```json\n{"guests": [{"name": "Ann"}], "companies": []}\n```' if "Zero" in prompt else "sorry"
    return json.dumps({"message": {"role": "assistant", "content": content}, "done": True})


def counted(folder):
    """A row function that leaves a file for every call."""
    import os
    import uuid

    def call(request):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if "bad" in request or request == "13":
            raise ValueError("bad request")
        return request + "!" if not request.startswith("{") else json.dumps({"transcript": "words of " + json.loads(request)["audio_url"]})
    return call


def test_one_bad_row_of_a_hundred_costs_a_hundred_calls(spark, tmp_path):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "request string").repartition(3)
    out = {r.request: (r.reply, r.error) for r in enrich(df, counted(str(tmp_path)), row_fn=True).collect()}
    assert out["1"] == ("1!", None) and out["13"] == (None, "ValueError: bad request")
    assert len(list(tmp_path.iterdir())) == 100


def test_batch_protocol_values_errors_and_failing_batches(spark, tmp_path):
    df = spark.createDataFrame([(str(i),) for i in range(20)], "request string").coalesce(1)

    def some(s):
        (tmp_path / "called").mkdir(exist_ok=False)              # a second call would raise
        return [KeyError(x) if x == "13" else None if x == "4" else float("nan") if x == "5" else x + "!" for x in s]
    out = {r.request: (r.reply, r.error) for r in enrich(df, some).collect()}
    assert out["1"] == ("1!", None) and out["13"] == (None, "KeyError: '13'")
    assert out["4"] == out["5"] == (None, None)

    def never(s):
        raise RuntimeError("down")
    assert {r.error for r in enrich(df, never, retry=False).collect()} == {"RuntimeError: down"}

    def fragile(s):
        if (s == "13").any():
            raise ValueError("bad batch")
        return s + "!"
    got = {r.request: (r.reply, r.error) for r in enrich(df, fragile).collect()}
    assert got["12"] == ("12!", None) and got["13"] == (None, "ValueError: bad batch")
    assert {r.error for r in enrich(df, lambda s: s[:0]).collect()} == {"ValueError: stage returned a different number of rows"}


def test_a_call_gets_a_bounded_number_of_bytes(spark):
    """Whole feeds as requests: a batch ends by its bytes, and requests stay in Python."""
    df = spark.range(300).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000)).alias("request")).coalesce(1)
    got = enrich(df, lambda s: [str(s.str.len().sum())] * len(s), keep_request=False)
    assert got.columns == ["reply", "error"]
    rows = got.collect()
    assert len(rows) == 300 and max(int(r.reply) for r in rows) <= BATCH_BYTES + 200_000


def test_one_call_for_every_audio_url(spark, tmp_path):
    rows = [("f", i, f"g{i}", f"t{i}", "https://a/same.mp3", "d", "", "x") for i in range(6)]
    rows += [("f", 9, "n1", "t", "", "d", "", "x"), ("f", 10, "n2", "t", "", "d", "", "x"), ("f", 11, "n3", "other", "", "d", "", "x"),
             ("f", 12, "b", "t", "https://a/bad.mp3", "d", "", "x"), ("f", 13, "b2", "u", "https://a/bad.mp3", "d", "", "x")]
    eps = spark.createDataFrame(rows, EP).repartition(4)
    out, new = transcribe(eps, counted(str(tmp_path)), row_fn=True)
    for _ in range(3):                                             # every action reads the saved replies
        got = {r.position: (r.transcript, r.transcript_status) for r in out.collect()}
        keys = [r.key for r in new.collect()]
    assert len(list(tmp_path.iterdir())) == 1 + 2 + 1              # one URL, two requests without one, one bad URL
    assert all(got[i] == ("words of https://a/same.mp3", "ok") for i in range(6))
    assert got[9] == got[10] and got[12] == got[13] == ("", "error")
    assert len(keys) == len(set(keys)) == 1 and out.count() == len(rows)


def test_a_stage_that_is_not_there_is_an_error_of_its_rows(spark):
    out, new = transcribe(episodes(spark), None)
    got = {r.position: (r.transcript_status, r.transcript_error) for r in out.collect()}
    assert got[3] == ("given", None) and got[0] == ("error", "transcribe: stage not configured") and new.count() == 0


def test_transcribe_uses_given_cached_and_computed(spark):
    eps = episodes(spark)
    cached = spark.createDataFrame([("https://a/1.mp3", "from cache")], "url string, value string") \
        .select(M.transcript_key("url").alias("key"), F.lit("transcript").alias("kind"), "value",
                F.lit(10).cast("bigint").alias("size_bytes"), F.current_timestamp().alias("last_used"))
    out, new = transcribe(eps, asr, cached, row_fn=True)
    r = {x.position: x for x in out.collect()}
    assert (r[0].transcript, r[0].transcript_status) == ("words of https://a/0.mp3", "ok")
    assert (r[1].transcript, r[1].transcript_status) == ("from cache", "cache")
    assert r[2].transcript_status == "error" and "timeout" in r[2].transcript_error
    assert (r[3].transcript, r[3].transcript_status) == ("already here", "given")
    assert sorted(x.value for x in new.collect()) == ["words of https://a/0.mp3", "words of https://a/4.mp3"]


def test_extract_merges_and_memoises_only_good_rows(spark):
    eps = episodes(spark).where("position in (0, 1)")
    out, new = extract(eps, model, row_fn=True)
    r = {x.position: x for x in out.collect()}
    assert r[0].entry_status == "ok" and json.loads(r[0].entry)["guests"][0]["name"] == "Ann"
    assert r[1].entry_status == "error" and r[1].entry_error == J.NO_JSON_ERROR
    assert new.count() == 1
    again, _ = extract(eps, model, artifacts=new, row_fn=True)
    assert {x.position: x.entry_status for x in again.collect()} == {0: "cache", 1: "error"}
    other, _ = extract(eps, model, scheme='{"x": 1}', artifacts=new, row_fn=True)   # another scheme: new key
    assert {x.entry_status for x in other.collect()} <= {"ok", "error"}


def test_process_episodes_end_to_end(spark, tmp_dir):
    opts = RunOptions(output_dir=tmp_dir)
    stages = {"transcribe": _row(asr), "extract": _row(model)}
    res = process_episodes(episodes(spark), stages, opts)
    st = {(r.stage, r.episode_id): r.status for r in res.status.collect()}
    assert st[("validate", "")] == "rejected"                     # strict policy: no guid
    assert st[("transcribe", "g2")] == "error"
    assert st[("extract", "g0")] == "ok"
    raw = K.read_raw(spark, f"{tmp_dir}/raw")
    assert raw.count() == 3
    assert K.read_latest(spark, f"{tmp_dir}/structured").count() == 1
    assert K.read_latest(spark, f"{tmp_dir}/metadata").count() == 1
    # second run: nothing new is written for entries and sidecars
    process_episodes(episodes(spark), stages, opts)
    assert K.read_batches(spark, f"{tmp_dir}/structured").count() == 1
    with pytest.raises(RunFailed):
        process_episodes(episodes(spark), stages, RunOptions(raise_on_error=True))
    limited = process_episodes(episodes(spark), stages, RunOptions(limit=1))
    assert limited.transcripts.count() == 1


def _row(fn):
    def batch(s: pd.Series) -> pd.Series:
        return s.map(fn)
    return batch


def test_document_flow(spark):
    src = spark.createDataFrame([(1, "  Hello world ", "s1"), (2, "x", "s2")], "n int, text string, src string")
    docs = read_documents(src, id="n", content="text", source_id="src", metadata=["src"])

    def words(d):
        d["n_words"] = len(d["content"].split())
        return d

    seen = []
    flow = DocumentFlow(docs, [lambda df: df.withColumn("content", F.trim("content")),
                               row_transform(words, "id string, source_id string, metadata map<string,string>, "
                                                    "content string, n_words int")],
                        [lambda df: seen.append(df.count())])
    out = flow.run(max_parallel=2)
    assert sorted((r.id, r.n_words) for r in out.collect()) == [("1", 2), ("2", 1)]
    assert seen == [2]

    def boom(d):
        if d["id"] == "2":
            raise ValueError("nope")
        return d
    with pytest.raises(FlowError, match="document 2"):
        DocumentFlow(docs, [row_transform(boom)]).run()


def test_store_cold_warm_renamed_and_other_scheme(spark, tmp_dir):
    stages = {"transcribe": _row(asr), "extract": _row(model)}
    store = M.StoreSettings(path=f"{tmp_dir}/cache", max_bytes=10 ** 9)
    eps = episodes(spark).where("position in (0, 1)")

    def statuses(res):
        t = {r.position: r.transcript_status for r in res.transcripts.collect()}
        x = {r.position: r.entry_status for r in res.entries.collect()}
        return t, x

    cold = process_episodes(eps, stages, RunOptions(store=store))
    assert statuses(cold) == ({0: "ok", 1: "ok"}, {0: "ok", 1: "error"})
    warm = process_episodes(eps, stages, RunOptions(store=store))
    assert statuses(warm) == ({0: "cache", 1: "cache"}, {0: "cache", 1: "error"})    # errors are not cached
    renamed = eps.withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("title", F.lit("Zero again"))
    t, _ = statuses(process_episodes(renamed, stages, RunOptions(store=store)))
    assert t == {0: "cache", 1: "cache"}                                            # same URL, same keys
    t, x = statuses(process_episodes(eps, stages, RunOptions(store=store, scheme='{"k": ""}', scheme_id="k")))
    assert t == {0: "cache", 1: "cache"} and x[0] == "ok"                           # other scheme: extract again
    tiny = M.StoreSettings(path=f"{tmp_dir}/tiny", max_bytes=40)
    process_episodes(eps, stages, RunOptions(store=tiny))
    t, _ = statuses(process_episodes(eps, stages, RunOptions(store=tiny)))
    assert sorted(t.values()) == ["cache", "ok"]                                    # one evicted, recomputed
    broken = M.StoreSettings(path="/proc/definitely/not/writable")
    t, _ = statuses(process_episodes(eps, stages, RunOptions(store=broken)))        # caching off, run goes on
    assert t == {0: "ok", 1: "ok"}


def test_named_stage_in_sql(spark):
    from feedloom.plans.flow import register_stage
    register_stage(spark, "asr_stage", lambda req: "reply to " + req)
    r = spark.sql("SELECT asr_stage(x) AS y FROM VALUES ('a'), ('b') AS t(x)").collect()
    assert sorted(x.y for x in r) == ["reply to a", "reply to b"]


def test_fail_fast_and_scheme_id_without_scheme(spark, tmp_dir):
    stages = {"transcribe": _row(asr), "extract": _row(model)}
    with pytest.raises(RunFailed):
        process_episodes(episodes(spark), stages, RunOptions(fail_fast=True))
    res = process_episodes(episodes(spark).where("position = 0"), stages,
                           RunOptions(scheme_id="guests", output_dir=tmp_dir))
    names = [r.name for r in K.read_latest(spark, f"{tmp_dir}/structured").collect()]
    assert names == ["g0_guests.json"]
    assert res.entries.first().scheme_rejected is False


def test_synthetic_graph_shape(spark):
    from feedloom.operators import graph as G
    g = G.synthetic_graph(spark, 50, seed=42)
    assert g.nodes.count() == 50 and g.edges.count() == 150
    again = G.synthetic_graph(spark, 50, seed=42)
    assert sorted(tuple(r) for r in g.edges.collect()) == sorted(tuple(r) for r in again.edges.collect())
    assert {r.properties["index"] for r in g.nodes.collect()} == {str(i) for i in range(50)}
