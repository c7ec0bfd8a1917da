import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.functions.strings import artifact_glob
from feedloom.operators.entries import companies, entries, entry_keys, guests
from feedloom.sinks import artifacts as K
from feedloom.sources.chunks import assemble_chunks, parse_chunk_lines
from feedloom.streaming.feeds import read_episode_table, stream_feeds

ENTRY = "id string, audio_url string, title string, pub_date string, entry string"


def test_structured_skip_and_sidecar_backfill(spark, tmp_dir):
    rows = spark.createDataFrame([("ep 1", "https://a/1.mp3", "T1", "d1", '{"a":1}'),
                                  ("", "https://a/2.mp3", "T2", "d2", '{"a":2}')], ENTRY)
    K.write_structured(rows, f"{tmp_dir}/s", "entry")
    names = sorted(r.name for r in K.read_latest(spark, f"{tmp_dir}/s").collect())
    assert names == ["ep_1_entry.json", "https___a_2_mp3_entry.json"]      # URL id slugged
    changed = rows.withColumn("entry", F.lit('{"a":99}'))
    K.write_structured(changed, f"{tmp_dir}/s", "entry")                 # second write ignored
    assert {r.entry for r in K.read_latest(spark, f"{tmp_dir}/s").collect()} == {'{"a":1}', '{"a":2}'}
    K.write_structured(changed, f"{tmp_dir}/s", "entry", mode="overwrite")
    assert {r.entry for r in K.read_latest(spark, f"{tmp_dir}/s").collect()} == {'{"a":99}'}
    K.write_metadata(rows.where("id = 'ep 1'"), f"{tmp_dir}/m")
    K.write_metadata(rows, f"{tmp_dir}/m")                               # back-fill only the missing one
    meta = {r.name: r for r in K.read_latest(spark, f"{tmp_dir}/m").collect()}
    assert set(meta) == {"ep_1_meta.json", "https___a_2_mp3_meta.json"}
    assert (meta["ep_1_meta.json"].episode_id, meta["ep_1_meta.json"].pub_date) == ("ep 1", "d1")
    assert K.read_batches(spark, f"{tmp_dir}/m").count() == 2


def test_raw_always_overwrites_and_partial_batch_invisible(spark, tmp_dir):
    e = spark.createDataFrame([("g", "u", "T", "")], "id string, audio_url string, title string, transcript string")
    K.write_raw(e, f"{tmp_dir}/r")
    K.write_raw(e.withColumn("transcript", F.lit("now")), f"{tmp_dir}/r")
    assert [r.text for r in K.read_raw(spark, f"{tmp_dir}/r").collect()] == ["now"]
    os.makedirs(f"{tmp_dir}/r/batch=7")                                  # no _SUCCESS: ignored
    assert [n for n, _ in K.committed_batches(spark, f"{tmp_dir}/r")] == [0, 1]


def test_export_and_harvest_by_glob(spark, tmp_dir):
    df = spark.createDataFrame([("a_raw.txt", "A\n"), ("a_meta.json", "{}"), ("b_entry.json", "{}")], "name string, text string")
    K.export_files(df, tmp_dir)
    raw = K.read_artifacts(spark, tmp_dir, artifact_glob("raw")).collect()
    assert [(r.name, r.slug, r.text) for r in raw] == [("a_raw.txt", "a", "A\n")]
    st = K.read_artifacts(spark, tmp_dir, "*_entry.json").collect()
    assert [(r.name, r.slug) for r in st] == [("b_entry.json", "b")]


def test_export_to_a_disk_writes_each_name_in_its_task(spark, tmp_dir):
    rows = [(None, "n"), ("", "e"), ("a/b%=c:{x}", "odd"), ("two", "1"), ("two", "2"), ("null", None), ("u", "ü"), ("cr", "x\ry")]
    df = spark.createDataFrame(rows * 2, "name string, text string")
    K.export_files(df, tmp_dir)
    df.repartition("name").write.partitionBy("name").text(f"{tmp_dir}_spark")
    lines = lambda path: sorted((r.name or "", r.value) for r in spark.read.option("lineSep", "\n").text(path).collect())
    assert lines(tmp_dir) == lines(f"{tmp_dir}_spark")
    K.export_files(df.where("name = 'two'"), tmp_dir)                    # a further export adds files
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_dir) for d, _, fs in os.walk(tmp_dir) for f in fs)
    assert "_SUCCESS" in found
    parts = [f for f in found if "/part-" in f]
    assert sorted(f for f in found if "/" in f) == parts                 # no checksum or unfinished file beside them
    assert sorted({d.split("/")[0] for d in parts}) == sorted(d for d in os.listdir(f"{tmp_dir}_spark") if d.startswith("name="))
    assert len(parts) == 1 + len({d.split("/")[0] for d in parts})       # one file a name and export


def test_export_started_again_writes_the_same_files(tmp_dir):
    def batches(n):
        for i in range(n):
            yield pa.RecordBatch.from_pydict({"name": ["a", "b"][i:i + 1] * 2, "text": [b"x", b"y"]})
        if n < 2:
            raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        list(K._write_files(batches(1), tmp_dir, "name", "part-0.txt"))
    assert not [f for _, _, fs in os.walk(tmp_dir) for f in fs if f.startswith("part-")]        # "a" may go on in what was lost
    for _ in range(2):
        assert [b.column(0).to_pylist() for b in K._write_files(batches(2), tmp_dir, "name", "part-0.txt")] == [[2]]
    assert {d: open(f"{tmp_dir}/name={d}/part-0.txt", "rb").read() for d in "ab"} == {"a": b"x\ny\n", "b": b"x\ny\n"}


def test_read_scheme(spark, tmp_dir):
    with open(f"{tmp_dir}/guests.v2.json", "w") as fh:
        fh.write('{"guests": []}')
    r = K.read_scheme(spark, f"{tmp_dir}/guests.v2.json").first()
    assert (r.scheme_json, r.scheme_id) == ('{"guests": []}', "guests.v2")


def test_entry_tables(spark):
    s = spark.createDataFrame([
        ("e1", '{"guests":[{"name":"Ann","background":"b","ideology":"i"}],'
               '"companies":[{"name":"Acme","business_model":"m","customers":"c"},{"name":"Beta"}],"extra":1}'),
        ("e2", "not json"), ("e3", "[1,2]")], "episode_id string, entry string")
    typed = entries(s)
    assert [tuple(r) for r in guests(typed).collect()] == [("e1", 0, "Ann", "b", "i")]
    assert [(r.pos, r.name, r.customers) for r in companies(typed).collect()] == [(0, "Acme", "c"), (1, "Beta", None)]
    assert sorted(r.key for r in entry_keys(s).collect()) == ["companies", "extra", "guests"]


def test_chunks_stop_after_first_done(spark):
    lines = spark.createDataFrame(
        [("r1", i, f'{{"message":{{"role":"assistant","content":"c{i}"}},"done":{"true" if i == 3 else "false"}}}')
         for i in range(6)] + [("r2", 0, '{"message":{"content":"only"},"done":false}')],
        "request_id string, seq int, line string")
    out = {r.request_id: (r.text, r.complete) for r in assemble_chunks(parse_chunk_lines(lines), piece_rows=2).collect()}
    assert out == {"r1": ("c0c1c2c3", True), "r2": ("only", False)}


RSS = ('<rss><channel><title>{t}</title>'
       '<item><title>A</title><guid>{g}</guid><enclosure url="https://a/{u}.mp3"/></item></channel></rss>')


def test_stream_dedupes_by_audio_url_and_replays_nothing(spark, tmp_dir):
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    os.makedirs(src)
    for name, g, u in [("f1", "g1", "1"), ("f2", "g2", "2"), ("f3", "other-guid", "1")]:
        with open(f"{src}/{name}.xml", "w") as fh:
            fh.write(RSS.format(t=name, g=g, u=u))
    stream_feeds(spark, src, out, checkpoint=f"{tmp_dir}/ck").awaitTermination()
    first = sorted(r.audio_url for r in read_episode_table(spark, out).collect())
    assert first == ["https://a/1.mp3", "https://a/2.mp3"]
    stream_feeds(spark, src, out, checkpoint=f"{tmp_dir}/ck2").awaitTermination()   # full replay
    assert read_episode_table(spark, out).count() == 2


def test_stream_keeps_episodes_without_url_and_reports_errors(spark, tmp_dir):
    from feedloom.streaming.feeds import read_error_table
    src, out = f"{tmp_dir}/in2", f"{tmp_dir}/out2"
    os.makedirs(src)
    items = "".join(f"<item><title>t{k}</title><guid>g{k}</guid></item>" for k in range(5))
    with open(f"{src}/nourl.xml", "w") as fh:
        fh.write(f"<rss><channel><title>c</title>{items}</channel></rss>")
    with open(f"{src}/bad.xml", "w") as fh:
        fh.write("<rss><channel>")
    for _ in range(2):                           # the second run starts from the stream's own checkpoint
        stream_feeds(spark, src, out, policy="strict").awaitTermination()
    errors = read_error_table(spark, out).collect()
    assert sorted(e.position is None for e in errors) == [False] * 5 + [True]
    from feedloom.streaming.feeds import dedupe_by_identity, with_identity
    rows = spark.createDataFrame([("f", k, f"g{k}" if k else "", "") for k in range(5)] + [("f", 7, "x", "u"), ("h", 1, "y", "u")],
                                 "feed_url string, position int, id string, audio_url string")
    assert dedupe_by_identity(with_identity(rows)).count() == 6


def test_stream_reads_many_feeds_a_file(spark, tmp_dir):
    """Feeds in bundles: each by its own name, broken ones and replays too."""
    import glob
    from feedloom.streaming.feeds import read_error_table
    src, out = f"{tmp_dir}/in3", f"{tmp_dir}/out3"
    feeds = [(f"f{k}.xml", RSS.format(t="t", g=f"g{k}", u=str(k % 20))) for k in range(30)] + [("bad.xml", "<rss><channel>"), ("none.xml", None)]
    K.export_bundles(spark.createDataFrame(feeds, "name string, text string").coalesce(2), src)
    assert len(glob.glob(f"{src}/**/*.parquet", recursive=True)) <= 2
    for run in range(2):
        stream_feeds(spark, src, out, checkpoint=f"{tmp_dir}/ck3-{run}", bundles=True).awaitTermination()
    got = sorted(r.audio_url for r in read_episode_table(spark, out).collect())
    assert got == sorted(f"https://a/{k}.mp3" for k in range(20))
    assert sorted(tuple(r) for r in read_error_table(spark, out).collect()) == [
        ("bad.xml", None, "invalid feed XML"), ("none.xml", None, "invalid feed XML")]


def test_names_collide_once_and_suffix_follows_the_glob(spark, tmp_dir):
    rows = spark.createDataFrame([("a_b_entry.json", "2"), ("a_b_entry.json", "1"), ("c_entry.json", "3")], "name string, text string")
    assert sorted(tuple(r) for r in K.new_rows(rows, None).collect()) == [("a_b_entry.json", "1"), ("c_entry.json", "3")]
    assert [tuple(r) for r in K.name_collisions(rows).collect()] == [("a_b_entry.json", 2)]
    with open(f"{tmp_dir}/ep_1_my_scheme.json", "w") as fh:
        fh.write("{}")
    assert [r.slug for r in K.read_artifacts(spark, tmp_dir, "*_my_scheme.json").collect()] == ["ep_1"]


def test_a_write_reports_the_ids_that_lose_their_name(spark, tmp_dir):
    rows = spark.createDataFrame([("ep 1", "", "T", "d", "{1}"), ("ep/1", "", "T", "d", "{2}"), ("ep/1", "", "T", "d", "{3}"),
                                  ("ep 1", "", "T", "d", "{1}"), ("other", "", "T", "d", "{4}")], ENTRY)
    K.write_structured(rows, f"{tmp_dir}/s", "entry")
    assert {r.name: r.episode_id for r in K.read_latest(spark, f"{tmp_dir}/s").collect()} == {"ep_1_entry.json": "ep 1", "other_entry.json": "other"}
    assert [tuple(r) for r in K.read_collisions(spark, f"{tmp_dir}/s").drop("batch").collect()] == [("ep_1_entry.json", "ep/1", "ep 1", 2)]
    K.write_metadata(rows.where("id = 'other'"), f"{tmp_dir}/m")
    assert K.read_collisions(spark, f"{tmp_dir}/m") is None


def test_known_identities_do_not_grow_with_the_batches(spark, tmp_dir):
    from feedloom.streaming.identities import IdentityIndex
    path = f"{tmp_dir}/t"

    def index():
        return IdentityIndex(spark, path, F.col("k"), buckets=3, files=2)

    def rows(*ks):
        return spark.createDataFrame([(k, "v") for k in ks], "k string, v string")
    for n in range(6):
        assert index().append_new(rows(f"a{n}", f"b{n}", "same", None)) == n
    assert index().append_new(rows("a0", "b5", "same", None)) is None           # a replay of anything adds nothing
    held = [os.listdir(f"{path}_identities/{d}") for d in os.listdir(f"{path}_identities") if d.startswith("bucket=")]
    assert len(held) <= 3 and all(sum(f.endswith(".parquet") for f in fs) <= 3 for fs in held)
    table = spark.read.parquet(*[d for _, d in K.committed_batches(spark, path)])
    assert table.where("k = 'same'").count() == 1 and table.count() == 14
    # A run that ended before its batch was complete, and one that ended before its identities were folded.
    os.makedirs(f"{path}/batch=6")
    with open(f"{path}_identities/_next", "w") as fh:
        fh.write("")
    assert index().append_new(rows("a1", "late")) == 6
    assert index().append_new(rows("late")) is None


def test_bundles_hold_many_artifacts_a_file(spark, tmp_dir):
    rows = spark.createDataFrame([(f"e{i}_raw.txt", f"t{i}\n") for i in range(300)] + [("e1_meta.json", "{}"), ("e1_my.json", "{1}"), ("odd", "x"),
                                  ("a%b_raw.txt", "p"), ("e1.mp3", "")], "name string, text string").repartition(2)
    K.export_bundles(rows, f"{tmp_dir}/b")
    files = [f for _, _, fs in os.walk(f"{tmp_dir}/b") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 2 * 5
    raw = K.read_bundles(spark, f"{tmp_dir}/b", artifact_glob("raw"))
    assert raw.count() == 301 and raw.where("slug = 'e7'").first().text == "t7\n"
    assert "kind" in raw._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert [r.slug for r in K.read_bundles(spark, f"{tmp_dir}/b", "*_my.json").collect()] == ["e1"]
    assert [r.name for r in K.read_bundles(spark, f"{tmp_dir}/b", "a%*").collect()] == ["a%b_raw.txt"]
    assert K.read_bundles(spark, f"{tmp_dir}/b").count() == 305
