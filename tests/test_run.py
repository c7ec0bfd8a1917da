import json

import pytest

from feedloom.operators.status import RunFailed
from feedloom.plans.flow import RunOptions
from feedloom.plans.run import register_entry_people, register_table_stage, run_feeds
from feedloom.sinks import artifacts as K

ITEM = '<item><title>{t}</title><guid>{g}</guid><enclosure url="{u}"/></item>'


def feed(*items):
    return "<rss><channel><title>Show</title>" + "".join(ITEM.format(t=t, g=g, u=u) for t, g, u in items) + "</channel></rss>"


def feeds(spark):
    return spark.createDataFrame([
        ("f1", feed(("A", "1", "https://a/1.mp3"), ("B", "2", "https://a/lost.mp3"), ("C", "3", "https://a/slow.mp3"), ("D", "4", "https://a/4.mp3"))),
        ("f2", feed(("E", "5", "https://a/1.mp3"), ("", "6", "https://a/6.mp3"))), ("f3", "<rss><channel>"), ("f4", "hello")],
        "feed_url string, xml string")


def download(req):
    body = json.loads(req)
    if "lost" in body["url"]:
        raise OSError("404")
    return body["dest"]


def transcribe(req):
    url = json.loads(req)["audio_url"]
    if "slow" in url:
        raise TimeoutError("timeout after 30 s")
    return json.dumps({"transcript": "words of " + url})


def extract(req):
    prompt = json.loads(req)["messages"][1]["content"]
    content = "nothing" if "Title: D" in prompt else '{"guests": [{"name": "Ann"}, {"name": 7}], "companies": [{"name": "Acme"}]}'
    return json.dumps({"message": {"role": "assistant", "content": content}, "done": True})


def store(req):
    if json.loads(req)["name"] == "5_raw.txt":
        raise OSError("disk full")
    return "ok"


def test_five_replaced_stages_and_an_error_of_every_class(spark):
    run = run_feeds(feeds(spark), {"download": download, "transcribe": transcribe, "extract": extract, "store": store})
    bad = sorted((r.stage, r.episode_id, r.error_class) for r in run.status.where("error is not null and status <> 'ok'").collect())
    assert bad == [("download", "2", "download"), ("extract", "4", "extraction"), ("feed", "", "invalid feed"), ("feed", "", "invalid feed"),
                   ("store", "5", "storage"), ("transcribe", "3", "transcription timeout"), ("validate", "6", None)]
    assert sorted((r.stage, r.n, r.n_ok, r.n_error, r.limit) for r in run.summary.collect()) == [
        ("download", 5, 4, 1, 0), ("extract", 3, 2, 1, 0), ("feed", 4, 2, 2, 0), ("store", 5, 4, 1, 0), ("transcribe", 4, 3, 1, 0),
        ("validate", 6, 5, 1, 0)]
    assert all(r.seconds >= 0 for r in run.summary.collect())


def test_the_feed_stage_can_be_replaced_too(spark):
    def read(req):
        body = json.loads(req)
        if body["url"] == "f3":
            raise ValueError("no feed")
        return json.dumps({"podcast": {"title": body["url"]}, "episodes": [{"id": body["url"], "title": "T", "audio_url": "https://x/" + body["url"]}]}) \
            if body["url"] != "f4" else "{}"
    run = run_feeds(feeds(spark), {"feed": read, "transcribe": transcribe, "extract": extract})
    assert sorted(r.title for r in run.podcasts.collect()) == ["f1", "f2"]
    assert sorted(r.transcript for r in run.episodes.collect()) == ["words of https://x/f1", "words of https://x/f2"]
    assert sorted(r.error for r in run.status.where("stage = 'feed' and status = 'error'").collect()) == ["ValueError: no feed", "no episodes in the reply"]


def test_missing_stages_skip_or_fail(spark, tmp_dir):
    run = run_feeds(feeds(spark), options=RunOptions(limit=1))
    assert {r.error for r in run.status.where("stage = 'transcribe'").collect()} == {"transcribe: stage not configured"}
    assert run.entries.count() == 0 and {r.limit for r in run.summary.collect()} == {1}
    run = run_feeds(feeds(spark), {"transcribe": transcribe}, RunOptions(output_dir=tmp_dir), skip_missing=True)
    assert {r.entry_status for r in run.entries.collect()} == {"skipped"}
    assert K.read_raw(spark, f"{tmp_dir}/raw").count() == 4
    with pytest.raises(ValueError, match="unknown stages: rss"):
        run_feeds(feeds(spark), {"rss": store})
    with pytest.raises(RunFailed):
        run_feeds(feeds(spark), {"transcribe": transcribe, "extract": extract}, RunOptions(fail_fast=True))


def test_one_to_many_stage_in_sql(spark):
    register_entry_people(spark)
    spark.createDataFrame([(1, '{"guests": [{"name": "Ann"}, {"name": 7}], "companies": [{"name": "Acme"}]}'), (2, "no json"), (3, None),
                           (4, '{"guests": "x"}'), (5, "[1]")], "id int, entry string").createOrReplaceTempView("entries_t")
    rows = spark.sql("SELECT e.id, p.kind, p.pos, p.name FROM entries_t e, LATERAL entry_people(e.entry) p").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "company", 0, "Acme"), (1, "guest", 0, "Ann"), (1, "guest", 1, None)]


def test_a_user_handler_as_table_stage(spark):
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split()):
                yield i, w
    register_table_stage(spark, "words_of", Words, "pos int, word string")
    assert spark.sql("SELECT count(*) AS n FROM VALUES ('a b c'), (NULL), ('d') AS t(x), LATERAL words_of(x)").first().n == 4
