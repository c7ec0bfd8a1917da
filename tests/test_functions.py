import hashlib
import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates as D
from feedloom.functions import jsonfn as J
from feedloom.functions import strings as S


def ev(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


# --- names -----------------------------------------------------------------------

def test_slug_cases(spark):
    got = ev(spark, S.slug, ["episode-1", "Hello World", "", None, "https://x.com/a?b=1", "naïve", "日本", "a😀b", "MiXeD9"])
    assert got == ["episode_1", "Hello_World", "unknown", "unknown", "https___x_com_a_b_1", "na_ve", "__", "a_b", "MiXeD9"]


def test_names(spark):
    df = spark.createDataFrame([("ep 1",)], "x string")
    r = df.select(S.raw_name("x"), S.meta_name("x"), S.audio_name("x"),
                  S.structured_name("x", F.lit("entry")), S.structured_name("x", F.lit("v1.2"))).first()
    assert tuple(r) == ("ep_1_raw.txt", "ep_1_meta.json", "ep_1.mp3", "ep_1_entry.json", "ep_1_v1.2.json")
    assert S.artifact_glob("raw") == "*_raw.txt"
    assert S.artifact_glob("meta") == "*_meta.json"
    assert S.artifact_glob("structured", "entry") == "*_entry.json"
    with pytest.raises(ValueError):
        S.artifact_glob("structured")


def _key(kind, *parts):
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode("utf-8") + b"\x00")
    return f"{kind}-{h.hexdigest()}"


def test_artifact_key_matches_hashlib(spark):
    df = spark.createDataFrame([("https://a/b.mp3", "entry", "{}"), ("é/ü", "s", "x"), ("", "e", "x"), (None, "e", "x")],
                               "u string, sid string, sc string")
    got = [tuple(r) for r in df.select(S.artifact_key("transcript", "u"),
                                       S.artifact_key("entry", "u", "sid", "sc")).collect()]
    assert got[0] == (_key("transcript", "https://a/b.mp3"), _key("entry", "https://a/b.mp3", "entry", "{}"))
    assert got[1] == (_key("transcript", "é/ü"), _key("entry", "é/ü", "s", "x"))
    assert got[2] == (None, None) and got[3] == (None, None)


def test_key_ignores_title_and_guid_but_not_scheme(spark):
    a = _key("entry", "u", "entry", "{}")
    b = _key("entry", "u", "entry", '{"x":1}')
    assert a != b


# --- byte cut ----------------------------------------------------------------------

def _go_cut(s: str, limit: int = 4000) -> str:
    b = s.encode("utf-8")
    if len(b) <= limit:
        return s
    head = b[:limit]
    i = len(head)
    while i > 0 and 0x80 <= head[i - 1] <= 0xBF:
        i -= 1
    lead = head[i - 1] if i > 0 else 0
    need = 2 if lead >= 0xC0 else 1
    need = 3 if lead >= 0xE0 else need
    need = 4 if lead >= 0xF0 else need
    if i > 0 and lead >= 0xC0 and len(head) - (i - 1) < need:
        dangling = len(head) - (i - 1)
        return head[: i - 1].decode() + "�" * dangling + "..."
    return head.decode() + "..."


@pytest.mark.parametrize("text", [
    "a" * 4000, "a" * 4001, "é" * 2001, "a" + "é" * 2000, "€" * 1334, "a" + "€" * 1334,
    "😀" * 1001, "a" + "😀" * 1000, "ab" + "😀" * 1000, "", "short",
])
def test_cut_bytes(spark, text):
    assert ev(spark, S.cut_bytes, [text])[0] == _go_cut(text)


def test_extraction_content_prefers_transcript(spark):
    df = spark.createDataFrame([("t", "d"), ("", "d"), (None, "d"), ("", "")], "t string, d string")
    assert [r[0] for r in df.select(S.extraction_content("t", "d")).collect()] == ["t", "d", "d", ""]


def test_prompt_and_requests(spark):
    df = spark.createDataFrame([("T", "C", "{}", "u", "h"), ("T", "C", "{}", "u", "")],
                               "t string, c string, s string, u string, h string")
    r = df.select(S.extraction_prompt("t", "c", "s"), S.transcribe_request("u", "h")).collect()
    assert r[0][0] == "Extract data from this podcast episode.\n\nSchema:\n{}\n\nTitle: T\nContent: C"
    assert json.loads(r[0][1]) == {"audio_url": "u", "initial_prompt": "h"}
    assert json.loads(r[1][1]) == {"audio_url": "u"}
    body = json.loads(df.select(S.chat_request(F.col("c"))).first()[0])
    assert body["model"] == S.DEFAULT_MODEL and body["stream"] is False
    assert [m["role"] for m in body["messages"]] == ["system", "user"]
    assert body["messages"][1]["content"] == "C"


def test_hint_and_raw_text(spark):
    df = spark.createDataFrame([("T", "D", ""), ("T", "", "tx"), ("", "D", None)], "t string, d string, tr string")
    r = [tuple(x) for x in df.select(S.transcription_hint("t", "d"), S.raw_text("tr", "t")).collect()]
    assert r[0] == ("T\n\nD", "# T\n\n(no transcript)\n")
    assert r[1] == ("T", "tx")
    assert r[2] == ("D", "# \n\n(no transcript)\n")


# --- JSON ---------------------------------------------------------------------------

JSON_CASES = ['{"a":1}', '{"a":1} {"b":2}', '{"a":1}]', '1,"q":2', "{'a':1}", "NaN", "[1,2]", '"s"', "1",
              "true", "null", "", " ", '{"a":1,}', "[1,]", '{"a":"x\ny"}', "01", "1.5e3",
              '{"a":{"b":[1,2,{"c":null}]}}', '{"a":1,"a":2}', " {} ", "{", "}", "-0", "[]", '"\\u00e9"',
              '{"a" 1}', "[1 2]", "tru", "1e", '{"a":[}', "Infinity", '"unterminated', "{}{}", "[[[]]]"]


def _py_valid(s):
    def bad(_):
        raise ValueError
    try:
        json.loads(s, parse_constant=bad)
        return True
    except ValueError:
        return False


def test_is_json_is_strict(spark):
    got = ev(spark, J.is_json, JSON_CASES)
    assert got == [_py_valid(s) for s in JSON_CASES]


def test_resolve_scheme(spark):
    df = spark.createDataFrame([(0, '{"a":1}'), (1, ' {"a":1}\n'), (2, "null"), (3, None), (4, ""),
                                (5, '"e30="'), (6, "{bad")], "i int, s string")
    r = [tuple(x) for x in df.orderBy("i").select(J.resolve_scheme("s")["scheme"], J.resolve_scheme("s")["rejected"]).collect()]
    d = J.DEFAULT_SCHEME
    assert r == [('{"a":1}', False), ('{"a":1}', False), (d, False), (d, False), (d, False), (d, True), (d, True)]


def test_parse_completion_cases(spark):
    cases = ['{"a":1}', 'Sure! {"a":1} thanks', "no json", "", '{"a":1', '```json\n{"a":1}\n```', "} {",
             "```\n{}\n```", '```{"a":1}```', '  {"x": {"y": 2}}  ']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    p = J.parse_completion("c")
    r = [tuple(x) for x in df.orderBy("i").select(p["json"], p["error"]).collect()]
    e = J.NO_JSON_ERROR
    assert r == [('{"a":1}', None), ('{"a":1}', None), (None, e), (None, e), (None, e), ('{"a":1}', None),
                 (None, e), ("{}", None), ('{"a":1}', None), ('{"x": {"y": 2}}', None)]


def test_merge_response(spark):
    cases = ['ok {"a": [1, 2]} done', "nothing here", "{not json}"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    m = J.merge_response("c")
    r = [tuple(x) for x in df.orderBy("i").select(m["entry"], m["status"]).collect()]
    assert r[0] == ('{"a": [1, 2]}', "ok")
    assert json.loads(r[1][0]) == {"error": J.NO_JSON_ERROR, "raw_completion": "nothing here"} and r[1][1] == "error"
    assert r[2] == ('{"data":null}', "malformed")


def test_asr_reply_rules(spark):
    cases = ['{"transcript":"hi"}', "plain text", '{"other":1}', '{"transcript":null}', "null", "[1]",
             '{"transcript":5}', '"str"', ' {"transcript": "x y"} ']
    assert ev(spark, J.parse_asr_response, cases) == ["hi", "plain text", "", "", "", "[1]", '{"transcript":5}',
                                                      '"str"', "x y"]


def test_format_transcript_and_replies(spark):
    assert json.loads(ev(spark, J.format_transcript, ['a"b\nc'])[0]) == {"transcript": 'a"b\nc'}
    body = json.dumps({"message": {"role": "assistant", "content": "hello"}, "done": True})
    assert ev(spark, J.chat_reply, [body]) == ["hello"]
    assert ev(spark, J.generate_reply, [json.dumps({"response": "r", "done": False})]) == ["r"]


def test_store_request_kind(spark):
    cases = ['{"episode":{},"entry":{}}', '{"episode":{}}', '{"x":1}', "nope", "[1]"]
    assert ev(spark, J.store_request_kind, cases) == ["structured", "raw", "error", "error", "error"]


# --- dates ----------------------------------------------------------------------------

def test_pub_dates(spark):
    cases = ["Mon, 02 Jan 2006 15:04:05 +0000", "Mon, 02 Jan 2006 15:04:05 GMT", "Mon, 02 Jan 2006 15:04:05 -0700",
             "2006-01-02T15:04:05Z", "garbage", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    r = [tuple(x) for x in df.orderBy("i").select(F.date_format(D.parse_pub_date("c"), "yyyy-MM-dd HH:mm:ss"),
                                                 D.normalize_pub_date("c")).collect()]
    assert [x[0] for x in r] == ["2006-01-02 15:04:05", "2006-01-02 15:04:05", "2006-01-02 22:04:05",
                                 "2006-01-02 15:04:05", None, None]
    assert r[0][1] == "Mon, 02 Jan 2006 15:04:05 +0000"
    assert r[2][1] == "Mon, 02 Jan 2006 22:04:05 +0000"
    assert r[4][1] == "garbage" and r[5][1] == ""


def test_pub_date_layouts(spark):
    cases = ["02 Jan 06 15:04 GMT", "2006-01-02T15:04:05.123456Z", "2006-01-02T15:04Z", "Mon, 02 Jan 2006 15:04:05",
             "Monday, 02-Jan-06 15:04:05 UTC", "2 January 2006 15:04:05 +0000", "Mon Jan  2 15:04:05 2006",
             "Mon, 2 Jan 2006 10:04:05 EST", "2006-01-02 15:04:05", "2006-01-02", "2006", "12:00", "1 Foo 2006 15:04:05 Z"]
    want = ["2006-01-02 15:04:00", "2006-01-02 15:04:05", "2006-01-02 15:04:00", "2006-01-02 15:04:05",
            "2006-01-02 15:04:05", "2006-01-02 15:04:05", "2006-01-02 15:04:05",
            "2006-01-02 15:04:05", "2006-01-02 15:04:05", "2006-01-02 00:00:00", None, None, None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = df.orderBy("i").select(F.date_format(D.parse_pub_date("c"), "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in got] == want


def test_generate_request_round_trip(spark):
    body = json.loads(ev(spark, S.generate_request, ["say hi"])[0])
    assert body == {"model": S.DEFAULT_MODEL, "prompt": "say hi", "stream": False}
    assert ev(spark, J.generate_reply, ['{"response": "hi", "done": true}']) == ["hi"]


def test_trim_matches_reference_white_space(spark):
    assert ev(spark, S.trim_ws, ["\v\f x y \u0085 ", "\t\r\nz\n"]) == ["x y", "z"]
    assert ev(spark, lambda c: J.resolve_scheme(c)["scheme"], [' {"a":1}\v']) == ['{"a":1}']
