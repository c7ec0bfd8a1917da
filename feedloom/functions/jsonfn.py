"""JSON functions over string columns (all JVM built-ins, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.strings import _c, blank, trim_ws

# Fixed values that must equal the reference's for identical results.
DEFAULT_SCHEME = ('{"guests":[{"name":"","background":"","ideology":""}],'
                  '"companies":[{"name":"","business_model":"","customers":""}]}')
NO_JSON_ERROR = "no JSON in completion"
FENCE = "```"

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
           "allowUnquotedFieldNames": "false", "allowUnquotedControlChars": "false",
           "allowBackslashEscapingAnyCharacter": "false", "allowNumericLeadingZeros": "false",
           "mode": "PERMISSIVE"}


def is_json(x) -> Column:
    """Strict JSON validity: one complete value and nothing after it.

    ``from_json`` alone ignores trailing content, so the value is checked
    twice: as the only element of an array and as the value of an object.
    Each wrapper closes a hole the other leaves open.
    """
    x = _c(x)
    as_elem = F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>", _STRICT)
    as_value = F.from_json(F.concat(F.lit('{"k":'), x, F.lit("}")), "map<string,string>", _STRICT)
    ok = (F.size(as_elem) == 1) & as_value.isNotNull() & (trim_ws(x) != "")
    return F.coalesce(ok, F.lit(False))


# --- J1 scheme acceptance -------------------------------------------------------

def resolve_scheme(scheme) -> Column:
    """struct<scheme string, rejected boolean>.

    Empty / ``null`` -> default, accepted. A JSON string (a base64 accident)
    or invalid JSON -> default, rejected. Otherwise the trimmed text.
    """
    t = trim_ws(_c(scheme))
    resolved = (F.when(blank(t) | (t == "null"), F.struct(F.lit(DEFAULT_SCHEME).alias("scheme"),
                                                           F.lit(False).alias("rejected")))
                .when(t.startswith('"') | ~is_json(t),
                      F.struct(F.lit(DEFAULT_SCHEME).alias("scheme"), F.lit(True).alias("rejected")))
                .otherwise(F.struct(t.alias("scheme"), F.lit(False).alias("rejected"))))
    return resolved


# --- J2..J4 completion parsing ----------------------------------------------------

def strip_fence(x) -> Column:
    """Trim; a fenced block of more than two lines loses its first and last line."""
    t = trim_ws(_c(x))
    lines = F.split(t, "\n")
    inner = F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n")
    return F.when(t.startswith(FENCE) & (F.size(lines) > 2), inner).otherwise(t)


def parse_completion(x) -> Column:
    """struct<json string, error string>: first ``{`` to last ``}``.

    Validity of the slice is not checked here (see ``merge_response``).
    """
    s = strip_fence(x)
    start = F.instr(s, "{")                                   # 1-based, 0 = none
    last = F.when(F.instr(s, "}") == 0, F.lit(0)).otherwise(
        F.length(s) - F.instr(F.reverse(s), "}") + 1)         # 1-based, 0 = none
    ok = F.coalesce((start > 0) & (last > start), F.lit(False))
    return F.struct(F.when(ok, s.substr(start, last - start + 1)).alias("json"),
                    F.when(~ok, F.lit(NO_JSON_ERROR)).alias("error"))


def merge_response(completion) -> Column:
    """struct<entry string, status string> from a raw completion.

    error -> ``{"error":…,"raw_completion":…}`` (status ``error``);
    a valid object -> the object text (``ok``); an invalid slice between the
    braces -> ``{"data":null}`` (``malformed``).
    """
    c = _c(completion)
    p = parse_completion(c)
    err_json = F.to_json(F.struct(p["error"].alias("error"), F.coalesce(c, F.lit("")).alias("raw_completion")))
    return (F.when(p["error"].isNotNull(), F.struct(err_json.alias("entry"), F.lit("error").alias("status")))
            .when(is_json(p["json"]), F.struct(p["json"].alias("entry"), F.lit("ok").alias("status")))
            .otherwise(F.struct(F.lit('{"data":null}').alias("entry"), F.lit("malformed").alias("status"))))


# --- J5..J8 stage replies ------------------------------------------------------------

def parse_asr_response(reply) -> Column:
    """Transcript text out of an ASR reply.

    JSON object -> its ``transcript`` string ('' when missing or null);
    JSON ``null`` -> ''; a non-string transcript, any other JSON value or
    plain text -> the raw reply.
    """
    r = _c(reply)
    t = trim_ws(r)
    v = F.try_parse_json(r)
    field = F.try_variant_get(v, "$.transcript", "variant")
    kind = F.schema_of_variant(field)
    obj = t.startswith("{") & v.isNotNull()
    return (F.when(~is_json(r), r)
            .when(t == "null", F.lit(""))
            .when(obj & (field.isNull() | (kind == "VOID")), F.lit(""))
            .when(obj & (kind == "STRING"), F.try_variant_get(v, "$.transcript", "string"))
            .otherwise(r))


def format_transcript(transcript) -> Column:
    return F.to_json(F.struct(F.coalesce(_c(transcript), F.lit("")).alias("transcript")))


def chat_reply(body) -> Column:
    """Reply content of a chat response body."""
    return F.from_json(_c(body), "message struct<role string, content string>, done boolean")["message"]["content"]


def generate_reply(body) -> Column:
    return F.from_json(_c(body), "response string, done boolean")["response"]


def store_request_kind(x) -> Column:
    """``structured`` when the request has ``entry``, ``raw`` when it has
    ``episode``, ``error`` otherwise (also for non-objects)."""
    keys = F.json_object_keys(_c(x))
    return (F.when(F.coalesce(F.array_contains(keys, "entry"), F.lit(False)), F.lit("structured"))
            .when(F.coalesce(F.array_contains(keys, "episode"), F.lit(False)), F.lit("raw"))
            .otherwise(F.lit("error")))
