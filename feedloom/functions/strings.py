"""String, name and hash functions (Column -> Column, all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
UNKNOWN_SLUG = "unknown"
RAW_SUFFIX = "_raw.txt"
META_SUFFIX = "_meta.json"
AUDIO_SUFFIX = ".mp3"
CONTENT_BYTE_LIMIT = 4000
ELLIPSIS = "..."
PROMPT_TEMPLATE = ("Extract data from this podcast episode.\n\nSchema:\n{scheme}"
                   "\n\nTitle: {title}\nContent: {content}")
SYSTEM_PROMPT = ("You are a data extraction assistant. You MUST return ONLY valid JSON. "
                 "If no information is found for a field, return an empty array or null "
                 "as appropriate for the schema. Do not hallucinate.")
DEFAULT_MODEL = "qwen2.5:0.5b"
DEFAULT_ENDPOINT = "http://localhost:11434"
NO_TRANSCRIPT_NOTE = "(no transcript)"

# The white space of the Unicode character tables, which the reference's trimming removes.
WS = (" \t\n\r\f\v\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
      "\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(x) -> Column:
    x = _c(x)
    return F.when(x == "", F.lit(None)).otherwise(x)


def blank(x) -> Column:
    """True when the value is NULL or the empty string (the Go zero value)."""
    return F.coalesce(_c(x), F.lit("")) == ""


def trim_ws(x) -> Column:
    """Trim spaces, tabs and line breaks (plain ``trim`` only strips spaces)."""
    return F.btrim(_c(x), F.lit(WS))


# --- C1..C6 names -----------------------------------------------------------

def slug(x) -> Column:
    """Every code point outside [A-Za-z0-9] becomes one underscore."""
    x = _c(x)
    return F.when(blank(x), F.lit(UNKNOWN_SLUG)).otherwise(
        F.regexp_replace(x, "[^A-Za-z0-9]", "_"))


def raw_name(x) -> Column:
    return F.concat(slug(x), F.lit(RAW_SUFFIX))


def meta_name(x) -> Column:
    return F.concat(slug(x), F.lit(META_SUFFIX))


def audio_name(x) -> Column:
    return F.concat(slug(x), F.lit(AUDIO_SUFFIX))


def structured_suffix(scheme_id) -> Column:
    return F.concat(F.lit("_"), _c(scheme_id), F.lit(".json"))


def structured_name(x, scheme_id) -> Column:
    """The scheme id is used as given (not slugged)."""
    return F.concat(slug(x), structured_suffix(scheme_id))


def artifact_glob(kind: str, scheme_id: str | None = None) -> str:
    """Glob for ``pathGlobFilter``: ``*`` + the suffix of the artifact kind."""
    suffix = {"raw": RAW_SUFFIX, "meta": META_SUFFIX, "audio": AUDIO_SUFFIX}.get(kind)
    if kind == "structured":
        if not scheme_id:
            raise ValueError("structured artifacts need a scheme id")
        suffix = f"_{scheme_id}.json"
    if suffix is None:
        raise ValueError(f"unknown artifact kind {kind!r}")
    return "*" + suffix


# --- C7 content key -----------------------------------------------------------

def artifact_key(kind: str, url, *extras) -> Column:
    """``kind-`` + hex SHA-256 over each part followed by a zero byte.

    An empty or NULL URL has no stable identity: the key is NULL (uncacheable).
    """
    url = _c(url)
    zero = F.lit(bytearray(b"\x00"))
    parts = []
    for p in (url, *[_c(e) for e in extras]):
        parts += [F.encode(F.coalesce(p, F.lit("")), "UTF-8"), zero]
    digest = F.sha2(F.concat(*parts), 256)
    return F.when(blank(url), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(kind + "-"), digest))


# --- C8 content cut at a byte limit ----------------------------------------------

def _is_cont(b: Column, pos: int) -> Column:
    byte = F.substring(b, pos, 1)
    return (byte >= F.lit(bytearray(b"\x80"))) & (byte <= F.lit(bytearray(b"\xbf")))


def cut_bytes(x, limit: int = CONTENT_BYTE_LIMIT) -> Column:
    """Cut text at ``limit`` UTF-8 bytes and append ``...`` when longer.

    A code point split by the cut contributes one U+FFFD per byte kept, as
    the reference's JSON encoder renders the dangling bytes.
    """
    x = _c(x)
    b = F.encode(x, "UTF-8")
    # bytes of a split code point that stay before the cut (0..3)
    dangling = (F.when(~_is_cont(b, limit + 1), F.lit(0))
                .when(~_is_cont(b, limit), F.lit(1))
                .when(~_is_cont(b, limit - 1), F.lit(2))
                .otherwise(F.lit(3)))
    head = F.decode(b.substr(F.lit(1), F.lit(limit) - dangling), "UTF-8")
    cut = F.concat(head, F.repeat(F.lit("�"), dangling), F.lit(ELLIPSIS))
    return F.when(F.octet_length(x) > limit, cut).otherwise(x)


def extraction_content(transcript, description, limit: int = CONTENT_BYTE_LIMIT) -> Column:
    """First non-empty of transcript, description; then the byte cut."""
    content = F.coalesce(empty_to_null(transcript), empty_to_null(description), F.lit(""))
    return cut_bytes(content, limit)


# --- C9..C12 request texts ----------------------------------------------------------

def extraction_prompt(title, content, scheme) -> Column:
    head, rest = PROMPT_TEMPLATE.split("{scheme}")
    mid, tail = rest.split("{title}")
    mid2 = tail.split("{content}")[0]
    return F.concat(F.lit(head), _c(scheme), F.lit(mid), F.coalesce(_c(title), F.lit("")),
                    F.lit(mid2), F.coalesce(_c(content), F.lit("")))


def chat_request(prompt, model: str | Column = DEFAULT_MODEL,
                 system: str = SYSTEM_PROMPT) -> Column:
    """Chat body: system + user message, ``stream=false``. ``model`` is a
    literal name or a Column."""
    model = F.lit(model) if isinstance(model, str) else model
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")))
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"),
                              F.lit(False).alias("stream")))


def generate_request(prompt, model: str = DEFAULT_MODEL) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), _c(prompt).alias("prompt"),
                              F.lit(False).alias("stream")))


def transcription_hint(title, description) -> Column:
    """title + blank line + description; either alone when the other is empty."""
    return F.coalesce(F.concat_ws("\n\n", empty_to_null(title), empty_to_null(description)),
                      F.lit(""))


def transcribe_request(audio_url, hint) -> Column:
    """``{"audio_url":…}`` plus ``initial_prompt`` only when non-empty."""
    return F.to_json(F.struct(F.coalesce(_c(audio_url), F.lit("")).alias("audio_url"),
                              empty_to_null(hint).alias("initial_prompt")))


def raw_text(transcript, title) -> Column:
    """Transcript, else a markdown heading with the title and a note."""
    fallback = F.concat(F.lit("# "), F.coalesce(_c(title), F.lit("")),
                        F.lit("\n\n" + NO_TRANSCRIPT_NOTE + "\n"))
    return F.coalesce(empty_to_null(transcript), fallback)


def effective_id(id_col, audio_url) -> Column:
    """guid, else the audio URL (P10)."""
    return F.coalesce(empty_to_null(id_col), F.coalesce(_c(audio_url), F.lit("")))


def xml_escape(x) -> Column:
    x = _c(x)
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
