"""Enrichment stages over tables.

A stage is a user-supplied function from requests to replies. Each request
gets a value **or** an error, and one bad request never fails the others:

* a row function (``row_fn=True``) is called once for every request, and what
  it raises is that request's error;
* a batch function gets a series of requests and returns as many values; a
  value may be an exception, which is that request's error, and then too no
  call is repeated. A function that instead raises for the whole batch gets
  its requests one by one, so that the others are not lost (with
  ``retry=False`` they all take its error and nothing is called again).

Requests are built with JVM expressions. ``call_once`` asks for every distinct
key once, however many rows carry it, saves the replies (so that nothing that
reads them later, and no lost executor, repeats a call) and only then are
they joined back to the rows; rows themselves never pass through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import jsonfn as J
from feedloom.functions import strings as S
from feedloom.operators import memo as M
from feedloom.session import cut_lineage, release_memory, ship_package, small_batches

BatchFn = Callable[[pd.Series], Sequence]
RowFn = Callable[[str], str]
NOT_CONFIGURED = "stage not configured"


def _error_text(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def rowwise(fn: RowFn) -> BatchFn:
    """A one-request function as a batch function; its errors stay apart."""
    def batch(requests: pd.Series) -> list:
        out = []
        for x in requests:
            try:
                out.append(fn(x))
            except Exception as e:  # noqa: BLE001  (the request's own error)
                out.append(e)
        return out
    return batch


def _absent(v) -> bool:
    return v is None or isinstance(v, float) and v != v


def replies(batch_fn: BatchFn, requests: pd.Series, retry: bool = True) -> tuple[list, list]:
    """(values, errors) of one call of a batch function."""
    try:
        values = list(batch_fn(requests))
        if len(values) != len(requests):
            raise ValueError("stage returned a different number of rows")
    except Exception as e:  # noqa: BLE001  (the whole batch has failed)
        if not retry or len(requests) < 2:
            return [None] * len(requests), [_error_text(e)] * len(requests)
        each = [replies(batch_fn, requests.iloc[i:i + 1], False) for i in range(len(requests))]
        return [v for values, _ in each for v in values], [x for _, errors in each for x in errors]
    errors = [_error_text(v) if isinstance(v, BaseException) else None for v in values]
    return [None if e is not None or _absent(v) else str(v) for v, e in zip(values, errors)], errors


def enrich(df: DataFrame, fn: BatchFn | RowFn, request_col: str = "request",
           max_parallel: int | None = None, value_col: str = "reply",
           error_col: str = "error", row_fn: bool = False, retry: bool = True, keep_request: bool = True) -> DataFrame:
    """Adds ``reply`` (string) and ``error`` (string, NULL when ok), one
    call for every row of ``df``. Without ``keep_request`` the requests, which
    may be whole feeds, do not come back from Python.

    ``max_parallel`` bounds concurrent calls by the number of partitions
    (one task per partition). Filters must be applied *before* this call:
    Catalyst does not move them across ``mapInPandas``."""
    batch_fn = rowwise(fn) if row_fn else fn
    kept = [f for f in df.schema.fields if keep_request or f.name != request_col]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(value_col, T.StringType()), T.StructField(error_col, T.StringType())])

    def run(batches):
        try:
            for pdf in batches:
                out = pdf[names].copy(deep=False)
                out[value_col], out[error_col] = replies(batch_fn, pdf[request_col], retry)
                yield out
                del pdf, out                        # before the next batch is read
        finally:
            release_memory()

    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    src = df.repartition(max_parallel) if max_parallel else df
    return src.mapInPandas(run, schema)


def call_once(rows: DataFrame, fn: BatchFn | RowFn | None, key: Column, request: Column, *, order: Sequence[str] = (),
              max_parallel: int | None = None, row_fn: bool = False, stage: str = "stage") -> DataFrame:
    """(call_key, reply, error): one saved row for every distinct ``key`` of
    ``rows``, from one call. Rows without a key share a call when they make
    the same request. Of different requests under one key the first in
    ``order`` (then the smallest) is asked. Without ``fn`` every request has the
    error that the stage is not configured.

    Requests meet by a partial aggregate, so a key that a third of all rows
    carry is folded in every task before it moves."""
    asked = rows.select(call_key(key, request).alias("call_key"), request.alias("request"), *order)
    first = F.min(F.struct(*order, "request"))["request"]
    requests = asked.groupBy("call_key").agg(first.alias("request"))
    if fn is None:
        done = requests.select("call_key", F.lit(None).cast("string").alias("reply"),
                               F.lit(f"{stage}: {NOT_CONFIGURED}").alias("error"))
    else:
        done = enrich(requests, fn, "request", max_parallel, row_fn=row_fn, keep_request=False)
    return cut_lineage(done)


def call_key(key: Column, request: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit("request-"), F.sha2(request, 256)))


def _order_of(df: DataFrame) -> list[str]:
    return [c for c in ("feed_url", "position") if c in df.columns]


# --- N2 transcription -----------------------------------------------------------------

def transcribe(episodes: DataFrame, fn: BatchFn | RowFn | None, artifacts: DataFrame | None = None,
               max_parallel: int | None = None, row_fn: bool = False) -> tuple[DataFrame, DataFrame]:
    """(episodes with transcript + transcript_status/error, new artifacts).

    Given transcripts are kept; cached ones are recalled (M8); for the rest
    ``fn`` gets one ``{"audio_url", "initial_prompt"}`` request an audio URL,
    and the reply is read with the ASR reply rules."""
    eps = episodes.withColumn("transcript_key", M.transcript_key("audio_url"))
    eps = M.memo_join(eps, artifacts, "transcript_key", "_cached")
    empty = S.blank("transcript")
    request = S.transcribe_request("audio_url", S.transcription_hint("title", "description"))
    wanted = empty & F.col("_cached").isNull()
    calls = call_once(eps.where(wanted), fn, F.col("transcript_key"), request, order=_order_of(eps),
                      max_parallel=max_parallel, row_fn=row_fn, stage="transcribe")
    key = F.when(wanted, call_key(F.col("transcript_key"), request))
    out = eps.withColumn("call_key", key).join(calls, "call_key", "left")
    ok = F.col("error").isNull()
    out = (out.withColumn("transcript_status", F.when(~empty, F.lit("given")).when(~wanted, F.lit("cache"))
                          .when(ok, F.lit("ok")).otherwise(F.lit("error")))
           .withColumn("transcript_error", F.when(wanted, F.col("error")))
           .withColumn("transcript", F.when(~empty, F.col("transcript")).when(~wanted, F.col("_cached"))
                       .when(ok, J.parse_asr_response("reply")).otherwise(F.lit("")))
           .drop("_cached", "call_key", "reply", "error"))
    return out, _new_artifacts(out, calls, "transcript_key", "transcript", J.parse_asr_response("reply"), F.col("error").isNull())


def _new_artifacts(rows: DataFrame, calls: DataFrame, key: str, kind: str, value: Column, good: Column) -> DataFrame:
    """One artifact for every key that was called and answered: read from the
    saved calls, so no row and no call is repeated."""
    own = calls.where(good & ~F.col("call_key").startswith("request-")).select(F.col("call_key").alias(key), value.alias(kind))
    return M.artifact_rows(own, key, kind, kind, F.current_timestamp())


# --- N3 extraction -------------------------------------------------------------------------

def extract(episodes: DataFrame, fn: BatchFn | RowFn | None, scheme: str | None = None, scheme_id: str = "entry",
            artifacts: DataFrame | None = None, max_parallel: int | None = None,
            model: str = S.DEFAULT_MODEL, row_fn: bool = False) -> tuple[DataFrame, DataFrame]:
    """(episodes with entry + entry_status/error, new artifacts).

    The scheme is resolved once (J1); the content is the transcript or the
    description cut at 4000 bytes (C8); the reply's completion is parsed
    and merged (J3, J4). One call an audio URL, scheme and scheme id; only
    rows without error are memoised."""
    resolved = J.resolve_scheme(F.lit(scheme).cast("string"))
    eps = (episodes.withColumn("_scheme", resolved["scheme"])
           .withColumn("scheme_rejected", resolved["rejected"])
           .withColumn("entry_key", M.entry_key("audio_url", F.lit(scheme_id), F.col("_scheme"))))
    eps = M.memo_join(eps, artifacts, "entry_key", "_cached")
    request = S.chat_request(S.extraction_prompt("title", S.extraction_content("transcript", "description"), F.col("_scheme")), model)
    wanted = F.col("_cached").isNull()
    calls = call_once(eps.where(wanted), fn, F.col("entry_key"), request, order=_order_of(eps),
                      max_parallel=max_parallel, row_fn=row_fn, stage="extract")
    out = eps.withColumn("call_key", F.when(wanted, call_key(F.col("entry_key"), request))).join(calls, "call_key", "left")
    ok = F.col("error").isNull()
    out = (out.withColumn("_m", J.merge_response(J.chat_reply("reply")))
           .withColumn("entry", F.when(~wanted, F.col("_cached")).when(ok, F.col("_m.entry")))
           .withColumn("entry_status", F.when(~wanted, F.lit("cache")).when(ok, F.col("_m.status")).otherwise(F.lit("failed")))
           .withColumn("entry_error", F.when(wanted, F.coalesce(F.col("error"), F.when(
               F.col("_m.status") == "error", F.lit(J.NO_JSON_ERROR)))))
           .drop("_m", "_cached", "_scheme", "call_key", "reply", "error"))
    merged = J.merge_response(J.chat_reply("reply"))
    return out, _new_artifacts(out, calls, "entry_key", "entry", merged["entry"],
                               F.col("error").isNull() & (merged["status"] == "ok"))
