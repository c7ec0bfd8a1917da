"""Run-level composition: options (R6, R7), the per-episode flow (N4),
the generic document pipeline (D1-D3) and named stage replacement (D4)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators import memo as M
from feedloom.operators import status as R
from feedloom.operators.enrich import extract, transcribe
from feedloom.operators.validate import limit_per_feed, with_reject_reason
from feedloom.session import cut_lineage, ship_package
from feedloom.sinks import artifacts as K
from feedloom.functions.strings import DEFAULT_ENDPOINT, DEFAULT_MODEL

STAGES = ("download", "transcribe", "extract", "store", "feed")


@dataclass
class RunOptions:
    """One place for every run setting.

    ``scheme_id`` without ``scheme`` names the outputs but keeps the default
    schema (R7). ``fail_fast`` stops after the first stage with an error
    (R3); ``raise_on_error`` fails the run at the end (R2)."""
    limit: int = 0
    policy: str = "strict"
    scheme: str | None = None
    scheme_id: str = "entry"
    model: str = DEFAULT_MODEL
    endpoint: str = DEFAULT_ENDPOINT
    max_parallel: int | None = None
    store: M.StoreSettings = field(default_factory=M.StoreSettings)
    output_dir: str | None = None
    fail_fast: bool = False
    raise_on_error: bool = False
    on_status: Callable[[DataFrame], None] | None = None


class RunResult(NamedTuple):
    episodes: DataFrame
    transcripts: DataFrame
    entries: DataFrame
    status: DataFrame
    summary: DataFrame
    new_artifacts: DataFrame


def process_episodes(episodes: DataFrame, stages: dict[str, Callable], options: RunOptions | None = None,
                     artifacts: DataFrame | None = None) -> RunResult:
    """Validate -> limit -> transcribe (memoised) -> raw output ->
    extract (memoised) -> structured output + sidecar -> status.

    Each stage with external calls is checkpointed before the next one, so
    recomputation after a lost executor never repeats a call."""
    o = options or RunOptions()
    t0 = time.time()
    store = M.MemoStore(episodes.sparkSession, o.store)
    if artifacts is None and store.enabled:
        artifacts = store.load()
    tagged = with_reject_reason(episodes, o.policy)
    rejected = tagged.where(F.col("reject_reason").isNotNull())
    valid = limit_per_feed(tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), o.limit)

    transcribed, _ = transcribe(valid, stages["transcribe"], artifacts, o.max_parallel)
    transcribed = cut_lineage(transcribed)
    st_t = R.stage_status(transcribed, "transcribe", "transcript_status", "transcript_error")
    if o.fail_fast and not st_t.where(F.col("status") == "error").isEmpty():
        R.raise_on_error(st_t)

    ready = transcribed.where(F.col("transcript_status") != "error")
    if o.output_dir:
        K.write_raw(ready, f"{o.output_dir}/raw")
    extracted, _ = extract(ready, stages["extract"], o.scheme, o.scheme_id, artifacts,
                           o.max_parallel, o.model)
    extracted = cut_lineage(extracted)
    # New artifacts come from the checkpointed outputs: reading them never
    # repeats an external call.
    now = F.current_timestamp()
    new_artifacts = (
        M.artifact_rows(transcribed.where(F.col("transcript_status") == "ok"), "transcript_key", "transcript",
                        "transcript", now)
        .unionByName(M.artifact_rows(extracted.where(F.col("entry_status") == "ok"), "entry_key", "entry",
                                     "entry", now)))
    if store.enabled:
        store.record_reads(
            transcribed.where(F.col("transcript_status") == "cache").select(F.col("transcript_key").alias("key"))
            .unionByName(extracted.where(F.col("entry_status") == "cache").select(F.col("entry_key").alias("key"))))
        store.save(new_artifacts)
    st_e = R.stage_status(extracted, "extract", "entry_status", "entry_error")
    if o.output_dir:
        good = extracted.where(F.col("entry_status").isin("ok", "cache", "malformed"))
        K.write_structured(good, f"{o.output_dir}/structured", o.scheme_id)
        K.write_metadata(good, f"{o.output_dir}/metadata")

    st_v = rejected.select(
        F.col("feed_url"), F.coalesce("id", F.lit("")).alias("episode_id"), F.lit("validate").alias("stage"),
        F.lit("rejected").alias("status"), F.col("reject_reason").alias("error"),
        F.lit(None).cast("string").alias("error_class"))
    status = st_v.unionByName(st_t).unionByName(st_e)
    summary = R.summarize(status).withColumn("limit", F.lit(o.limit)) \
        .withColumn("seconds", F.lit(round(time.time() - t0, 3)))
    if o.on_status:
        o.on_status(status)
    if o.raise_on_error:
        R.raise_on_error(status)
    return RunResult(valid, transcribed, extracted, status, summary, new_artifacts)


# --- D1..D3 document pipeline -----------------------------------------------------------------

class FlowError(RuntimeError):
    pass


def read_documents(df: DataFrame, id: str, content: str, source_id: str | None = None,
                   metadata: Iterable[str] = ()) -> DataFrame:
    """Any table -> Document rows (id, source_id, metadata map, content)."""
    pairs = []
    for c in metadata:
        pairs += [F.lit(c), F.col(c).cast("string")]
    meta = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select(F.col(id).cast("string").alias("id"),
                     (F.col(source_id).cast("string") if source_id else F.lit("")).alias("source_id"),
                     meta.alias("metadata"), F.col(content).cast("string").alias("content"))


def row_transform(fn: Callable[[dict], dict], schema: str | T.StructType | None = None) -> Callable[[DataFrame], DataFrame]:
    """D3: a per-document function as a DataFrame transform (Arrow
    batches). ``fn`` receives and returns a dict; a raised error is kept
    in ``_error`` for the pipeline to report."""
    def apply(df: DataFrame) -> DataFrame:
        out_schema = schema or df.schema
        if isinstance(out_schema, str):
            out_schema = T._parse_datatype_string(out_schema)
        out_schema = T.StructType([f for f in out_schema.fields if f.name != "_error"]
                                  + [T.StructField("_error", T.StringType())])
        names = [f.name for f in out_schema.fields]

        def run(batches):
            for pdf in batches:
                rows = []
                for rec in pdf.to_dict("records"):
                    try:
                        r = dict(fn(dict(rec)))
                        r["_error"] = rec.get("_error")
                    except Exception as e:  # noqa: BLE001
                        r = dict(rec)
                        r["_error"] = f"{type(e).__name__}: {e}"
                    rows.append({n: r.get(n) for n in names})
                yield pd.DataFrame(rows, columns=names)
        ship_package(df.sparkSession)
        return df.mapInPandas(run, out_schema)
    return apply


class DocumentFlow:
    """Source -> transforms in order -> sinks in order.

    Transforms are ``DataFrame -> DataFrame``. Rows that carry an
    ``_error`` abort the run before any sink, naming the first document
    (by id). ``max_parallel`` repartitions before the transforms."""

    def __init__(self, source, transforms: Iterable[Callable[[DataFrame], DataFrame]] = (),
                 sinks: Iterable[Callable[[DataFrame], object]] = ()):
        self.source = source
        self.transforms = list(transforms)
        self.sinks = list(sinks)

    def build(self, spark: SparkSession | None = None, max_parallel: int | None = None) -> DataFrame:
        df = self.source(spark) if callable(self.source) else self.source
        if max_parallel and max_parallel > 1:
            df = df.repartition(max_parallel)
        for t in self.transforms:
            df = df.transform(t)
        return df

    def run(self, spark: SparkSession | None = None, max_parallel: int | None = None) -> DataFrame:
        df = self.build(spark, max_parallel)
        if "_error" in df.columns:
            df = cut_lineage(df)
            bad = df.where(F.col("_error").isNotNull()).orderBy("id").limit(1).collect()
            if bad:
                raise FlowError(f"document {bad[0]['id']}: {bad[0]['_error']}")
            df = df.drop("_error")
        K.emit(df, self.sinks)
        return df


# --- D4 named stage replacement ----------------------------------------------------------------

def register_stage(spark: SparkSession, name: str, fn: Callable[[str], str]) -> None:
    """Expose a request -> reply stage to SQL as a vectorised UDF."""
    @F.pandas_udf(T.StringType())
    def stage(requests: pd.Series) -> pd.Series:
        return requests.map(fn)
    ship_package(spark)
    spark.udf.register(name, stage)
