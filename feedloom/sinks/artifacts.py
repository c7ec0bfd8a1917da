"""Artifact outputs (K1-K6) and their readers.

Outputs are parquet tables in append-only *batches*: each write is one new
``batch=<n>`` directory committed by Spark's file commit protocol, and a
batch counts only once its ``_SUCCESS`` marker exists, so readers see old or
new, never a partial write (K5). Single writer per table.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.strings import effective_id, meta_name, raw_name, raw_text, structured_name
from feedloom.operators.latest import Picked, pick
from feedloom.session import cut_lineage, release_memory, ship_package, small_batches


# --- batch directories -------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def committed_batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(n, dir) of every committed batch under ``path``, oldest first."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("batch="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append((int(name.split("=", 1)[1]), st.getPath().toString()))
    return sorted(out)


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """All committed batches with a ``batch`` column; None when empty."""
    batches = committed_batches(spark, path)
    if not batches:
        return None
    r = spark.read.option("basePath", path)
    if schema:
        r = r.schema(schema + ", batch int")
    return r.parquet(*[d for _, d in batches])


def append_batch(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next batch; returns its number."""
    spark = df.sparkSession
    batches = committed_batches(spark, path)
    n = (batches[-1][0] + 1) if batches else 0
    # An uncommitted directory (no _SUCCESS) is invisible to readers, so a
    # retried write may replace it.
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")
    return n


def latest_by(df: DataFrame, key: str, order: str = "batch") -> DataFrame:
    """Latest row per key: partial ``max_by`` aggregate, so a hot key is
    combined map-side instead of gathered in one task."""
    cols = [c for c in df.columns if c not in (key,)]
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("_v"))
            .select(key, *[F.col("_v")[c].alias(c) for c in cols]))


# --- K1 raw outputs -------------------------------------------------------------------

def raw_table(episodes: DataFrame) -> DataFrame:
    """(name, episode_id, text): transcript or the no-transcript heading."""
    eid = effective_id("id", "audio_url")
    return episodes.select(raw_name(eid).alias("name"), eid.alias("episode_id"),
                           raw_text("transcript", "title").alias("text"))


def write_raw(episodes: DataFrame, path: str) -> int:
    """Always overwrites: readers take the latest batch per name."""
    return append_batch(raw_table(episodes), path)


def read_raw(spark: SparkSession, path: str) -> DataFrame | None:
    b = read_batches(spark, path)
    return None if b is None else latest_by(b, "name").drop("batch")


# --- K2..K4 structured entries and sidecars ----------------------------------------------

def structured_rows(entries: DataFrame, scheme_id: str | Column) -> DataFrame:
    """(name, episode_id, scheme_id, entry) from (id, audio_url, entry)."""
    sid = F.lit(scheme_id) if isinstance(scheme_id, str) else scheme_id
    eid = effective_id("id", "audio_url")
    return entries.select(structured_name(eid, sid).alias("name"), eid.alias("episode_id"),
                          sid.alias("scheme_id"), F.col("entry"))


def metadata_rows(entries: DataFrame) -> DataFrame:
    """Sidecar (name, episode_id, audio_url, title, pub_date); named by the
    effective id, carrying the guid as given."""
    eid = effective_id("id", "audio_url")
    return entries.select(meta_name(eid).alias("name"), F.coalesce("id", F.lit("")).alias("episode_id"),
                          F.coalesce("audio_url", F.lit("")).alias("audio_url"),
                          F.coalesce("title", F.lit("")).alias("title"),
                          F.coalesce("pub_date", F.lit("")).alias("pub_date"))


def once_each(rows: DataFrame) -> Picked:
    """Each name once: of rows whose ids share a name the one with the
    smallest id stays (of rows without ids, the smallest row); the others
    are ``lost``."""
    by = ["episode_id"] if "episode_id" in rows.columns else [c for c in rows.columns if c != "name"]
    return pick(rows, "name", [F.col(c) for c in by], smallest=True)


def new_rows(rows: DataFrame, existing_names: DataFrame | None) -> DataFrame:
    """Skip rule: only names not written before, and each name once
    (``collisions`` lists what that leaves out)."""
    kept = once_each(rows).kept
    return kept if existing_names is None else kept.join(existing_names.select("name"), "name", "left_anti")


def collisions(picked: Picked) -> DataFrame:
    """(name, episode_id, kept_id, rows): the ids that lost their name to
    another id, and how many rows they had. Repeated rows of the id that
    stays are no collision."""
    lost = picked.lost.groupBy("name", "episode_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = picked.kept.select("name", F.col("episode_id").alias("kept_id"))
    return (lost.join(kept, "name").where(~F.col("episode_id").eqNullSafe(F.col("kept_id")))
            .select("name", "episode_id", "kept_id", "rows"))


def name_collisions(rows: DataFrame) -> DataFrame:
    """(name, rows): names that different rows of a batch would write to."""
    rest = [c for c in rows.columns if c != "name"]
    return (rows.groupBy("name").agg(F.count_distinct(F.struct(*rest)).alias("rows")).where("rows > 1"))


def _append_once(rows: DataFrame, path: str, skip: bool) -> int:
    """Append each name once; what loses its name goes to ``<path>_collisions``
    as part of the same write, so that no row is left out unreported."""
    picked = once_each(rows)
    old = read_batches(rows.sparkSession, path) if skip else None
    kept = picked.kept if old is None else picked.kept.join(old.select("name"), "name", "left_anti")
    lost = cut_lineage(collisions(picked))
    if not lost.isEmpty():
        append_batch(lost, f"{path.rstrip('/')}_collisions")
    return append_batch(kept, path)


def read_collisions(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, episode_id, kept_id, rows, batch) of all writes to ``path``."""
    return read_batches(spark, f"{path.rstrip('/')}_collisions")


def write_structured(entries: DataFrame, path: str, scheme_id: str, mode: str = "skip") -> int | None:
    """Write entries absent for (slug, scheme); ``mode='overwrite'`` replaces."""
    if mode not in ("skip", "overwrite"):
        raise ValueError(mode)
    return _append_once(structured_rows(entries, scheme_id), path, mode == "skip")


def write_metadata(entries: DataFrame, path: str) -> int:
    """Back-fill sidecars independently of the structured entries."""
    return _append_once(metadata_rows(entries), path, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    b = read_batches(spark, path)
    return None if b is None else latest_by(b, "name").drop("batch")


# --- K6 emit ----------------------------------------------------------------------------

def emit(df: DataFrame, sinks: Iterable[Callable[[DataFrame], object]]) -> list:
    """Send the final table to each sink in order. With more than one sink
    the table is checkpointed first so no upstream stage (external calls)
    runs twice."""
    sinks = list(sinks)
    if len(sinks) > 1:
        df = cut_lineage(df)
    return [s(df) for s in sinks]


# --- file exports and S5 / S8 readers ----------------------------------------------------------

def export_files(df: DataFrame, path: str, name_col: str = "name", text_col: str = "text") -> None:
    """One text output per name (``<path>/name=<name>/part-*``).

    Rows are hash-partitioned by name first, so each name is written by one
    task (one file) and the many small files are spread over all tasks.
    This is the reference's file-per-episode layout, for interchange; it is
    bound by file-system metadata operations, and the batch tables above
    are the primary sink.

    In Hadoop's local file system each new folder, file and checksum file
    starts a process, and one thread renames all of them in the end. There
    (a disk, or a mount that all executors share) the tasks write the files
    themselves, each under a hidden name until it is whole."""
    spark = df.sparkSession
    fs, p, jvm = _fs(spark, path)
    if fs.getUri().getScheme() != "file":
        df.select(name_col, text_col).repartition(name_col).write.mode("append").partitionBy(name_col).text(path)
        return
    ship_package(spark)
    small_batches(spark)
    folder, part = fs.makeQualified(p).toUri().getPath(), f"part-{uuid.uuid4().hex}.txt"
    # No name, an empty one and the folder's own name share a folder, as Spark writes them.
    name = F.coalesce(F.nullif(F.col(name_col).cast("string"), F.lit(_NO_NAME)), F.lit(""))
    (df.select(name.alias("name"), F.col(text_col).cast("binary").alias("text"))
     .repartition("name").sortWithinPartitions("name")
     .mapInArrow(lambda batches: _write_files(batches, folder, name_col, part), "files bigint")
     .agg(F.sum("files")).collect())
    fs.mkdirs(p)
    fs.create(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"), True).close()


#: What Spark escapes in the name of a partition folder, and the folder of no name.
_ESCAPED = {i: f"%{i:02X}" for i in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^"))}
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, name_col: str, part: str) -> Iterator[pa.RecordBatch]:
    """Write sorted (name, text) rows, a line each, and count the files. A
    file's place depends on its name alone and it appears there whole, so a
    task that is run again writes the same files."""
    files, last, out, hidden, whole = 0, None, None, "", ""
    own = f".{part}-{uuid.uuid4().hex}"

    def finish():
        out.close()
        os.replace(hidden, whole)

    try:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None or name != last:
                    if out is not None:
                        finish()
                    home = f"{folder}/{name_col.translate(_ESCAPED)}={name.translate(_ESCAPED) or _NO_NAME}"
                    os.makedirs(home, exist_ok=True)
                    hidden, whole, last = f"{home}/{own}", f"{home}/{part}", name
                    out = open(hidden, "wb")  # noqa: SIM115  (open over batches)
                    files += 1
                out.write((text or b"") + b"\n")
        if out is not None:
            finish()
    finally:
        if out is not None:
            out.close()
        release_memory()
    yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])


#: Suffix of the known kinds of artifact; a structured output's is its scheme's.
KIND_PATTERN = r"(_raw\.txt|_meta\.json|\.mp3|_[^_]+\.json)$"


#: Rows of ``export_bundles``.
BUNDLE_DDL = "name string, text string, kind string"


def export_bundles(df: DataFrame, path: str, name_col: str = "name", text_col: str = "text") -> None:
    """Many artifacts a file: (name, text) rows in one folder for each kind
    (``kind=<suffix>``), committed by Spark. The number of files follows the
    partitions, not the artifacts, and a harvest by kind reads one folder."""
    kind = F.regexp_extract(F.col(name_col), KIND_PATTERN, 1)
    (df.select(F.col(name_col).alias("name"), F.col(text_col).alias("text"), F.when(kind != "", kind).otherwise(F.lit("other")).alias("kind"))
     .write.mode("append").partitionBy("kind").parquet(path))


def _like(glob: str) -> str:
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def _plain_suffix(glob: str | None) -> str | None:
    """What a glob asks a name to end with, if that is all it asks."""
    return glob[1:] if glob and glob.startswith("*") and not set("*?") & set(glob[1:]) else None


def _slug_of(name: Column, suffix: str | None) -> Column:
    """The asked suffix is the artifact's; without one the known kinds decide."""
    end = F.lit(suffix) if suffix else F.regexp_extract(name, KIND_PATTERN, 1)
    return name.substr(F.lit(1), F.length(name) - F.length(end))


def read_bundles(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, slug, text) of ``export_bundles`` folders; a glob for a known
    kind reads that kind's folder alone."""
    rows, suffix = spark.read.schema(BUNDLE_DDL).parquet(path), _plain_suffix(glob)
    if suffix and re.fullmatch(KIND_PATTERN.rstrip("$"), suffix):
        rows = rows.where(F.col("kind") == suffix)
    if glob:
        rows = rows.where(F.col("name").like(_like(glob)))
    return rows.select("name", _slug_of(F.col("name"), suffix).alias("slug"), "text")


def read_artifacts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, slug, path, text) from files; ``glob`` like ``*_raw.txt``.

    Works for plain per-file folders and for ``export_files`` layouts, where
    the artifact name is the partition directory."""
    r = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    raw = r.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    dir_name = F.regexp_extract("path", r"name=([^/]+)/[^/]+$", 1)
    file_name = F.regexp_extract("path", r"([^/]+)$", 1)
    name = F.when(dir_name != "", F.url_decode(dir_name)).otherwise(file_name)
    # Spark's text writer ends every row with one line separator.
    text = F.when((dir_name != "") & F.col("text").endswith("\n"),
                  F.col("text").substr(F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    out = raw.select(name.alias("name"), "path", text.alias("text"))
    if glob:
        out = out.where(F.col("name").like(_like(glob)))
    slug = _slug_of(F.col("name"), _plain_suffix(glob))
    return out.select("name", slug.alias("slug"), "path", "text")


def read_scheme(spark: SparkSession, path: str) -> DataFrame:
    """(scheme_json, scheme_id): whole file text; id = base name without extension."""
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    return raw.select(F.col("value").alias("scheme_json"),
                      F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("scheme_id"))
