"""What a streamed table already holds, by identity.

The table grows by one directory a batch (``batch=<n>``); looking through all
of them for every new batch would cost more with each. Its identities are
therefore kept beside it in a fixed number of buckets by hash
(``<table>_identities/bucket=<b>``), and a batch reads only the buckets that
its own rows fall into.

The batches are the truth and the buckets follow: before a batch is compared,
the batches committed since the last one are folded in (their numbers go on
from a marker file, so nothing is listed). Folding twice does no harm, an
identity is a member of a set; so a run that ends anywhere between the two
writes is made good by the next. A bucket of more than ``FILES`` files is
written anew. Single writer per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import cut_lineage
from feedloom.sinks.artifacts import _fs

BUCKETS = 256
FILES = 16


class IdentityIndex:
    """The identities of the table at ``path``; ``identity`` gives a row's."""

    def __init__(self, spark: SparkSession, path: str, identity: Column, buckets: int = BUCKETS, files: int = FILES):
        self.spark, self.path, self.identity, self.buckets, self.files = spark, path.rstrip("/"), identity, buckets, files
        self.store = f"{self.path}_identities"
        self.fs, _, self.jvm = _fs(spark, self.path)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # -- the marker: the first batch that is not folded yet

    def _next(self) -> int:
        marker = self._path(f"{self.store}/_next")
        if not self.fs.exists(marker):
            return 0
        stream = self.fs.open(marker)
        try:
            text = bytes(b & 255 for b in iter(stream.read, -1)).decode()
        finally:
            stream.close()
        return int(text) if text.isdigit() else 0               # a marker cut off in writing: fold again

    def _mark(self, n: int) -> None:
        stream = self.fs.create(self._path(f"{self.store}/_next"), True)
        stream.writeBytes(str(n))
        stream.close()

    # -- buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return (rows.select(self.identity.alias("identity")).distinct()
                .withColumn("bucket", F.pmod(F.xxhash64("identity"), F.lit(self.buckets)).cast("int")))

    def fold(self) -> int:
        """Take in the batches committed since the last call; returns the
        number of the next batch."""
        n = first = self._next()
        while self.fs.exists(self._path(f"{self.path}/batch={n}/_SUCCESS")):
            rows = self._bucketed(self.spark.read.parquet(f"{self.path}/batch={n}"))
            rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.store)
            n += 1
        if n > first:
            self._mark(n)
        return n

    def _held(self, bucket: int) -> list[str]:
        """The files of a bucket, written anew where there are too many."""
        folder = self._path(f"{self.store}/bucket={bucket}")
        if not self.fs.exists(folder):
            return []
        files = [st.getPath() for st in self.fs.listStatus(folder) if st.getPath().getName().endswith(".parquet")]
        if len(files) > self.files:
            rows = self.spark.read.schema("identity string").parquet(*[str(f) for f in files]).distinct()
            rows.coalesce(1).write.mode("append").parquet(str(folder))        # one bucket of ``buckets``
            for f in files:                                     # until here they only repeat what is in the new one
                self.fs.delete(f, False)
            files = [st.getPath() for st in self.fs.listStatus(folder) if st.getPath().getName().endswith(".parquet")]
        return [str(f) for f in files]

    def new_rows(self, rows: DataFrame) -> DataFrame:
        """The rows whose identity the table does not hold."""
        asked = rows.select(F.pmod(F.xxhash64(self.identity), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
        files = [f for r in asked if r.b is not None for f in self._held(r.b)]           # at most ``buckets`` * ``files``
        if not files:
            return rows
        known = self.spark.read.schema("identity string").parquet(*files).select(F.col("identity").alias("_known"))
        return rows.join(known, self.identity.eqNullSafe(F.col("_known")), "left_anti")

    def append_new(self, rows: DataFrame) -> int | None:
        """Append the rows that are new as the next batch; None without any."""
        n = self.fold()
        fresh = cut_lineage(self.new_rows(rows))
        if fresh.isEmpty():
            return None
        # A directory without its marker of success is of a run that ended early.
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        return n
