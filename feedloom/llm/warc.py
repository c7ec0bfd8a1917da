r"""WARC archives: write captures, read records, assemble transactions.

Writing. Every capture becomes three records: a request, a response (or a
revisit) and a metadata record; request and metadata name the response or
revisit in ``WARC-Concurrent-To``. Records are text rows of Spark's own text
writer, whose line separator is the two empty lines that end a WARC record, so
the part files are plain WARC (gzip compressed as a whole), are committed
task by task, and can be written wherever Spark writes. Among captures whose
payloads are equal and have at least ``min_revisit`` bytes, the one with the
largest key is the response and the others are revisits of it (profile
identical-payload-digest, ``WARC-Refers-To``). The first captures are found by
a partial aggregate over digests; payloads are shuffled at most once, in the
join with the digests that occur more than once.

Reading. Files come as binary rows (``records_per_file`` bounds their size)
and are parsed by ``Content-Length``, so payloads may hold anything, also text
that looks like a record. Gzip members, one or many, are recognised. Every
payload that is read is counted and hashed then and there; what the writer
put into the headers is only compared with it (``intact``).

Assembly. The records of one capture meet by the id that the request's and
metadata's ``WARC-Concurrent-To`` and the response's own ``WARC-Record-ID``
give: one partial aggregate makes one nested row of them.

Defined results: a null payload is empty; a null URL leaves
``WARC-Target-URI`` out; a null key is kept (no field in the metadata record);
rows equal in key, URL and payload are one capture written as often as it
occurs and come back as often; rows of one key that differ in URL or payload
are different captures, and of those with the largest key and equal payloads
the one with the largest URL is the response; an empty table gives an empty
archive, read back as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import workers_ready

CRLF = "\r\n"
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000
RECORDS_PER_FILE = 6000
CAPTURED_AT = "1970-01-01T00:00:00Z"

RECORD_DDL = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
              "date string, payload_digest string, headers map<string,string>, http_headers map<string,string>, "
              "http_start string, payload binary, read_bytes bigint, read_digest string")


def capture_id(key: Column, url: Column, digest: Column) -> Column:
    """A capture's record id: a URN from the hash of its key, URL and payload digest."""
    h = F.md5(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("~")),
                          F.coalesce(F.concat(F.lit("u"), url), F.lit("~")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def _sibling(capture: Column, kind: str) -> Column:
    """The id of a capture's request or metadata record."""
    h = F.md5(F.concat(capture, F.lit(kind)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: Column | str, record_id: Column, url: Column, block: Column, content_type: str, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION + CRLF), _field("WARC-Type", kind), _field("WARC-Record-ID", record_id),
        _field("WARC-Date", F.lit(CAPTURED_AT)), _field("WARC-Target-URI", url), *more,
        _field("Content-Type", F.lit(content_type)),
        _field("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)


def write_warc(pages: DataFrame, path: str, *, key_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_revisit: int = MIN_REVISIT,
               records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write every row of ``pages`` as a capture into WARC files under ``path``."""
    # A header value is one line: line ends in a URL are percent-encoded.
    url = F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(
        F.col(f"`{key_col}`").alias("k"), url.alias("u"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("p")
    ).withColumn("d", F.sha1(F.encode("p", "UTF-8"))).withColumn("n", F.octet_length("p"))
    # The digests that occur more than once, with their response.
    first = (rows.where(F.col("n") >= min_revisit).groupBy("d")
             .agg(F.max(F.struct("k", "u")).alias("first"), F.count(F.lit(1)).alias("c"))
             .where("c > 1").select("d", F.lit(True).alias("again"), F.col("first.k").alias("fk"), F.col("first.u").alias("fu")))
    rows = rows.join(first, "d", "left").withColumn("id", capture_id(F.col("k"), F.col("u"), F.col("d")))
    is_first = F.col("k").eqNullSafe(F.col("fk")) & F.col("u").eqNullSafe(F.col("fu"))
    rows = rows.withColumn("revisit", F.coalesce(F.col("again"), F.lit(False)) & (F.col("n") >= min_revisit) & ~is_first)
    u, cid = F.col("u"), F.col("id")
    digest = F.concat(F.lit("sha1:"), F.col("d"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    request = F.concat(F.lit("GET "), F.coalesce(u, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    facts = F.concat(_field("key", F.col("k").cast("string")), _field("payload-bytes", F.col("n").cast("string")))
    answer = F.when(F.col("revisit"), _record(
        "revisit", cid, u, head, "application/http; msgtype=response", _field("WARC-Payload-Digest", digest),
        _field("WARC-Profile", F.lit(REVISIT_PROFILE)),
        _field("WARC-Refers-To", capture_id(F.col("fk"), F.col("fu"), F.col("d"))),
        _field("WARC-Refers-To-Target-URI", F.col("fu")))).otherwise(_record(
            "response", cid, u, F.concat(head, F.col("p")), "application/http; msgtype=response",
            _field("WARC-Payload-Digest", digest)))
    records = F.array(
        _record("request", _sibling(cid, "request"), u, request, "application/http; msgtype=request",
                _field("WARC-Concurrent-To", cid)),
        answer,
        _record("metadata", _sibling(cid, "metadata"), u, facts, "application/warc-fields",
                _field("WARC-Concurrent-To", cid)))
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF)
     .option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of every record of a file."""
    while data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            out.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(out)
    at = 0
    while True:
        while data.startswith(b"\r\n", at):
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4:at]


def _http(block: bytes) -> tuple[str | None, dict, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    start, *lines = head.decode("latin-1").split(CRLF)
    headers = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return start, headers, body


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record (see ``RECORD_DDL``). The payload of a request or
    response is the HTTP body, of other records the block; ``payloads=False``
    leaves those of responses out."""
    workers_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest",
                 "headers", "http_headers", "http_start", "payload", "read_bytes", "read_digest"]
        text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
        types = [text] * 7 + [pairs, pairs, text, pa.binary(), pa.int64(), text]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for h, block in parse_records(data.as_py()):
                    start, http, body = None, {}, block
                    if h.get("content-type", "").startswith("application/http"):
                        start, http, body = _http(block)
                    kind, n, digest = h.get("warc-type"), len(body), hashlib.sha1(body).hexdigest()
                    if not payloads and kind == "response":
                        body = None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"),
                                 list(h.items()), list(http.items()), start, body, n, digest))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 4000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
            .mapInArrow(run, RECORD_DDL))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``target_uri`` and the
    structs ``request``, ``response`` (response or revisit) and ``metadata``
    (null where an archive lacks one). Captures that occur repeatedly come
    repeatedly."""
    kind = F.col("record_type")
    answer = kind.isin("response", "revisit")
    whole = F.struct("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "headers",
                     "http_start", "http_headers", "payload", "read_bytes", "read_digest")
    joined = (records.where(kind.isin("request", "response", "revisit", "metadata"))
              .withColumn("capture_id", F.when(answer, F.col("record_id")).otherwise(
                  F.coalesce("concurrent_to", "record_id")))
              .groupBy("capture_id")
              .agg(F.first(F.when(kind == "request", whole), ignorenulls=True).alias("request"),
                   F.first(F.when(answer, whole), ignorenulls=True).alias("response"),
                   F.first(F.when(kind == "metadata", whole), ignorenulls=True).alias("metadata"),
                   F.greatest(F.sum(F.when(answer, 1).otherwise(0)), F.lit(1)).alias("times")))
    return joined.select(F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_n"), "*").select(
        "capture_id", F.coalesce(F.col("response.target_uri"), F.col("request.target_uri"),
                                 F.col("metadata.target_uri")).alias("target_uri"),
        "request", "response", "metadata")


def warc_fields(metadata: Column, name: str) -> Column:
    """A field of an application/warc-fields block."""
    value = F.regexp_extract(F.decode(metadata, "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def captures(transaction_rows: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers,
    capture_id, target_uri, intact) of assembled captures. Length and digest
    of a response are those of the payload that was read; a revisit has no
    payload of its own and says what its headers say (``resolve`` puts the
    figures of the response it refers to there). ``intact``: the headers agree
    with the payload."""
    own = F.col("response.record_type") == "response"
    said = F.lower(F.substring_index(F.col("response.payload_digest"), ":", -1))
    length = F.coalesce(F.col("response.http_headers")["content-length"],
                        warc_fields(F.col("metadata.payload"), "payload-bytes")).cast("bigint")
    n, digest = F.col("response.read_bytes"), F.col("response.read_digest")
    return transaction_rows.select(
        "capture_id", "target_uri", warc_fields(F.col("metadata.payload"), "key").cast("bigint").alias("page_id"),
        F.when(own, n).otherwise(length).alias("payload_bytes"), F.when(own, digest).otherwise(said).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("refers"),
        F.when(own, (n == F.coalesce(length, n)) & (digest == F.coalesce(said, digest))).alias("intact"))


def resolve(capture_rows: DataFrame) -> DataFrame:
    """Replaces the record id that a revisit refers to by that capture's key,
    and gives the revisit the length and digest read from its payload; a
    revisit whose headers say otherwise is not ``intact``."""
    named = capture_rows.where("refers is not null").select(F.col("refers").alias("capture_id")).distinct()
    keys = (capture_rows.join(named, "capture_id", "left_semi")
            .groupBy(F.col("capture_id").alias("refers")).agg(
                F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_n"), F.max("payload_digest").alias("_d")))
    same = (F.col("payload_bytes") == F.col("_n")) & (F.col("payload_digest") == F.col("_d"))
    return capture_rows.join(keys, "refers", "left").select(
        "page_id", F.coalesce("_n", "payload_bytes").alias("payload_bytes"), F.coalesce("_d", "payload_digest").alias("payload_digest"),
        "record_type", "refers_to", "capture_id", "target_uri", F.coalesce("intact", same, F.lit(False)).alias("intact"))
