"""Streamed model replies (S7): chunk lines -> one reply text per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.schemas import CHAT_REPLY_DDL, GENERATE_REPLY_DDL

PIECE_ROWS = 1024


def parse_chunk_lines(lines: DataFrame, line_col: str = "line", kind: str = "chat") -> DataFrame:
    """JSON chunk lines -> (…, content, done); chat chunks carry
    ``message.content``, generate chunks carry ``response``."""
    keep = [c for c in lines.columns if c != line_col]
    if kind == "chat":
        j = F.from_json(F.col(line_col), CHAT_REPLY_DDL)
        content = j["message"]["content"]
    else:
        j = F.from_json(F.col(line_col), GENERATE_REPLY_DDL)
        content = j["response"]
    return lines.select(*keep, F.coalesce(content, F.lit("")).alias("content"),
                        F.coalesce(j["done"], F.lit(False)).alias("done"))


def _join_sorted(seq: str, text: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text)))),
                                    lambda x: x[text]), "")


def assemble_chunks(chunks: DataFrame, request: str = "request_id", seq: str = "seq",
                    content: str = "content", done: str = "done",
                    piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(request_id, text, complete): chunks in ``seq`` order up to and
    including the first ``done`` chunk.

    The stop point is a partial ``min`` aggregate. Text is concatenated in
    two levels — pieces of ``piece_rows`` consecutive chunks, then the
    pieces — so a request with a huge number of chunks is split over many
    tasks before its (single) reply string is formed."""
    stop = chunks.groupBy(request).agg(F.min(F.when(F.col(done), F.col(seq))).alias("_stop"))
    kept = (chunks.join(stop, request, "inner")
            .where(F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))))
    pieces = (kept.groupBy(request, F.floor(F.col(seq) / piece_rows).alias("_piece"))
              .agg(_join_sorted(seq, content).alias("_text"), F.first("_stop").alias("_stop")))
    return (pieces.groupBy(request)
            .agg(_join_sorted("_piece", "_text").alias("text"),
                 F.first(F.col("_stop").isNotNull()).alias("complete")))
