"""Sums of one vector a task, added up as a tree of bounded fan-in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the vectors: the task, the chunk of the vector, the numbers of the chunk.
DDL = "node int, part int, vector binary"
FAN = 16
CHUNK = 65_536


def chunks(node: int, vector: np.ndarray, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of one task's vector; chunks of zeros only are left out."""
    for i in range(0, len(vector), chunk):
        piece = vector[i:i + chunk]
        if piece.any():
            yield _row(node, i // chunk, piece)


def _row(node: int, part: int, piece: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([part], pa.int32()),
                                       pa.array([piece.tobytes()], pa.binary())], names=["node", "part", "vector"])


def tree_sum(rows: DataFrame, nodes: int, size: int, dtype: type, fan: int = FAN, chunk: int = CHUNK) -> np.ndarray:
    """The sum of the vectors of tasks 0 .. ``nodes`` - 1. A task adds the
    chunks of at most ``fan`` others, one at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for node, part, piece in zip(*(c.to_pylist() for c in b.columns)):
                if at is not None and at != (node, part):
                    yield _row(*at, total)
                    at = None
                if at is None:
                    at, total = (node, part), np.frombuffer(piece, dtype).copy()
                else:
                    total += np.frombuffer(piece, dtype)
        if at is not None:
            yield _row(*at, total)

    while nodes > 1:
        nodes = math.ceil(nodes / fan)
        rows = (rows.withColumn("node", F.floor(F.col("node") / fan).cast("int")).repartition("node", "part")
                .sortWithinPartitions("node", "part").mapInArrow(add, DDL))
    out = np.zeros(size, dtype)
    for r in rows.toLocalIterator():                            # the one vector that is left
        piece = np.frombuffer(bytes(r.vector), dtype)
        out[r.part * chunk:r.part * chunk + len(piece)] += piece
    return out
