"""Sums of long vectors that tasks have gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released

#: Entries of a vector that one group adds up.
PIECE = 4096
#: Tasks whose vectors are added in the first of two rounds.
ROUND = 256


def sum_vectors(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of what `run` yields in every task (int64 vectors of `size` entries).

    Vectors travel as pieces and are added in two rounds, so that no group holds
    more than a few hundred tasks' pieces, whatever the number of tasks.
    """

    def gather(batches):
        for total in run(batches):
            cuts = range(0, size, PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(cuts))), pa.int32()), pa.array([total[a : a + PIECE].tobytes() for a in cuts], pa.binary())], names=["piece", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=np.int64) for x in table.column("part").to_pylist()]
        return pa.table({"piece": table.column("piece")[:1], "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    schema = "piece int, part binary"
    pieces = df.mapInArrow(released(gather), schema)
    # which first-round group a task's pieces join doesn't matter to the sum
    first = pieces.withColumn("round", F.floor(F.spark_partition_id() / ROUND)).groupBy("round", "piece").applyInArrow(lambda t: add(t.select(["piece", "part"])), schema)
    total = np.zeros(size, dtype=np.int64)
    for r in first.groupBy("piece").applyInArrow(add, schema).collect():
        part = np.frombuffer(r.part, dtype=np.int64)
        total[r.piece * PIECE : r.piece * PIECE + len(part)] = part
    return total
