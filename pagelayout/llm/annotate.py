"""Row-wise operators over texts: one Arrow pass that appends a struct to every row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import prepare, released

#: Given once a task: a function from a text column to a struct array of as many rows.
Maker = Callable[[], Callable[[pa.Array], pa.StructArray]]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _groups(batches: Iterable[pa.RecordBatch], at: int, held: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches whose texts have `held` bytes together, or more by the last; one at a time if it is 0."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(at).nbytes
        if size >= held:
            yield group
            group, size = [], 0
    if group:
        yield group


def annotate(docs: DataFrame, text: str, make: Maker, fields: T.StructType, name: str, held: int = 0) -> DataFrame:
    """`docs` with a struct column `name` (not null) computed from `text`; no shuffle.

    Texts go to the function a batch at a time, or `held` bytes of them where a call
    is worth more.
    """
    prepare(docs.sparkSession)
    if docs.columns.count(text) != 1:
        raise ValueError(f"column {text!r} must exist once")
    at = docs.columns.index(text)
    kept = docs.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, fields, False)])

    def run(batches):
        work = make()
        for group in _groups(batches, at, held):
            found = work(group[0].column(at) if len(group) == 1 else pa.chunked_array([b.column(at) for b in group]).combine_chunks())
            start = 0
            for batch in group:
                yield pa.RecordBatch.from_arrays([*batch.columns, found.slice(start, len(batch))], names=[*batch.schema.names, name])
                start += len(batch)

    return kept.mapInArrow(released(run), schema)
