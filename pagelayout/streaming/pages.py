"""Page operators over streams of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that applies a page operator to every micro-batch and appends to Parquet.

    Operators work within a page, so a batch must hold whole pages: the source sends a
    page's rows together (one file, or one message with arrays). Each batch has its
    own folder, replaced when the batch is run again, so results come once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
