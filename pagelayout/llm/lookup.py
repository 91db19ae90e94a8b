"""Joins with a table of one row a key, where a few keys may have most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of fewer rows is never sent to all executors where the table is large, one of a larger share of the rows than 1 in MOST_HOT is.
HOT_ROWS = 512
#: Rows of a table (some dozen bytes each) that are sent at most: a whole table of no more, or as many hot keys of a larger one.
MOST_HOT = 100_000


def lookup(rows: DataFrame, table: DataFrame, on: str, weight: str, spread: Column, total: int, most: int | None = None) -> DataFrame:
    """`rows` that have a partner in `table` (one row a key `on`), with its other columns.

    A table of MOST_HOT rows or fewer is sent to all executors; `most`, where it is
    known, bounds its rows, else they are counted, so `table` should be a written one.
    Of a larger one, `weight` is the count of a key's rows and `total` their sum, or
    more. Keys of many rows are sent: at most MOST_HOT, as each has its share of the
    total. Only rows of other keys are exchanged by the key; those already served
    travel by `spread`, so no key gathers in a task.
    """
    columns = [c for c in table.columns if c not in (on, weight)]
    named = lambda df, p: df.select(F.col(on).alias(f"{p}key"), *(F.col(c).alias(p + c) for c in columns))
    kept = [c for c in rows.columns if c not in columns]
    if (table.count() if most is None else most) <= MOST_HOT:
        out = rows.join(F.broadcast(named(table, "_lookup_")), F.col(on) == F.col("_lookup_key"))
        return out.select(*kept, *(F.col(f"_lookup_{c}").alias(c) for c in columns))
    least = max(HOT_ROWS, total // MOST_HOT)
    hot, cold = named(table.where(F.col(weight) >= least), "_lookup_hot_"), named(table.where(F.col(weight) < least), "_lookup_cold_").withColumn("_lookup_cold_own", F.lit(0).cast("long"))
    served = F.col("_lookup_hot_key").isNotNull()
    out = rows.join(F.broadcast(hot), F.col(on) == F.col("_lookup_hot_key"), "left")
    out = out.withColumns({"_lookup_key": F.when(~served, F.col(on)), "_lookup_own": F.when(served, F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))})
    out = out.join(cold, (F.col("_lookup_key") == F.col("_lookup_cold_key")) & (F.col("_lookup_own") == F.col("_lookup_cold_own")), "left").where("_lookup_hot_key IS NOT NULL OR _lookup_cold_key IS NOT NULL")
    found = [F.when(served, F.col(f"_lookup_hot_{c}")).otherwise(F.col(f"_lookup_cold_{c}")).alias(c) for c in columns]
    return out.select(*kept, *found)
