"""Contiguous shards of nearly equal bytes, from global prefix sums.

Law `bytes`: rows are ordered by (key, size, CRC); a row's global prefix sum
decides its shard, cut at equal shares of the total. The sum has two levels:
totals per range of the order (one small row each), then a running sum within a
range, so no task sees more than a range and nothing is sorted in one place.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch

#: Rows per range aimed at; a range is one task's running sum.
RANGE_ROWS = 100_000
#: Ranges at most: bounds the table of totals, which one task sums and every executor gets.
MAX_RANGES = 20_000
#: Rows per range, about, that are drawn by a hash to find where ranges begin.
DRAWN = 10
#: Equal rows that are laid out together; more of them are split over tasks.
COPIES = 10_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _bounds(rows: DataFrame, order: list[str], n_ranges: int, n_rows: int) -> Column:
    """The sorted beginnings of ranges of nearly as many distinct rows, n_ranges - 1 at most, as a constant array.

    About DRAWN rows a range are drawn, so at most some MAX_RANGES * DRAWN small
    structs meet in one task. Rows are drawn by a hash of all of `order`, so the same
    on each run. Bounds need not be rows: whatever the way through text makes of
    them, they cut the order.
    """
    share = min(1.0, DRAWN * n_ranges / max(1, n_rows))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("bounds"), *order), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select(*order).distinct()
    every = drawn.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("d"))
    step = F.greatest(F.lit(1), F.ceil(F.size("d") / n_ranges)).cast("int")
    found = every.select(F.to_json(F.filter("d", lambda _, i: (i > 0) & (i % step == 0)))).first()[0]
    kind = T.ArrayType(T.StructType([rows.schema[c] for c in order]))
    return F.sort_array(F.from_json(F.lit(found), kind))


def _range_of(row: Column, bounds: Column) -> Column:
    """How many bounds lie below the row, by halving; the expression is the same whatever their number."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(MAX_RANGES.bit_length()))))

    def halved(x: Column) -> Column:
        def step(at: Column, n: Column) -> Column:
            ahead = at + n
            return F.when((ahead <= F.size(x["bounds"])) & (F.get(x["bounds"], ahead - 1) <= x["row"]), ahead).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    return F.get(F.transform(F.array(F.struct(row.alias("row"), bounds.alias("bounds"))), halved), F.lit(0))


def _laid_out(entries: DataFrame, many: int, range_rows: int, copies: int) -> DataFrame:
    """One row a copy, with `_copy`, its number among equals; `many` rows belong to entries of more than `copies` copies."""

    def copy_numbers(df: DataFrame, first: Column, n: Column) -> DataFrame:
        return df.withColumn("_copy", F.explode(F.sequence(first, first + n - 1)))

    few = copy_numbers(entries.where(F.col("_copies") <= copies), F.lit(0).cast("long"), F.col("_copies"))
    if not many:
        return few
    hot = entries.where(F.col("_copies") > copies).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / copies))))
    # pieces of one entry go to different tasks before they become rows
    hot = hot.repartition(max(1, -(-many // max(1, min(range_rows, 10 * copies)))), "_row", "_piece")
    first = F.col("_piece") * copies
    return few.unionByName(copy_numbers(hot, first, F.least(F.lit(copies).cast("long"), F.col("_copies") - first)).drop("_piece"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS, copies: int = COPIES) -> DataFrame:
    """Assign every row a shard 0..n_shards-1 and a gapless slot within it.

    Returns key, size, text_crc32, law, shard, slot, grown_shard. The shard is
    that of the row's middle byte, so each cut is within half a row of an equal
    share; a shard is empty only where one row outweighs a share. Null texts
    have size 1 and the CRC of no bytes; null keys come first; equal keys go by
    (size, CRC), and rows alike in all three are interchangeable. An empty
    table gives no rows. Other columns of `docs` are ignored, whatever their names.

    Equal rows are one entry with a count until the end, where they are laid out in
    pieces of `copies`; rows of one key that differ lie in as many ranges as they
    fill. So neither a key nor a text that a third of the rows share is one task's.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    light = docs.select(F.col(key).alias("_key"), text_size(F.col(text).cast("string")).alias("size"), F.crc32(body).alias("text_crc32"))
    order = ["_key", "size", "text_crc32"]
    entries = light.groupBy(*order).agg(F.count("*").alias("_copies"))
    n_rows = docs.count()
    n_ranges = max(1, min(MAX_RANGES, -(-n_rows // range_rows)))
    if n_ranges > 1:
        entries = entries.withColumn("_range", _range_of(F.struct(*order), _bounds(light, order, n_ranges, n_rows)))
    else:
        entries = entries.withColumn("_range", F.lit(0))
    entries = scratch.save(entries, "ranges")

    weight = F.col("size") * F.col("_copies")
    totals = entries.groupBy("_range").agg(F.sum(weight).alias("_bytes"), F.sum("_copies").alias("_rows"), F.sum(F.when(F.col("_copies") > copies, F.col("_copies")).otherwise(0)).alias("_many"))
    # one row a range, at most MAX_RANGES: read by the driver, sent to all
    base, first_row, many, sums = 0, 0, 0, []
    for r in sorted(totals.collect()):
        sums.append((r["_range"], base, first_row))
        base, first_row, many = base + r["_bytes"], first_row + r["_rows"], many + r["_many"]
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    before = F.broadcast(spark.createDataFrame(sums, "_range int, _base long, _first long"))

    def rows_of(some: DataFrame) -> DataFrame:
        """The rows of entries, with their shard and their number in the whole order."""
        placed = some.withColumns({"_within": within(weight), "_nth": within(F.col("_copies"))}).join(before, "_range")
        placed = placed.select(*order, "_copies", "_range", (F.col("_base") + F.col("_within")).alias("_start"), (F.col("_first") + F.col("_nth")).alias("_row"))
        rows = _laid_out(placed, many, range_rows, copies)
        rows = rows.withColumn("_middle", (F.col("_start") + F.col("_copy") * F.col("size")) * 2 + F.col("size"))
        # whole-number division, as a rounded quotient could cross a cut
        shard = F.least(F.expr(f"cast(_middle AS decimal(38,0)) * {n_shards} div cast({max(1, 2 * base)} AS decimal(38,0))").cast("int"), F.lit(n_shards - 1))
        return rows.select(*order, "_range", shard.alias("shard"), (F.col("_row") + F.col("_copy")).alias("_row"))

    # a shard's rows follow each other, so slots count from its first, which is in the range that its cut is in, or the next range's first
    starts = [0] * n_shards
    if sums:
        bases = [b for _, b, _ in sums]
        cut_in = {k: bisect_right(bases, k * base // n_shards) - 1 for k in range(1, n_shards)}
        some = entries.where(F.col("_range").isin([sums[i][0] for i in sorted(set(cut_in.values()))]))
        found = {(r["_range"], r["shard"]): r["n"] for r in rows_of(some).groupBy("_range", "shard").agg(F.min("_row").alias("n")).collect()}
        for k, i in cut_in.items():
            starts[k] = found.get((sums[i][0], k), sums[i + 1][2] if i + 1 < len(sums) else first_row)
    slot = F.col("_row") - F.get(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("shard"))
    return rows_of(entries).select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
