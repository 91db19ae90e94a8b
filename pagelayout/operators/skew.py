"""Skew estimates (I1-I9). Grids are cells (id, r, c, z)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.workers import ship


def cross_correlation(cells: DataFrame, key: str, d: int, s_range: int, horizontal: bool = False) -> DataFrame:
    """(key, s, value): mean over column (row) pairs d apart of the summed products of z scores, at shift s.

    The sum over n points is n times the correlation; pairs with a flat side don't count.
    """
    line, along = ("r", "c") if horizontal else ("c", "r")
    a = cells.select(key, F.col(line).alias("_line"), F.col(along).alias("_i"), F.col("z").alias("_a"), F.explode(F.sequence(F.lit(-s_range), F.lit(s_range))).alias("s"))
    b = cells.select(key, (F.col(line) - d).alias("_line"), F.col(along).alias("_j"), F.col("z").alias("_b"))
    pairs = a.withColumn("_j", F.col("_i") + F.col("s")).join(b, [key, "_line", "_j"])
    flat = lambda c: F.stddev_pop(c) <= 1e-10
    each = pairs.groupBy(key, "s", "_line").agg(F.when(~(flat("_a") | flat("_b")), F.covar_pop("_a", "_b") / (F.stddev_pop("_a") * F.stddev_pop("_b")) * F.count("*")).alias("v"))
    return each.groupBy(key, "s").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("value"))


def total_variation(signal: DataFrame, key: str) -> DataFrame:
    """Sum of the absolute steps of (key, s, value)."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy(key).orderBy("s"))
    return signal.withColumn("_d", F.abs(step)).groupBy(key).agg(F.sum("_d").alias("tv"))


def peaks(signal: DataFrame, key: str) -> DataFrame:
    """I4: (key, rank, s, value): strict local maxima, greatest first; the first greatest value where there are none."""
    w, all_ = Window.partitionBy(key).orderBy("s"), Window.partitionBy(key)
    df = signal.withColumn("_local", F.coalesce((F.col("value") > F.lag("value").over(w)) & (F.col("value") > F.lead("value").over(w)), F.lit(False)))
    df = df.withColumns({"_any": F.max("_local").over(all_), "_first": F.row_number().over(all_.orderBy(F.desc("value"), "s"))})
    kept = df.where(F.col("_local") | (~F.col("_any") & (F.col("_first") == 1)))
    return kept.select(key, F.row_number().over(all_.orderBy(F.desc("value"), "s")).alias("rank"), "s", "value")


def _angle(s: Column, d: int) -> Column:
    return F.atan(s / d) * (180 / math.pi)


def region_angles(cells: DataFrame, key: str, d: int, s_range: int, d_second: int | None = None, least_tv: float = 10.0) -> DataFrame:
    """(key, angle): of the direction that varies more; null where neither reaches `least_tv`.

    Where there is more than one peak, the best shift at distance `d_second` is averaged in if it agrees within a degree.
    """
    found = {}
    for name, horizontal in (("v", False), ("h", True)):
        signal = cross_correlation(cells, key, d, s_range, horizontal)
        tops = peaks(signal, key).groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("s"))).alias(f"{name}_s"), F.count("*").alias(f"{name}_n"))
        found[name] = total_variation(signal, key).withColumnRenamed("tv", f"{name}_tv").join(tops, key)
        if d_second not in (None, d):
            again = peaks(cross_correlation(cells, key, d_second, s_range, horizontal), key).where("rank = 1").select(key, F.col("s").alias(f"{name}_s2"))
            found[name] = found[name].join(again, key, "left")
    df = found["v"].join(found["h"], key)
    down = F.col("v_tv") >= F.col("h_tv")
    pick = lambda c: F.when(down, F.col(f"v_{c}")).otherwise(F.col(f"h_{c}"))
    angle = _angle(pick("s"), d)
    if d_second not in (None, d):
        second = _angle(pick("s2"), d_second)
        angle = F.when((pick("n") > 1) & (F.abs(angle - second) < 1.0), (angle + second) / 2).otherwise(angle)
    return df.select(key, F.when((F.col("v_tv") < least_tv) & (F.col("h_tv") < least_tv), F.lit(None)).otherwise(angle).alias("angle"))


def sampled_regions(boxes: DataFrame, key: str, page_w: int, page_h: int, size: int = 150, most: int = 20, tries: int = 200, seed: int = 0, rank: tuple[str, ...] = ("x2", "y2")) -> DataFrame:
    """Up to `most` square regions a page, at places that a seeded hash picks in its boxes.

    Boxes with the same top left corner have the same hash; `rank` orders them. A box smaller than `size` on a side is taken whole if it is over 50 on each; regions stay on the page.
    """
    rows = boxes.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).where("w > 50 AND h > 50")
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    # MD5 of plain text, so that other engines find the same places
    digest = lambda n: F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.lit(n), *(F.col(c).cast("string") for c in (key, "x1", "y1", "attempt"))), "UTF-8"))
    hashed = lambda n, room: F.pmod(F.conv(F.substring(digest(n), 1, 12), 16, 10).cast("long"), F.greatest(F.lit(1), room)).cast("int")
    small = (F.col("w") < size) | (F.col("h") < size)
    x = F.when(small, F.col("x1")).otherwise(F.greatest(F.lit(0), F.least(F.col("x1") + hashed(0, F.col("w") - size + 1), F.lit(page_w - size))))
    y = F.when(small, F.col("y1")).otherwise(F.greatest(F.lit(0), F.least(F.col("y1") + hashed(1, F.col("h") - size + 1), F.lit(page_h - size))))
    rows = rows.where(~small | (F.col("attempt") == 1)).withColumns({"x": x, "y": y})
    order = F.row_number().over(Window.partitionBy(key).orderBy(digest(2), "x1", "y1", "attempt", *rank))
    return rows.withColumn("region", order).where(F.col("region") <= most).select(key, "region", F.col("x").alias("x1"), F.col("y").alias("y1"), F.when(small, F.col("x2")).otherwise(F.col("x") + size).alias("x2"), F.when(small, F.col("y2")).otherwise(F.col("y") + size).alias("y2"))


def robust_angle(angles: DataFrame, key: str, least: int = 5, sigmas: float = 2.0, most_std: float = 1.0) -> DataFrame:
    """(key, n, angle): median of the angles within two deviations; 0 for fewer than five, or where those still spread over a degree."""
    own = Window.partitionBy(key)
    df = angles.withColumns({"_m": F.avg("angle").over(own), "_s": F.stddev_pop("angle").over(own)})
    near = (F.col("_s") == 0) | (F.abs(F.col("angle") - F.col("_m")) <= sigmas * F.col("_s") + 1e-12)
    kept = F.when(near, F.col("angle"))
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.median(kept).alias("_median"), F.stddev_pop(kept).alias("_std"))
    return out.select(key, "n", F.when((F.col("n") < least) | (F.col("_std") > most_std), 0.0).otherwise(F.col("_median")).alias("angle"))


def median_angle(angles: DataFrame, key: str) -> DataFrame:
    """I8: (key, n, angle): plain median, for pages without regions to sample."""
    return angles.groupBy(key).agg(F.count("angle").alias("n"), F.coalesce(F.median("angle"), F.lit(0.0)).alias("angle"))


# the same for pixels of real size: NumPy behind Arrow


def correlation(gray: np.ndarray, d: int, s_range: int, horizontal: bool = False) -> np.ndarray:
    """I1, I2 for one gray image: values at the shifts -s_range..s_range."""
    lines = (gray if horizontal else gray.T).astype(np.float64)
    out = np.zeros(2 * s_range + 1)
    n = lines.shape[1]
    for i, s in enumerate(range(-s_range, s_range + 1)):
        a, b = lines[:-d, max(0, -s) : n - max(0, s)], lines[d:, max(0, s) : n + min(0, s)]
        if a.size:
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
            spread = np.sqrt((a * a).mean(axis=1)), np.sqrt((b * b).mean(axis=1))
            full = (spread[0] > 1e-10) & (spread[1] > 1e-10)
            if full.any():
                out[i] = ((a * b).sum(axis=1)[full] / (spread[0] * spread[1])[full]).mean()
    return out


def image_angle(gray: np.ndarray, d: int, s_range: int, d_second: int | None = None, least_tv: float = 10.0) -> float | None:
    """I3-I5 for one gray image."""
    signals = [correlation(gray, d, s_range, h) for h in (False, True)]
    tv = [np.abs(np.diff(x)).sum() for x in signals]
    if max(tv) < least_tv:
        return None
    pick = 0 if tv[0] >= tv[1] else 1

    def shifts(x: np.ndarray) -> list[int]:
        inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
        return [int(i) - s_range for i in sorted(inner, key=lambda i: -x[i])] or [int(np.argmax(x)) - s_range]

    tops = shifts(signals[pick])
    angle = math.degrees(math.atan(tops[0] / d))
    if len(tops) > 1 and d_second not in (None, d):
        second = math.degrees(math.atan(shifts(correlation(gray, d_second, s_range, bool(pick)))[0] / d_second))
        if abs(angle - second) < 1.0:
            angle = (angle + second) / 2
    return angle


def crop_angles(crops: DataFrame, d: int, s_range: int, d_second: int | None = None, name: str = "angle") -> DataFrame:
    """I5 for gray crops (pixels, h, w): adds the angle, null where none shows."""
    ship(crops.sparkSession)
    at = [crops.columns.index(c) for c in ("pixels", "h", "w")]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            angles = [image_angle(np.frombuffer(p, dtype=np.uint8).reshape(h, w), d, s_range, d_second) if p else None for p, h, w in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.float64())], names=[*batch.schema.names, name])

    return crops.mapInArrow(run, T.StructType([*crops.schema.fields, T.StructField(name, T.DoubleType())]))


def turned(angles: DataFrame, least: float = 0.1) -> DataFrame:
    """Pages whose angle calls for a rotation; what was derived from them is to be made again."""
    return angles.where(F.abs("angle") > least)
