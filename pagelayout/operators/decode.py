"""From model outputs to detections: layout anchors (C1-C10) and word maps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelayout.functions.geometry import Box, letterbox, sigmoid, truncated
from pagelayout.functions.pages import folded, per_page_arrays
from pagelayout.operators.images import cell_labels
from pagelayout.schema import CLASSES

TOP_K, LEAST_CONF, MAX_IOU = 300, 0.51, 0.45


def best_class(logits: Column) -> tuple[Column, Column]:
    """(class id, logit) of the first greatest logit."""
    top = F.array_max(logits)
    return (F.array_position(logits, top) - 1).cast("int"), top


def with_labels(df: DataFrame) -> DataFrame:
    """The class's label; an id without one is its own label."""
    names = F.create_map(*[x for i, (label, _) in enumerate(CLASSES) for x in (F.lit(i), F.lit(label))])
    return df.withColumn("label", F.coalesce(F.element_at(names, F.col("class_id")), F.col("class_id").cast("string")))


def unpadded(df: DataFrame, target: int = 1024) -> DataFrame:
    """Boxes bx1..by2 of the letterboxed image as x1..y2 in the image, clamped; empty ones go."""
    box = letterbox(F.col("img_w"), F.col("img_h"), target)
    df = df.withColumn("_lb", box)

    def back(c: str, pad: str, size: str) -> Column:
        return F.greatest(F.lit(0), F.least(truncated((F.col(c) - F.col("_lb")[pad]) / F.col("_lb")["scale"]), F.col(size) - 1))

    df = df.withColumns({"x1": back("bx1", "pad_left", "img_w"), "y1": back("by1", "pad_top", "img_h"), "x2": back("bx2", "pad_left", "img_w"), "y2": back("by2", "pad_top", "img_h")})
    return df.where("x2 > x1 AND y2 > y1").drop("_lb")


def top_k(raw: DataFrame, k: int = TOP_K) -> DataFrame:
    """class_id and logit, and the k best anchors of each page; ties go to the lower anchor."""
    class_id, logit = best_class(F.col("logits"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("logit"), "anchor_id"))
    return raw.withColumns({"class_id": class_id, "logit": logit}).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def decode(raw: DataFrame, k: int = TOP_K, least: float = LEAST_CONF) -> DataFrame:
    """Detections of each page by falling confidence; det_id is the rank."""
    # the sigmoid is monotone: the threshold is taken on logits
    kept = top_k(raw, k).where(F.col("logit") >= math.log(least / (1 - least)))
    boxes = unpadded(kept).withColumn("conf", sigmoid(F.col("logit")))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("logit"), "anchor_id"))
    return with_labels(boxes).select("page_id", rank.alias("det_id"), "label", "class_id", "conf", "x1", "y1", "x2", "y2")


def iou_pairs(dets: DataFrame, above: float = MAX_IOU) -> DataFrame:
    """Pairs of one page and class whose IoU is over `above`."""
    a, b = dets.select("page_id", "class_id", F.col("det_id").alias("a_id"), *Box().aliased("a_")), dets.select("page_id", "class_id", F.col("det_id").alias("b_id"), *Box().aliased("b_"))
    one, two = Box("a_"), Box("b_")
    pairs = a.join(b, ["page_id", "class_id"]).where((F.col("a_id") < F.col("b_id")) & one.intersects(two))
    return pairs.select("page_id", "class_id", "a_id", "b_id", one.iou(two).alias("iou")).where(F.col("iou") > above)


def nms(dets: DataFrame, max_iou: float = MAX_IOU) -> DataFrame:
    """Greedy non-maximum suppression by class: only what is kept suppresses, where IoU is over `max_iou`.

    A page's boxes are folded in det_id order (falling confidence). Other columns stay.
    """
    columns = [c for c in dets.columns if c not in ("page_id", "det_id")]
    kinds = dict(dets.dtypes)
    zero = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in ("det_id", *columns)) + ">>")

    def step(kept: Column, d: Column) -> Column:
        beaten = F.exists(kept, lambda k: (k["class_id"] == d["class_id"]) & Box.of(k).intersects(Box.of(d)) & (Box.of(k).iou(Box.of(d)) > max_iou))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(d)))

    return folded(dets.select("page_id", "det_id", *columns), ["page_id"], ["det_id"], zero, step, "kept").select("page_id", F.inline("kept"))


# Word maps as cells (map_id, r, c, p)


def outer_components(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(r1, c1, r2, c2, n_cells) of the 8-connected components of cells that no other one encloses.

    What lies outside reaches the frame by steps along the axes; a component is
    enclosed where it doesn't touch that.
    """
    if not len(r):
        return tuple(np.zeros(0, dtype=np.int32) for _ in range(5))
    top, left = r.min() - 1, c.min() - 1
    on = np.zeros((r.max() - top + 2, c.max() - left + 2), dtype=bool)
    on[r - top, c - left] = True
    free = cell_labels(~on, False)
    outside = ~on & (free == free[0, 0])
    label = cell_labels(on, True)
    touches = np.zeros_like(on)
    touches[1:-1, 1:-1] = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
    rows, cols = np.nonzero(on & np.isin(label, np.unique(label[on & touches])))
    own, at = np.unique(label[rows, cols], return_inverse=True)
    low, high = np.full((2, len(own)), on.size), np.full((2, len(own)), -1)
    for i, x in enumerate((rows + top, cols + left)):
        np.minimum.at(low[i], at, x)
        np.maximum.at(high[i], at, x)
    return (*low, *high, np.bincount(at, minlength=len(own)))


def map_components(cells: DataFrame, least: float = 0.1) -> DataFrame:
    """Bounding rectangles (r1..c2 inclusive) of the 8-connected cells of p >= least.

    Only outer components count: what lies in another's hole goes. So do rectangles
    whose corners differ by less than two in either axis. A map is a grid of bounded
    size, its cells numbered by row and column.
    """

    def work(page: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        found = outer_components(page["r"], page["c"])
        large = (found[2] - found[0] >= 2) & (found[3] - found[1] >= 2)
        return tuple(x[large] for x in found)

    return per_page_arrays(cells.where(F.col("p") >= least).select("map_id", "r", "c"), ["map_id"], ["r", "c"], work, "r1 int, c1 int, r2 int, c2 int, n_cells int")


def rect_scores(rects: DataFrame, cells: DataFrame, least: float = 0.1) -> DataFrame:
    """C14: mean probability within each rectangle, kept from `least` on."""
    inside = (F.col("r") >= F.col("r1")) & (F.col("r") <= F.col("r2")) & (F.col("c") >= F.col("c1")) & (F.col("c") <= F.col("c2"))
    return rects.join(cells.select("map_id", "r", "c", "p"), "map_id").where(inside).groupBy("map_id", "r1", "c1", "r2", "c2").agg(F.avg("p").alias("score")).where(F.col("score") >= least)


def unclipped(box: Box, ratio: float = 1.0, size: int = 1024) -> Box:
    """A rectangle grown by area * ratio / perimeter on every side, clamped to the map."""
    w, h = box.x2 - box.x1, box.y2 - box.y1
    around = 2 * (w + h)
    d = F.when(around == 0, 0).otherwise(truncated(w * h * ratio / around))
    low, high = lambda x: F.greatest(F.lit(0), x - d), lambda x: F.least(F.lit(size), x + d)
    return Box(columns=(low(box.x1), low(box.y1), high(box.x2), high(box.y2)))
