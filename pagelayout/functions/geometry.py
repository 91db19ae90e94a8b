"""Column functions over boxes and images. Boxes are the columns x1, y1, x2, y2 with an optional prefix or suffix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


class Box:
    """Four columns; `Box("a_")` reads a_x1, a_y1, ..."""

    def __init__(self, prefix: str = "", columns: tuple[Column, ...] | None = None):
        self.x1, self.y1, self.x2, self.y2 = columns or tuple(F.col(prefix + c) for c in BOX)

    @staticmethod
    def of(struct: Column) -> Box:
        return Box(columns=tuple(struct[c] for c in BOX))

    def aliased(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip((self.x1, self.y1, self.x2, self.y2), BOX, strict=True)]

    # D1
    def centre_x(self) -> Column:
        return (self.x1 + self.x2) / 2

    def centre_y(self) -> Column:
        return (self.y1 + self.y2) / 2

    # D5
    def area(self) -> Column:
        return F.greatest(F.lit(0), self.x2 - self.x1).cast("long") * F.greatest(F.lit(0), self.y2 - self.y1)

    # D2, squared and of doubled coordinates: an exact integer in the order of the distance
    def square_distance(self, other: Box) -> Column:
        dx = (self.x1 + self.x2 - other.x1 - other.x2).cast("long")
        dy = (self.y1 + self.y2 - other.y1 - other.y2).cast("long")
        return dx * dx + dy * dy

    def distance(self, other: Box) -> Column:
        return F.sqrt(self.square_distance(other).cast("double")) / 2

    # D3, doubled
    def double_y_distance(self, other: Box) -> Column:
        return F.abs(self.y1 + self.y2 - other.y1 - other.y2)

    # D6
    def intersects(self, other: Box) -> Column:
        return (self.x1 < other.x2) & (other.x1 < self.x2) & (self.y1 < other.y2) & (other.y1 < self.y2)

    # D7
    def intersection(self, other: Box) -> Box:
        return Box(columns=(F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1), F.least(self.x2, other.x2), F.least(self.y2, other.y2)))

    # C9
    def iou(self, other: Box) -> Column:
        inter = self.intersection(other).area()
        return F.when(inter == 0, F.lit(0.0)).otherwise(inter / (self.area() + other.area() - inter))


def union_box() -> list[Column]:
    """Aggregates that give the union box of a group."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def truncated(x: Column) -> Column:
    """To int, toward zero."""
    return x.cast("int")


def letterbox(w: Column, h: Column, target: int = 1024) -> Column:
    """B1: scale, new size (half to even) and padding of an image put in a square."""
    scale = F.lit(target) / F.greatest(w, h)
    new_w, new_h = F.rint(w * scale).cast("int"), F.rint(h * scale).cast("int")
    pad = lambda n: F.floor((F.lit(target) - n) / 2).cast("int")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), pad(new_w).alias("pad_left"), pad(new_h).alias("pad_top"))


def sigmoid(x: Column, limit: float | None = None) -> Column:
    """B4; `limit` clips the argument."""
    if limit is not None:
        x = F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    return 1 / (1 + F.exp(-x))


def normalised(x: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """B2: a byte to the unit interval, then centred and scaled."""
    return (x / 255 - mean) / std


def crop_size(w: Column, h: Column, height: int = 48, width: int = 320) -> Column:
    """Width of a crop scaled to `height`, what of it is kept, and the padding on its right."""
    new_w = F.greatest(F.lit(1), truncated(w * height / F.greatest(h, F.lit(1))))
    return F.struct(new_w.alias("new_w"), F.least(new_w, F.lit(width)).alias("kept_w"), F.greatest(F.lit(0), F.lit(width) - new_w).alias("pad_right"))


def zoomed(w: Column, h: Column, zoom: Column, page_w: Column, margin: Column) -> Column:
    """Size and offset of a crop zoomed into the width between margins."""
    available = page_w - 2 * margin
    zw, zh = truncated(w * zoom), truncated(h * zoom)
    over = zw > available
    out_h = F.greatest(F.lit(1), F.when(over, truncated(zh * (available / zw))).otherwise(zh))
    out_w = F.greatest(F.lit(1), F.when(over, available).otherwise(zw))
    x = margin + F.floor((available - out_w) / 2).cast("int")
    return F.struct(out_w.alias("w"), out_h.alias("h"), F.greatest(F.lit(0), F.least(x, page_w - out_w)).alias("x_off"))


def shown(w: Column, h: Column, container: int) -> Column:
    """Size of an image fitted to a container's width, never enlarged."""
    new_w = F.least(F.lit(container), w)
    return F.struct(new_w.alias("w"), truncated(new_w * h / w).alias("h"))


def rotated_size(w: Column, h: Column, degrees: Column) -> Column:
    """Canvas of an image rotated; below a tenth of a degree nothing changes."""
    turn = degrees * (math.pi / 180)
    c, s = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    still = F.abs(degrees) < 0.1
    return F.struct(F.when(still, w).otherwise(truncated(h * s + w * c)).alias("w"), F.when(still, h).otherwise(truncated(h * c + w * s)).alias("h"))


def hyphen_size(height: Column, zoom: Column) -> Column:
    """Size of a hyphen drawn for a word, and of its stroke."""
    img_h = F.greatest(F.lit(4), truncated(height * zoom))
    stroke_h = F.greatest(F.lit(2), F.rint(img_h * 0.07).cast("int"))
    stroke_w = F.greatest(F.lit(4), F.rint(img_h * 0.35).cast("int"))
    return F.struct(img_h.alias("h"), (stroke_w + 4).alias("w"), stroke_h.alias("stroke_h"), stroke_w.alias("stroke_w"))


def word_gap(gap: Column, zoom: Column, average: Column) -> Column:
    """Space before a word after a gap of `gap` pixels; overlaps of more than ten get the average."""
    near = F.greatest(F.lit(1), F.floor((gap + 10) * zoom / 2).cast("int"))
    return F.when(gap > 0, truncated(gap * zoom)).when(gap >= -10, near).otherwise(average)


def base_zoom(available: Column, median_width: Column, step: Column) -> Column:
    """Zoom that fits about four median words, a fifth more a step."""
    return F.greatest(F.lit(0.1), available / (F.coalesce(median_width, F.lit(50.0)) * 4)) * F.pow(F.lit(1.2), step)


def font_scale(step: Column) -> Column:
    """H14."""
    return F.greatest(F.lit(0.5), F.round(1 + 0.1 * step, 2))


def margins(zoom: Column, forced: Column | None = None) -> Column:
    """H3: the page's margin, unless one is forced."""
    own = F.greatest(F.lit(10), truncated(20 * zoom / 2))
    return own if forced is None else F.coalesce(forced, own)
