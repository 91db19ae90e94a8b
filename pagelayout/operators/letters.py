"""Letters within words, from connected components.

Components: word_key, comp_id (their order within the word), x, y, w, h, area in a
word of word_w by word_h. Steps that depend on order are folds over one word's few
components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "word_key"
PAD = 2


def main_components(comps: DataFrame) -> DataFrame:
    """Components of 0.3 word heights or more; specks (under 2 by 2, or of area under 4) go."""
    return comps.where("w >= 2 AND h >= 2 AND area >= 4 AND h >= word_h * 0.3D")


def valid_components(comps: DataFrame) -> DataFrame:
    """Main components and small ones near one; in words with neither, all of 2 by 2 or more."""
    sized = comps.where("w >= 2 AND h >= 2 AND area >= 4").withColumn("is_main", F.expr("h >= word_h * 0.3D"))
    main = sized.where("is_main").select(F.col(KEY).alias("_key"), *(F.col(c).alias(f"m_{c}") for c in "xywh"))
    tall = (F.col("y") < F.col("m_y") + F.col("m_h") + F.col("word_h") * 0.4) & (F.col("y") + F.col("h") > F.col("m_y") - F.col("word_h") * 0.4)
    gap = F.greatest(F.lit(0), F.col("x") - (F.col("m_x") + F.col("m_w")), F.col("m_x") - (F.col("x") + F.col("w")))
    near = sized.where("NOT is_main").join(main, (F.col(KEY) == F.col("_key")) & tall & (gap < F.col("word_w") * 0.3), "left_semi")
    found = sized.where("is_main").unionByName(near).drop("is_main")
    bare = comps.where("w >= 2 AND h >= 2").join(found.select(F.col(KEY).alias("_key")).distinct(), F.col(KEY) == F.col("_key"), "left_anti")
    return found.unionByName(bare)


def diacritics(valid: DataFrame) -> DataFrame:
    """`median_h` of a word's components, and whether each is a mark over or under a letter."""
    med = F.median("h").over(Window.partitionBy(KEY))
    small = "h < median_h * 0.4D AND w < median_h * 0.8D AND w * h < median_h * median_h * 0.3D AND h < word_h * 0.25D AND w < word_w * 0.5D"
    return valid.withColumn("median_h", med).withColumn("is_mark", F.expr(small))


#: A component, or what was joined of some.
_LETTER = "struct<id:int,x:int,y:int,w:int,h:int>"


def _around(boxes: Column, number: Column) -> Column:
    """The box around some, under the given number."""
    least = lambda f: F.array_min(F.transform(boxes, f))
    x, y = least(lambda b: b["x"]), least(lambda b: b["y"])
    right, low = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.struct(number.alias("id"), x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))


def _alike(a: Column, b: Column, m: Column) -> Column:
    """Close side by side, at one height and of like height: strokes of one letter."""
    gap = F.greatest(F.lit(0), a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"]))
    shared, low = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.least(a["h"], b["h"])
    return (gap < m * 0.3) & (shared > low * 0.5) & (F.greatest(a["h"], b["h"]) / F.greatest(low, F.lit(1)) < 1.5)


def _over(mark: Column, letter: Column, m: Column) -> Column:
    """A mark that belongs to a letter: above or within it, and about its middle."""
    beside = F.least(mark["x"] + mark["w"], letter["x"] + letter["w"]) > F.greatest(mark["x"], letter["x"])
    middle = F.abs(mark["x"] + mark["w"] / 2 - (letter["x"] + letter["w"] / 2)) < letter["w"] * 0.5
    return beside & middle & (letter["y"] - (mark["y"] + mark["h"]) < m) & (mark["y"] + mark["h"] <= letter["y"] + letter["h"])


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _ids(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: b["id"])


def _strokes_joined(letters: Column, m: Column) -> Column:
    """(seeds, taken): each letter that none before took in, with all it takes in, by its own box alone."""
    zero = F.struct(_empty(_LETTER).alias("seeds"), _empty("int").alias("taken"))

    def step(acc: Column, a: Column) -> Column:
        own = F.filter(letters, lambda b: (b["id"] != a["id"]) & ~F.array_contains(acc["taken"], b["id"]) & _alike(a, b, m))
        group = F.concat(F.array(a), own)
        grown = F.struct(F.concat(acc["seeds"], F.array(_around(group, a["id"]))).alias("seeds"), F.concat(acc["taken"], _ids(group)).alias("taken"))
        return F.when(F.array_contains(acc["taken"], a["id"]), acc).otherwise(grown)

    return F.aggregate(letters, zero, step, lambda acc: acc["seeds"])


def _marks_joined(marks: Column, seeds: Column, m: Column) -> Column:
    """(made, used): each mark with the letters under it that no mark has yet, and the numbers that went into it."""
    zero = F.struct(_empty(_LETTER).alias("made"), _empty("int").alias("used"))

    def step(acc: Column, a: Column) -> Column:
        hits = F.filter(seeds, lambda b: ~F.array_contains(acc["used"], b["id"]) & _over(a, b, m))
        group = F.concat(F.array(a), hits)
        grown = F.struct(F.concat(acc["made"], F.array(_around(group, a["id"]))).alias("made"), F.concat(acc["used"], _ids(group)).alias("used"))
        return F.when(F.size(hits) == 0, acc).otherwise(grown)

    return F.aggregate(marks, zero, step)


def joined_letters(marked: DataFrame) -> DataFrame:
    """(word_key, letter, x, y, w, h): a word's letters, marks included, from `diacritics`.

    A letter takes in later or earlier neighbours that look like its own strokes,
    measured against its first box; a mark joins the letters under it that no mark
    has yet; what was taken in on the way comes back as it was. Words are folded one
    by one, by expressions over the array of their components.
    """
    box = F.struct(F.col("comp_id").cast("int").alias("id"), *(F.col(c).cast("int").alias(c) for c in "xywh"), "is_mark")
    words = marked.groupBy(KEY).agg(F.sort_array(F.collect_list(box)).alias("_all"), F.first("median_h").alias("_m"))
    part = lambda keep: F.transform(F.filter("_all", keep), lambda b: F.struct(*(b[c].alias(c) for c in ("id", *"xywh"))))
    words = words.select(KEY, "_m", part(lambda b: F.lit(True)).alias("_boxes"), part(lambda b: ~b["is_mark"]).alias("_letters"), part(lambda b: b["is_mark"]).alias("_marks"))
    words = words.withColumn("_seeds", _strokes_joined(F.col("_letters"), F.col("_m")))
    words = words.withColumn("_joined", _marks_joined(F.col("_marks"), F.col("_seeds"), F.col("_m")))
    free = F.filter("_seeds", lambda b: ~F.array_contains(F.col("_joined")["used"], b["id"]))
    rest = F.filter("_boxes", lambda b: ~F.array_contains(F.concat(F.col("_joined")["used"], _ids(F.col("_seeds"))), b["id"]))
    out = words.select(KEY, F.posexplode(F.concat(F.col("_joined")["made"], free, rest)).alias("letter", "_b"))
    return out.select(KEY, "letter", *(F.col("_b")[c].alias(c) for c in "xywh"))


def letter_boxes(comps: DataFrame) -> DataFrame:
    """(word_key, letter, x, y, w, h, median_h, word_w, word_h): letters of each word, fragments gone."""
    marked = diacritics(valid_components(comps))
    size = marked.groupBy(KEY).agg(F.first("median_h").alias("median_h"), F.first("word_w").alias("word_w"), F.first("word_h").alias("word_h"))
    return without_fragments(joined_letters(marked).join(size, KEY))


def without_fragments(letters: DataFrame) -> DataFrame:
    """In words of three letters or more, those under a quarter of the median area and half the median height go, if two stay."""
    own = Window.partitionBy(KEY)
    area = F.col("w") * F.col("h")
    df = letters.withColumns({"_n": F.count("*").over(own), "_a": F.median(area).over(own)})
    df = df.withColumn("_big", (area >= F.col("_a") * 0.25) | (F.col("h") >= F.col("median_h") * 0.5))
    df = df.withColumn("_stay", F.sum(F.col("_big").cast("int")).over(own))
    return df.where((F.col("_n") <= 2) | (F.col("_stay") < 2) | F.col("_big")).drop("_n", "_a", "_big", "_stay")


def padded(letters: DataFrame, pad: int = PAD) -> DataFrame:
    """x1..y2 with two pixels around, within the word."""
    x, y = F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad)
    return letters.withColumns({"x1": x, "y1": y, "x2": x + F.least(F.col("w") + 2 * pad, F.col("word_w") - x), "y2": y + F.least(F.col("h") + 2 * pad, F.col("word_h") - y)})


def letter_rects(comps: DataFrame) -> DataFrame:
    """G3-G10 with D10: rectangles of the letters of each word, enclosed ones gone."""
    from pagelayout.operators.blocks import enclosed

    return enclosed(padded(letter_boxes(comps)).select(KEY, "letter", "x1", "y1", "x2", "y2"), [KEY], "letter")


def split_point(rects: DataFrame, target: Column, pad: int = PAD) -> DataFrame:
    """(word_key, cut): the right ink edge of the last letter, by x1, whose edge is within `target`; null if none."""
    ink = F.col("x2") - pad
    return rects.groupBy(KEY).agg(F.max_by(F.when(ink <= target, ink), F.when(ink <= target, F.struct("x1", "letter"))).alias("cut"))


def split_words(rects: DataFrame, words: DataFrame, remaining: Column, zoom: Column) -> DataFrame:
    """Words (word_key, word_w) with `cut`, where to split them so that the left part fits; null where not to.

    Not without room, with fewer than two letters, or with a left part under 10
    pixels or 15 % of the word.
    """
    target = (remaining / zoom).cast("int")
    counted = rects.join(words, KEY).withColumns({"_t": target, "_n": F.count("*").over(Window.partitionBy(KEY))}).where((F.col("_n") >= 2) & (remaining > 0))
    cuts = split_point(counted, F.col("_t"))
    cut = F.least(F.col("cut"), F.col("word_w") - 1)
    fits = (F.col("cut") > 0) & (cut >= F.greatest(F.lit(10), (F.col("word_w") * 0.15).cast("int")))
    return words.join(cuts, KEY, "left").withColumn("cut", F.when(fits, cut))


def hyphens(comps: DataFrame) -> DataFrame:
    """(word_key, x): the rightmost component of the hyphen zone that is a flat stroke.

    Components lie in the zone (right quarter, middle third of the word) and are
    measured from its corner.
    """
    zone = F.col("word_h") - 2 * F.floor(F.col("word_h") / 3)
    flat = (F.col("h") >= 3) & (F.col("w") >= F.greatest(F.lit(2), (F.col("word_w") * 0.06).cast("int"))) & (F.col("h") <= zone * 0.6) & (F.col("h") <= F.col("word_h") * 0.30) & (F.col("w") / F.col("h") >= 2.0)
    return comps.where(flat).groupBy(KEY).agg(F.max("x").alias("x"))


def without_hyphen(x1: Column, x2: Column, zone_x: Column) -> Column:
    """The right edge of a word whose hyphen begins at `zone_x` of the zone; unchanged for null."""
    w = x2 - x1
    start = F.greatest(F.lit(0), w - F.floor(w / 4).cast("int"))
    return F.when(zone_x.isNull(), x2).otherwise(F.greatest(x1 + 1, x1 + start + zone_x - 2))
