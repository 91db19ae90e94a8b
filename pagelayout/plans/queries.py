"""The registered queries of the page operators, over the derived inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelayout.functions import geometry as g
from pagelayout.functions.geometry import BOX, Box
from pagelayout.functions.pages import Columns, Lists
from pagelayout.operators import blocks, decode, images, letters, lines, reflow, skew, text
from pagelayout.schema import layout_classes
from pagelayout.sources import analyser, fixtures, remote
from pagelayout.sources.fixtures import PAGE_H, PAGE_W, table
from pagelayout.sources.word_pages import word_pages

QUERIES = {}
ZOOM = 1.5


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# scalar functions of images and boxes


@query
def b1_letterbox(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.raw_predictions(spark, sf).select("page_id", "img_w", "img_h").distinct()
    return rounded(raw.withColumn("b", g.letterbox(F.col("img_w"), F.col("img_h"))).select("page_id", "img_w", "img_h", "b.*"), "scale")


@query
def b2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    # The mean and deviation of one channel of the word model's input.
    v = F.floor(F.abs(F.col("z")) * 10) % 256
    return rounded(fixtures.grid(spark, sf).select("vec_id", "r", "c", g.normalised(v).alias("unit"), g.normalised(v, 0.694, 0.298).alias("value")), "unit", "value")


@query
def b3_crop_geometry(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.detections(spark, sf)
    return d.select("page_id", "det_id", g.crop_size(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("s")).select("page_id", "det_id", "s.*")


@query
def b4_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fixtures.grid(spark, sf).select("vec_id", "r", "c", g.sigmoid(F.col("z")).alias("p"), g.sigmoid(F.col("z") * 40, 88.0).alias("clipped")), "p", "clipped")


@query
def b5_background(spark: SparkSession, sf: str) -> DataFrame:
    px = fixtures.grid(spark, sf).select(F.col("vec_id").alias("page_id"), F.col("c").alias("channel"), (F.floor(F.abs(F.col("z")) * 10) % 256).alias("value"))
    return images.background(px)


@query
def b10_ink_components(spark: SparkSession, sf: str) -> DataFrame:
    """B10 over gray crops of 8 by 8: each is dark where its map is high."""
    gray = fixtures.grid(spark, sf).select("vec_id", "r", "c", F.when(F.col("z") >= 0, 20).otherwise(200).alias("v"))
    crops = gray.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"]).alias("v"))
    crops = crops.select("vec_id", F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return images.with_components(crops).select("vec_id", F.explode("components").alias("k")).select("vec_id", "k.*")


@query
def b7_zoom_crop(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.detections(spark, sf)
    z = 1 + (F.col("det_id") % 5) * 0.5
    return d.select("page_id", "det_id", g.zoomed(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), z, F.lit(400), F.lit(10)).alias("s")).select("page_id", "det_id", "s.*")


@query
def b8_display_size(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.raw_predictions(spark, sf).select("page_id", "img_w", "img_h").distinct()
    return raw.select("page_id", g.shown(F.col("img_w"), F.col("img_h"), 900).alias("s")).select("page_id", "s.*")


@query
def b9_rotated_size(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.angles(spark, sf).select("event_id", g.rotated_size(F.lit(PAGE_W), F.lit(PAGE_H), F.round("angle", 4)).alias("s")).select("event_id", "s.*")


@query
def d1_box_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """D1-D7 over neighbours in confidence of a page."""
    d = fixtures.detections(spark, sf)
    nxt = Window.partitionBy("page_id").orderBy("det_id")
    d = d.withColumns({f"n_{c}": F.lead(c).over(nxt) for c in BOX}).where("n_x1 IS NOT NULL")
    a, b = Box(), Box("n_")
    i = a.intersection(b)
    out = d.select("page_id", "det_id", a.centre_x().alias("cx"), a.centre_y().alias("cy"), a.distance(b).alias("distance"), (a.double_y_distance(b) / 2).alias("y_distance"), a.area().alias("area"), a.intersects(b).alias("meets"), i.area().alias("shared"), *(F.when(a.intersects(b), c).alias(f"i_{n}") for n, c in zip(BOX, (i.x1, i.y1, i.x2, i.y2), strict=True)))
    return rounded(out, "distance")


@query
def d4_page_union(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.detections(spark, sf).groupBy("page_id").agg(*g.union_box())


@query
def d9_class_ids(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).groupBy("label", blocks.class_id(F.col("label")).alias("class_id")).agg(F.count("*").alias("n"))


@query
def g11_hyphen_size(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.detections(spark, sf)
    return d.select("page_id", "det_id", g.hyphen_size(F.col("y2") - F.col("y1"), F.lit(0.37)).alias("s")).select("page_id", "det_id", "s.*")


# detections


@query
def c1_best_class(spark: SparkSession, sf: str) -> DataFrame:
    k, top = decode.best_class(F.col("logits"))
    return rounded(fixtures.raw_predictions(spark, sf).select("page_id", "anchor_id", k.alias("class_id"), top.alias("logit")), "logit")


@query
def c2_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return decode.top_k(fixtures.raw_predictions(spark, sf), 20).select("page_id", "anchor_id", "class_id")


@query
def c4_decode(spark: SparkSession, sf: str) -> DataFrame:
    """C1-C8."""
    return rounded(decode.decode(fixtures.raw_predictions(spark, sf), 20), "conf")


@query
def c9_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decode.iou_pairs(fixtures.detections(spark, sf)), "iou")


@query
def c10_nms(spark: SparkSession, sf: str) -> DataFrame:
    return decode.nms(fixtures.detections(spark, sf)).select("page_id", "det_id")


@query
def nms_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """C3, C7-C10 and the class table."""
    kept = decode.nms(fixtures.detections(spark, sf))
    return kept.join(F.broadcast(layout_classes(spark)), "class_id", "left").groupBy("class_id", "label").agg(F.count("*").alias("n"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.grid(spark, sf).select(F.col("vec_id").alias("map_id"), "r", "c", g.sigmoid(F.col("z")).alias("p"))


@query
def c11_map_components(spark: SparkSession, sf: str) -> DataFrame:
    return decode.map_components(cells(spark, sf), 0.5)


@query
def c14_rect_scores(spark: SparkSession, sf: str) -> DataFrame:
    px = cells(spark, sf)
    return rounded(decode.rect_scores(decode.map_components(px, 0.5), px, 0.5), "score")


@query
def c15_unclip(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.detections(spark, sf)
    return d.select("page_id", "det_id", *decode.unclipped(Box()).aliased())


@query
def c16_undo_letterbox(spark: SparkSession, sf: str) -> DataFrame:
    return decode.unpadded(fixtures.raw_predictions(spark, sf)).select("page_id", "anchor_id", *BOX)


# blocks


@query
def d10_enclosed_rects(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.enclosed(fixtures.detections(spark, sf), ["page_id"], "det_id").select("page_id", "det_id")


@query
def e1_expand_text(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.expand_text(fixtures.labelled(spark, sf), PAGE_W, 1000).select("page_id", "det_id", *BOX)


@query
def e2_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.labelled(spark, sf).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("det_id").alias("first_id"))


@query
def e3_figure_captions(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.caption_pairs(fixtures.labelled(spark, sf), "figure")


@query
def e4_formula_captions(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.caption_pairs(fixtures.labelled(spark, sf), "isolate_formula")


@query
def e5_table_captions(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.caption_pairs(fixtures.labelled(spark, sf), "table")


@query
def e6_table_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.nearest_tables(fixtures.labelled(spark, sf))


@query
def e7_table_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(blocks.table_groups(fixtures.labelled(spark, sf)), "conf")


@query
def e8_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.labelled(spark, sf)
    pairs = blocks.caption_pairs(d, "figure")
    return blocks.leftovers(d, pairs, "figure", "target_id").unionByName(blocks.leftovers(d, pairs, "figure_caption", "caption_id")).select("page_id", "det_id", "label")


@query
def e9_merged_text(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.merged_text(fixtures.labelled(spark, sf))


def _text_and_regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = fixtures.labelled(spark, sf)
    return blocks.merged_text(d), d.where("label <> 'plain text'")


@query
def e10_cut_bands(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.merged_bands(blocks.cut_bands(*_text_and_regions(spark, sf)))


@query
def e10_text_slices(spark: SparkSession, sf: str) -> DataFrame:
    boxes, others = _text_and_regions(spark, sf)
    return blocks.text_slices(boxes, blocks.merged_bands(blocks.cut_bands(boxes, others)))


@query
def e11_passed_through(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(blocks.passed_through(fixtures.labelled(spark, sf), 11).select("page_id", "label", "conf", *BOX), "conf")


def _simple_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.labelled(spark, sf).select("page_id", F.lit(1).alias("step"), F.col("det_id").alias("seq"), F.lit(0).alias("sub"), "label", "conf", *BOX)


@query
def e12_title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.title_pairs(_simple_blocks(spark, sf)).select("page_id", F.col("title.seq").alias("title_id"), F.col("body.seq").alias("body_id"))


@query
def e13_uncovered_text(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.uncovered_text(_simple_blocks(spark, sf)).select("page_id", F.col("seq").alias("det_id"))


@query
def e14_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """E1-E14 after NMS."""
    return rounded(blocks.group_detections(decode.with_labels(decode.nms(fixtures.detections(spark, sf))), PAGE_W, PAGE_H), "conf")


# words and lines


@query
def f1_tall_words(spark: SparkSession, sf: str) -> DataFrame:
    return lines.tall_words(fixtures.word_boxes(spark, sf)).select("page_id", "word_id")


@query
def f2_line_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = lines.line_edges(lines.tall_words(fixtures.word_boxes(spark, sf)))
    return edges.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("a_id").alias("a_sum"), F.sum("b_id").alias("b_sum"))


@query
def f3_line_components(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_components(fixtures.word_boxes(spark, sf))


@query
def f4_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.text_lines(fixtures.word_boxes(spark, sf)).select("page_id", "line", "pos", "word_id")


@query
def f5_merge_close_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.group_words(fixtures.word_boxes(spark, sf)).select("page_id", "line", "pos", "word_id")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.line_sessions(fixtures.word_boxes(spark, sf))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("page_id", "line").orderBy("x1", "word_id")))


@query
def g1_line_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_sessions(fixtures.word_boxes(spark, sf)).select("page_id", "word_id", "line")


@query
def g2_clamp_words(spark: SparkSession, sf: str) -> DataFrame:
    return lines.clamp_words(fixtures.word_boxes(spark, sf)).select("page_id", "word_id", "line", "y1", "y2")


@query
def g14_paragraph_starts(spark: SparkSession, sf: str) -> DataFrame:
    return lines.paragraph_starts(sessions(spark, sf))


@query
def g17_word_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.word_gaps(sessions(spark, sf), ZOOM).select("page_id", "line", "pos", "space")


@query
def g21_robust_fit(spark: SparkSession, sf: str) -> DataFrame:
    points = sessions(spark, sf).select("page_id", "line", ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").cast("double").alias("y"), F.lit(3.0).alias("epsilon"))
    return rounded(lines.robust_fit(points, ["page_id", "line"]), "slope", "intercept")


@query
def g22_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.baselines(sessions(spark, sf)).select("page_id", "line", "word_id", "above", "bl")


def packed_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions(spark, sf)
    paras = lines.paragraph_starts(rows).select("page_id", "line", "para_start")
    cuts = F.sequence(F.lit(8), F.greatest(F.lit(8), F.col("x2") - F.col("x1")), F.lit(10))
    return rows.join(paras, ["page_id", "line"]).select("page_id", "line", "word_id", *BOX, "para_start", (F.col("word_id") % 17 == 0).alias("ends_hyphen"), cuts.alias("cuts"))


def _letters(page: Columns) -> Columns:
    """As `packed_words`, for one page's columns."""
    counts = np.maximum(0, page["x2"] - page["x1"] - 8) // 10 + 1
    ends = np.append([0], np.cumsum(counts))
    return page | {"ends_hyphen": page["word_id"] % 17 == 0, "cuts": Lists(8 + 10 * (np.arange(ends[-1]) - np.repeat(ends[:-1], counts)), ends)}


@query
def g18_pack_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.pack_pages(word_pages(spark, sf), _letters, ZOOM, 640)


def placed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as they are, for the steps after packing."""
    rows = reflow.word_gaps(sessions(spark, sf), ZOOM)
    paras = lines.paragraph_starts(rows).select("page_id", "line", "para_start")
    return rows.join(paras, ["page_id", "line"]).select("page_id", F.col("line").alias("out_line"), "pos", "word_id", *BOX, "space", F.lit(0).alias("hyphen_w"), "para_start", (F.col("y2") - F.col("y1")).alias("above"), (F.col("word_id") % 4).alias("bl"))


@query
def g19_line_heights(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.line_heights(placed_words(spark, sf), ZOOM, 5, 7)


@query
def g20_place_words(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.place_pages(word_pages(spark, sf), lambda page: page | {"above": page["y2"] - page["y1"], "bl": page["word_id"] % 4}, ZOOM, 10, PAGE_W, 10, 5)


# letters


def comps(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.components(spark, sf).withColumns({"word_w": F.lit(200), "word_h": F.lit(60)})


@query
def g3_main_components(spark: SparkSession, sf: str) -> DataFrame:
    return letters.main_components(comps(spark, sf)).select("word_key", "comp_id")


@query
def g4_valid_components(spark: SparkSession, sf: str) -> DataFrame:
    return letters.valid_components(comps(spark, sf)).select("word_key", "comp_id")


@query
def g5_diacritics(spark: SparkSession, sf: str) -> DataFrame:
    return letters.diacritics(comps(spark, sf)).select("word_key", "comp_id", "median_h", "is_mark")


@query
def g8_letter_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """G3-G9."""
    return letters.letter_boxes(comps(spark, sf)).select("word_key", "letter", "x", "y", "w", "h")


@query
def g9_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = comps(spark, sf).withColumn("median_h", F.lit(20.0))
    return letters.without_fragments(rows).select("word_key", "comp_id")


@query
def g10_padded_rects(spark: SparkSession, sf: str) -> DataFrame:
    return letters.padded(comps(spark, sf)).select("word_key", "comp_id", *BOX)


@query
def g10_letter_rects(spark: SparkSession, sf: str) -> DataFrame:
    """G3-G10 with D10."""
    return letters.letter_rects(comps(spark, sf))


def rects(spark: SparkSession, sf: str) -> DataFrame:
    return letters.padded(comps(spark, sf)).withColumnRenamed("comp_id", "letter")


@query
def g12_split_point(spark: SparkSession, sf: str) -> DataFrame:
    return letters.split_point(rects(spark, sf), F.lit(120))


@query
def g13_split_words(spark: SparkSession, sf: str) -> DataFrame:
    own = rects(spark, sf)
    words = own.groupBy("word_key").agg(F.max("word_w").alias("word_w"))
    return letters.split_words(own.drop("word_w"), words, F.lit(150), F.lit(ZOOM))


@query
def g15_hyphens(spark: SparkSession, sf: str) -> DataFrame:
    flat = comps(spark, sf).withColumn("w", F.col("w") * 3)
    return letters.hyphens(flat)


@query
def g16_without_hyphen(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.detections(spark, sf)
    zone = F.when(F.col("det_id") % 3 != 0, F.col("det_id") % 30)
    return d.select("page_id", "det_id", letters.without_hyphen(F.col("x1"), F.col("x2"), zone).alias("x2"))


# regions of a page


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Detections as regions, some of them titled blocks."""
    d = fixtures.labelled(spark, sf)
    label = F.when((F.col("label") == "title") & (F.col("det_id") % 2 == 0), "titled_block_title").when((F.col("label") == "plain text") & (F.col("det_id") % 3 == 0), "titled_block_body").otherwise(F.col("label"))
    return d.select("page_id", F.col("det_id").alias("block_id"), label.alias("label"), *BOX)


def paged_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions on every page of documents: page k of document d has those of page d + k, counted round."""
    r = regions(spark, sf).withColumnRenamed("page_id", "own_page")
    docs = table(spark, sf, "documents").select("doc_id", F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda n, x: n + 1 + F.floor(F.length(x) / 80)).alias("rows"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 60))).alias("k"))
    n = r.agg((F.max("own_page") + 1).alias("n"))
    pages = pages.crossJoin(F.broadcast(n)).select((F.col("doc_id") * 1000 + F.col("k")).alias("page_id"), ((F.col("doc_id") + F.col("k")) % F.col("n")).alias("own_page"))
    return pages.join(r, "own_page").drop("own_page")


@query
def h1_region_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """H1, H6."""
    return reflow.region_gaps(regions(spark, sf), ZOOM, PAGE_H).select("page_id", "block_id", "position", "gap_before", "gap_after")


@query
def h2_median_width(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.median_text_width(regions(spark, sf), PAGE_W)


@query
def h3_margins(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("event_id") % 7 / 2
    return table(spark, sf, "events").select("event_id", g.margins(z, F.when(F.col("event_id") % 5 == 0, 33)).alias("margin"))


@query
def h4_words_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.words_in_regions(fixtures.word_boxes(spark, sf), paged_regions(spark, sf))


@query
def h5_padded_words(spark: SparkSession, sf: str) -> DataFrame:
    r = paged_regions(spark, sf)
    return reflow.padded_words(reflow.words_in_regions(fixtures.word_boxes(spark, sf), r), r)


@query
def h7_last_placed(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.last_placed(reflow.region_gaps(regions(spark, sf), 0.2, PAGE_H), 0.2).select("page_id", "block_id", "last_label", "gap_before")


@query
def h9_narrow_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.narrow_blocks(regions(spark, sf), PAGE_W, 0.9).select("page_id", "block_id", "is_narrow")


@query
def h10_work_units(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H10."""
    return reflow.work_units(regions(spark, sf), ZOOM, PAGE_W, PAGE_H)


@query
def h11_mask_rects(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.mask_rects(regions(spark, sf))


@query
def h12_stacked_units(spark: SparkSession, sf: str) -> DataFrame:
    r = reflow.region_gaps(regions(spark, sf), ZOOM, PAGE_H).withColumnRenamed("position", "unit")
    height = F.when(F.col("block_id") % 6 != 0, F.col("y2") - F.col("y1"))
    return reflow.stacked_units(r.withColumn("height", height)).select("page_id", "unit", F.col("y").cast("long").alias("y"), F.col("page_height").cast("long").alias("page_height"))


@query
def h13_base_zoom(spark: SparkSession, sf: str) -> DataFrame:
    width = F.median(F.when(F.col("x2") > F.col("x1"), F.col("x2") - F.col("x1")))
    w = fixtures.word_boxes(spark, sf).groupBy("page_id").agg(width.alias("m"))
    return w.select("page_id", F.round(g.base_zoom(F.lit(840.0), F.col("m"), F.col("page_id") % 4 - 1), 6).alias("zoom"))


@query
def h14_font_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", g.font_scale(F.col("event_id") % 21 - 10).alias("scale"))


# skew


@query
def i1_vertical_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.cross_correlation(fixtures.grid(spark, sf), "vec_id", 2, 2), "value")


@query
def i2_horizontal_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.cross_correlation(fixtures.grid(spark, sf), "vec_id", 2, 2, True), "value")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.grid(spark, sf).select("vec_id", (F.col("r") * 8 + F.col("c")).alias("s"), F.col("z").alias("value"))


@query
def i3_total_variation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.total_variation(signal(spark, sf), "vec_id"), "tv")


@query
def i4_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.peaks(signal(spark, sf), "vec_id"), "value")


@query
def i5_region_angles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.region_angles(fixtures.grid(spark, sf), "vec_id", 2, 2, 3), "angle")


@query
def i6_sampled_regions(spark: SparkSession, sf: str) -> DataFrame:
    return skew.sampled_regions(fixtures.labelled(spark, sf).where("label = 'plain text'"), "page_id", PAGE_W, PAGE_H, rank=("det_id",))


@query
def i7_robust_angle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.robust_angle(fixtures.angles(spark, sf), "region_set", most_std=0.9), "angle")


@query
def i8_median_angle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.median_angle(fixtures.angles(spark, sf), "region_set"), "angle")


@query
def i9_turned(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(skew.turned(skew.robust_angle(fixtures.angles(spark, sf), "region_set", most_std=0.9)), "angle")


# recognised text


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.grid(spark, sf).groupBy("vec_id", F.col("r").alias("t")).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "z"))), lambda x: x["z"]).alias("logits"))


@query
def j1_ctc_last_blank(spark: SparkSession, sf: str) -> DataFrame:
    return text.ctc_greedy(steps(spark, sf), "vec_id", list("abcdefg"), 7)


@query
def j2_ctc_first_blank(spark: SparkSession, sf: str) -> DataFrame:
    return text.ctc_greedy(steps(spark, sf), "vec_id", ["", *"abcdef", " "], 0)


def books(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("book"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page_no"), "doc_id", "text")


@query
def j3_sample_pages(spark: SparkSession, sf: str) -> DataFrame:
    return text.sample_pages(books(spark, sf)).select("book", "page_no")


@query
def j4_sample_words(spark: SparkSession, sf: str) -> DataFrame:
    return text.sample_words(fixtures.word_boxes(spark, sf)).select("page_id", "word_id")


@query
def j5_clamped_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Crops within a page of 600 by 900; empty ones go."""
    d = fixtures.detections(spark, sf)
    moved = d.select("page_id", "det_id", (F.col("x1") - 20).alias("x1"), (F.col("y1") - 20).alias("y1"), "x2", "y2")
    return text.clamped_crops(moved, 600, 900)


@query
def j6_joined_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    return text.joined(parts, "doc_id", "ln")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "text")


@query
def j7_language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return text.language_profiles(corpus(spark, sf))


@query
def j7_classified(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return text.classify(docs, text.language_profiles(docs))


@query
def j8_confidence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (-F.col("value") * 7).alias("score"), F.element_at(F.array(*(F.lit(c) for c in ("en", "no", "xx", "fr"))), (F.col("event_id") % 4 + 1).cast("int")).alias("iso"))
    return text.offered(e.select("event_id", "iso", F.round(text.confidence(F.col("score")), 6).alias("confidence"))).select("event_id", "app_lang", "confidence")


# sources


@query
def a1_render_size(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A2."""
    own = F.when(F.col("page_id") % 2 == 0, 72).otherwise(300)
    raw = fixtures.raw_predictions(spark, sf).select("page_id", "img_w", "img_h").distinct()
    return raw.select("page_id", analyser.render_size(F.col("img_w"), F.col("img_h"), 150, own).alias("s")).select("page_id", "s.*")


@query
def a3_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("doc"), F.col("page_id"), F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".djvu", ".djv", ".txt", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    files = table(spark, sf, "pages").select("page_id", path.alias("path"), (F.col("page_id") % 4).alias("n_pages"))
    rows = analyser.page_rows(files.where(analyser.can_open(F.col("path"))))
    return rows.select("page_id", analyser.document_kind(F.col("path")).alias("kind"), "page_no")


SERVER = "http://localhost:8000/"


@query
def a4_page_address(spark: SparkSession, sf: str) -> DataFrame:
    """A4, A5."""
    n = F.col("page_id")
    lang = F.element_at(F.array(F.lit("en"), F.lit("zh-Hans"), F.lit(""), F.lit(None)), (n % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", remote.page_address(SERVER, 1000 + n % 3 * 500, F.lit("2.5"), lang, n % 2 == 0, F.lit("layoutlm")).alias("url"))


@query
def a6_multipart(spark: SparkSession, sf: str) -> DataFrame:
    """The body around a page's bytes, by its hash and size."""
    name = F.concat(F.lit("p"), F.col("page_id"), F.element_at(F.array(*(F.lit(x) for x in (".JPG", ".jpeg", ".png", ""))), (F.col("page_id") % 4 + 1).cast("int")))
    body = remote.multipart(F.encode("html", "UTF-8"), name)
    return table(spark, sf, "pages").select("page_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size"))


@query
def a7_ocr_address(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("k"), F.col("page_id")))
    return table(spark, sf, "pages").select("page_id", remote.ocr_address(SERVER, F.col("page_id") % 2 == 1, key).alias("url"))


@query
def a8_stream_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets of answers, some without a token, with an empty one, or broken."""
    n = F.col("event_id")
    url = F.when(n % 5 != 0, F.concat(F.lit("/stream/"), n))
    token = F.when(n % 7 == 0, "").when(n % 11 != 0, F.concat(F.lit("t"), n))
    body = F.when(n % 13 == 0, "{").otherwise(F.to_json(F.struct(url.alias("stream_url"), token.alias("token"))))
    return remote.stream_tickets(table(spark, sf, "events").select("event_id", body.alias("answer"))).drop("answer")


@query
def a6_content_type(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("p.x"), F.element_at(F.array(*(F.lit(x) for x in (".JPG", ".jpeg", ".png", ""))), (F.col("page_id") % 4 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", analyser.content_type(name).alias("content_type"))


@query
def a9_health(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("event_id") % 10 == 0, "down").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", analyser.healthy(body, "k", "3").alias("healthy"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as JSON; some without skew_angle, half with the page's own word list."""
    d = fixtures.labelled(spark, sf)
    word = F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip(BOX, ("xmin", "ymin", "xmax", "ymax"), strict=True)))
    block = F.struct("det_id", F.array(*(F.col(c).cast("double") + 0.7 for c in BOX)).alias("bbox"), F.when(F.col("det_id") % 5 == 0, "sidebar").otherwise(F.col("label")).alias("block_type"), F.array(F.struct(F.array(word, word).alias("words"))).alias("lines"))
    page = d.groupBy("page_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    boxes = F.transform("b", lambda x: x["bbox"])
    body = F.to_json(
        F.struct(
            F.lit(PAGE_W).alias("image_width"), F.lit(PAGE_H).alias("image_height"), F.array(*[F.lit(250)] * 3).alias("background_color"), F.when(F.col("page_id") % 7 != 0, 0.5).alias("skew_angle"), F.lit(False).alias("is_toc"), F.lit(40).alias("left_margin"), F.lit(40).alias("right_margin"),
            F.transform("b", lambda x: F.struct(x["bbox"].alias("bbox"), x["block_type"].alias("block_type"), x["lines"].alias("lines"))).alias("blocks"), F.when(F.col("page_id") % 2 == 0, boxes).alias("word_boxes"),
        )
    )
    return analyser.parse_answers(page.select("page_id", body.alias("body")))


@query
def a10_answered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return analyser.answered_blocks(answers(spark, sf))


@query
def a10_answered_words(spark: SparkSession, sf: str) -> DataFrame:
    return analyser.answered_words(answers(spark, sf))


@query
def a12_manifest_gaps(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.col("url").alias("name"), F.length("html").cast("long").alias("size"), "page_id")
    one = files.groupBy("name").agg(F.max("size").alias("size"), F.max("page_id").alias("page_id"))
    actual = one.where("page_id % 3 <> 0").select("name", (F.col("size") + F.when(F.col("page_id") % 4 == 0, 1).otherwise(0)).alias("size"))
    return analyser.manifest_gaps(one.select("name", "size"), actual)


@query
def a13_saved_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    values = F.struct(F.col("user_id").alias("page"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("lang"))
    return e.select("event_id", analyser.settings_text(values).alias("text"))


@query
def a13_settings(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", analyser.settings(body, "k int")["k"].alias("k"))
