from pyspark.sql import functions as F

from pagelayout.operators import blocks, decode
from pagelayout.sources import fixtures


def dets(spark, rows):
    """(label, x1, y1, x2, y2) on page 1, most confident first."""
    data = [(1, n, r[0], 1 - n / 100, *r[1:]) for n, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, "page_id long, det_id int, label string, conf double, x1 int, y1 int, x2 int, y2 int")


def result(df):
    return [(r.label, r.x1, r.y1, r.x2, r.y2) for r in df.orderBy("block_id").collect()]


def test_captions_take_turns(spark):
    rows = [("figure", 0, 0, 10, 10), ("figure_caption", 0, 12, 10, 20), ("figure_caption", 0, 14, 10, 22), ("figure", 0, 100, 10, 110)]
    pairs = blocks.caption_pairs(dets(spark, rows), "figure").collect()
    assert sorted((r.caption_id, r.target_id) for r in pairs) == [(2, 1), (3, 4)]


def test_equally_near_targets_go_by_rank(spark):
    rows = [("table", 0, 0, 10, 10), ("table", 40, 0, 50, 10), ("table_caption", 20, 0, 30, 10), ("table_footnote", 20, 0, 30, 10)]
    assert blocks.caption_pairs(dets(spark, rows), "table").first().target_id == 1
    assert blocks.nearest_tables(dets(spark, rows)).first().table_id == 1
    assert blocks.table_groups(dets(spark, rows)).orderBy("table_id").first().members == 3


def test_texts_that_cover_each_other_both_go(spark):
    rows = [("plain text", 0, 0, 100, 20), ("plain text", 0, 1, 100, 21)]
    simple = dets(spark, rows).select("page_id", F.lit(1).alias("step"), F.col("det_id").alias("seq"), F.lit(0).alias("sub"), "label", "conf", "x1", "y1", "x2", "y2")
    assert blocks.uncovered_text(simple).count() == 0


def test_of_equal_rects_the_last_stays(spark):
    rows = [("title", 0, 0, 10, 10), ("title", 0, 0, 10, 10), ("title", 2, 2, 5, 5), ("title", 20, 0, 30, 10)]
    assert sorted(r.det_id for r in blocks.enclosed(dets(spark, rows), ["page_id"], "det_id").collect()) == [2, 4]


def test_bands_that_touch_are_one(spark):
    bands = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 10, 20), (1, 1, 21, 30)], "page_id long, seq int, top int, bottom int")
    assert sorted((r.top, r.bottom) for r in blocks.merged_bands(bands).collect()) == [(0, 20), (21, 30)]


def test_slices_need_twenty_pixels(spark):
    # bands of 9 don't cut; the piece of 19 goes
    rows = [("plain text", 5, 5, 95, 195), ("figure", 0, 60, 100, 100), ("abandon", 0, 119, 100, 140)]
    assert result(blocks.group_detections(dets(spark, rows), 200, 300))[1:3] == [("plain text", 0, 0, 100, 60), ("plain text", 0, 140, 100, 200)]


def test_title_gap_edges(spark):
    for gap, label in ((0, "titled_block_title"), (50, "titled_block_title"), (51, "title"), (-1, "title")):
        rows = [("title", 0, 0, 100, 20), ("plain text", 5, 25 + gap, 95, 95 + gap)]
        simple = dets(spark, rows).select("page_id", F.lit(1).alias("step"), F.col("det_id").alias("seq"), F.lit(0).alias("sub"), "label", "conf", "x1", F.when(F.col("label") == "title", F.col("y1")).otherwise(F.col("y1") - 5).alias("y1"), "x2", "y2")
        assert {r.label for r in blocks.titled(simple).collect()} & {"title", "titled_block_title"} == {label}


def test_one_pass_equals_the_steps(spark):
    d = decode.with_labels(decode.nms(fixtures.detections(spark, "/root/testdata/sf0.001"))).where("page_id < 40")
    one, steps = (f(d, 860, 1260).select("page_id", "block_id", "label", "class_id", "conf", "x1", "y1", "x2", "y2").collect() for f in (blocks.group_detections, blocks.group_detections_by_steps))
    assert sorted(map(tuple, one)) == sorted(map(tuple, steps))


def test_empty_page_table(spark):
    assert blocks.group_detections(dets(spark, []), 100, 100).count() == 0
