from pyspark.sql import functions as F

from pagelayout.functions import geometry as g
from pagelayout.functions.geometry import Box
from pagelayout.operators import decode
from pagelayout.sources import fixtures

SF = "/root/testdata/sf0.001"


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, det_id int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")


def test_only_kept_boxes_suppress(spark):
    # 2 falls to 1; 3 overlaps 2 alone, and 2 is gone
    dets = boxes(spark, [(1, 1, 0, 0.9, 0, 0, 100, 100), (1, 2, 0, 0.8, 30, 0, 130, 100), (1, 3, 0, 0.7, 60, 0, 160, 100), (1, 4, 1, 0.6, 0, 0, 100, 100), (2, 1, 0, 0.9, 0, 0, 10, 10)])
    assert sorted((r.page_id, r.det_id) for r in decode.nms(dets).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_iou_at_the_threshold_stays(spark):
    # intersection 9, union 20
    dets = boxes(spark, [(1, 1, 0, 0.9, 0, 0, 10, 1), (1, 2, 0, 0.8, 1, 0, 20, 1)])
    assert dets.select(F.lit(9) / F.lit(20)).first()[0] == 0.45
    assert decode.nms(dets, 0.45).count() == 2
    assert decode.nms(dets, 0.449).count() == 1


def test_nms_is_idempotent_and_leaves_no_overlap(spark):
    kept = decode.nms(fixtures.detections(spark, SF))
    assert decode.nms(kept).count() == kept.count()
    assert decode.iou_pairs(kept).count() == 0


def test_touching_boxes_do_not_meet(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 10, 10, 9, 9, 20, 20)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    a, b = Box("a_"), Box("b_")
    assert [(r[0], r[1]) for r in df.select(a.intersects(b), a.iou(b)).collect()] == [(False, 0.0), (True, 1 / 220)]


def test_top_k_breaks_ties_by_anchor(spark):
    raw = spark.createDataFrame([(1, n, [0.0, 5.0 if n < 3 else 4.0]) for n in range(5)], "page_id long, anchor_id long, logits array<double>")
    rows = decode.top_k(raw, 2).collect()
    assert sorted((r.anchor_id, r.class_id) for r in rows) == [(0, 1), (1, 1)]


def test_letterbox_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1024, 1025)], "w int, h int").select(g.letterbox(F.col("w"), F.col("h"), 1024).alias("b")).select("b.*")
    row = df.first()
    assert (row.new_h, row.pad_top, row.pad_left) == (1024, 0, (1024 - row.new_w) // 2)


def test_word_gap_edges(spark):
    df = spark.createDataFrame([(5,), (0,), (-10,), (-11,)], "g int")
    assert [r[0] for r in df.select(g.word_gap(F.col("g"), F.lit(1.5), F.lit(7))).collect()] == [7, 7, 1, 7]


def test_map_components_join_diagonally_and_drop_thin(spark):
    on = [(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (5, 7)]
    cells = spark.createDataFrame([(1, r, c, 0.9) for r, c in on] + [(1, 0, 5, 0.05)], "map_id long, r int, c int, p double")
    rows = decode.map_components(cells).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 2, 2, 3)]


def test_map_components_in_a_hole_go(spark):
    ring = [(r, c) for r in range(9) for c in range(9) if r in (0, 8) or c in (0, 8)]
    inner = [(r, c) for r in range(3, 6) for c in range(3, 6)]
    # a ring that is open at a side encloses nothing; one open at a corner still does, as the way out is diagonal
    side, corner = [x for x in ring if x != (4, 0)], [x for x in ring if x != (0, 0)]
    cells = spark.createDataFrame([(m, r, c, 0.9) for m, on in ((1, ring), (2, side), (3, corner)) for r, c in [*on, *inner]], "map_id long, r int, c int, p double")
    rows = sorted(tuple(r) for r in decode.map_components(cells).collect())
    assert rows == [(1, 0, 0, 8, 8, 32), (2, 0, 0, 8, 8, 31), (2, 3, 3, 5, 5, 9), (3, 0, 0, 8, 8, 31)]


def test_empty_tables(spark):
    none = boxes(spark, [])
    assert decode.nms(none).count() == 0 and decode.iou_pairs(none).count() == 0


def test_partitioning_does_not_matter(spark):
    dets = fixtures.detections(spark, SF)
    a = decode.nms(dets).groupBy().agg(F.count("*"), F.sum(F.xxhash64("page_id", "det_id").cast("decimal(38,0)"))).first()
    b = decode.nms(dets.repartition(13).orderBy(F.rand(3))).groupBy().agg(F.count("*"), F.sum(F.xxhash64("page_id", "det_id").cast("decimal(38,0)"))).first()
    assert a == b
