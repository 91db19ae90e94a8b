import random

import numpy as np

from pagelayout.operators import letters, lines, reflow, skew


def words(spark, rows, page=1):
    return spark.createDataFrame([(page, n, *r) for n, r in enumerate(rows, 1)], "page_id long, word_id int, x1 int, y1 int, x2 int, y2 int")


def test_components_against_pairs(spark):
    rng = random.Random(4)
    rows = [(x := rng.randrange(400), y := rng.randrange(300), x + rng.randrange(5, 60), y + rng.randrange(15, 24)) for _ in range(150)]
    found = {r.word_id: r.component for r in lines.line_components(words(spark, rows)).collect()}
    h = np.median([r[3] - r[1] for r in rows])
    kept = [n for n, r in enumerate(rows, 1) if r[3] - r[1] >= 0.6 * h]
    group = {n: n for n in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            ax1, ay1, ax2, ay2 = rows[a - 1]
            for b in kept:
                bx1, by1, bx2, by2 = rows[b - 1]
                if a != b and bx2 >= ax2 and bx1 <= ax2 + 2 * (ay2 - ay1) and ay1 <= (by1 + by2) / 2 <= ay2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert found == group


def test_edges_in_strips_equal_all_edges(spark):
    rng = random.Random(5)
    rows = [(x := rng.randrange(400), y := rng.randrange(300), x + rng.randrange(5, 60), y + rng.randrange(10, 90)) for _ in range(80)]
    found = {(r.a_id, r.b_id) for r in lines.line_edges(words(spark, rows)).collect()}
    want = {(i, j) for i, a in enumerate(rows, 1) for j, b in enumerate(rows, 1) if i != j and b[2] >= a[2] and b[0] <= a[2] + 2 * (a[3] - a[1]) and a[1] <= (b[1] + b[3]) / 2 <= a[3]}
    assert found == want


def test_merge_schedule():
    assert lines.merge_schedule([], []) == []
    assert lines.merge_schedule([0], [10]) == [0]
    # centres 5, 7, 105: the threshold is min(30, 0.8 * 50)
    assert lines.merge_schedule([0, 2, 100], [10, 12, 110]) == [0, 0, 1]
    # a pass joins neighbours pairwise, the next pass joins the pairs
    assert lines.merge_schedule([0, 1, 2, 3, 300], [10, 11, 12, 13, 310]) == [0, 0, 0, 0, 1]


def test_paragraph_starts_prefer_the_larger_set(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 30), (1, 3, 0), (1, 4, 30)], "page_id long, line int, x1 int")
    starts = {r.line: r.para_start for r in lines.paragraph_starts(rows).collect()}
    assert starts == {1: True, 2: True, 3: False, 4: True}


def line_of(widths, gap=10, line=1, para=False, cuts=()):
    out, x = [], 0
    for n, w in enumerate(widths, 1):
        out.append({"line": line, "word_id": 100 * line + n, "x1": x, "y1": 0, "x2": x + w, "y2": 20, "para_start": para, "ends_hyphen": False, "cuts": list(cuts)})
        x += w + gap
    return out


def test_packing_wraps_whole_words():
    rows = reflow.packed(line_of([50, 50, 50]), 1.0, 115)
    assert [(r[0], r[2], r[5]) for r in rows] == [(1, 101, 0), (1, 102, 10), (2, 103, 0)]


def test_packing_splits_at_letters_with_a_hyphen():
    rows = reflow.packed(line_of([50, 80], cuts=[20, 40, 60]), 1.0, 105)
    # 105 - 50 - 10 leaves 45: the cut at 40
    assert [(r[0], r[3], r[4], r[6] > 0) for r in rows] == [(1, 0, 50, False), (1, 60, 100, True), (2, 100, 140, False)]


def test_paragraph_flag_marks_the_line_before():
    rows = reflow.packed(line_of([90]) + line_of([90], line=2, para=True), 1.0, 100)
    assert [(r[0], r[7]) for r in rows] == [(1, True), (2, False)]


def test_lines_kept_as_they_are():
    rows = reflow.packed(line_of([90, 90], para=True) + line_of([10], line=2), 1.0, 100, keep_lines=True)
    assert [(r[0], r[1], r[5], r[7]) for r in rows] == [(1, 1, 0, True), (1, 2, 10, True), (2, 1, 0, False)]


def test_packed_lines_fit_unless_one_word():
    rng = random.Random(1)
    for _ in range(50):
        source = [w for n in range(1, 5) for w in line_of([rng.randrange(5, 200) for _ in range(rng.randrange(1, 8))], rng.randrange(-12, 20), n, rng.random() < 0.4, [8, 16, 24, 32])]
        rows = reflow.packed(source, 1.3, 300)
        for n in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == n]
            # a split leaves room for the word, not for its hyphen
            assert len(own) == 1 or sum(r[5] + int((r[4] - r[3]) * 1.3) for r in own) <= 300 + (own[-1][6] > 0)
        assert {r[2] for r in rows} == {w["word_id"] for w in source}


def test_letters_join_marks_and_strokes(spark):
    page = [
        {"comp_id": 1, "x": 10, "y": 20, "w": 10, "h": 30, "median_h": 30.0, "is_mark": False},
        {"comp_id": 2, "x": 12, "y": 5, "w": 5, "h": 5, "median_h": 30.0, "is_mark": True},
        {"comp_id": 3, "x": 60, "y": 20, "w": 10, "h": 30, "median_h": 30.0, "is_mark": False},
    ]
    rows = letters.joined_letters(spark.createDataFrame([{"word_key": 7, **r} for r in page])).collect()
    assert sorted(tuple(r)[2:] for r in rows) == [(10, 5, 10, 45), (60, 20, 10, 30)]
    assert sorted(tuple(r)[:2] for r in rows) == [(7, 0), (7, 1)]


def test_robust_angle_edges(spark):
    rows = [(1, float(a)) for a in (0, 0, 0, 0)] + [(2, float(a)) for a in (1, 1, 1, 1, 1)] + [(3, float(a)) for a in (0, 5, -5, 9, -9)]
    found = {r.k: r.angle for r in skew.robust_angle(spark.createDataFrame(rows, "k int, angle double"), "k").collect()}
    assert found == {1: 0.0, 2: 1.0, 3: 0.0}


def test_pending_titles(spark):
    labels = ["titled_block_title", "abandon", "titled_block_body", "titled_block_title", "figure", "plain text"]
    rows = [(1, n, label, 0, 100 * n, 500, 100 * n + 50) for n, label in enumerate(labels)]
    df = spark.createDataFrame(rows, "page_id long, block_id int, label string, x1 int, y1 int, x2 int, y2 int")
    units = [(r.kind, r.block_id, r.title_id) for r in reflow.work_units(df, 1.0, 600, 1000).orderBy("unit").collect()]
    # the second title is dropped by the figure
    assert units == [("title", 0, None), ("text", 2, None), ("image", 4, None), ("text", 5, None)]


def test_stream_of_pages(spark, tmp_path):
    from pagelayout.operators.decode import nms
    from pagelayout.sources import fixtures
    from pagelayout.streaming.pages import each_batch

    dets = fixtures.detections(spark, "/root/testdata/sf0.001")
    dets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(dets.schema).parquet(str(tmp_path / "in"))
    each_batch(stream, nms, str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == nms(dets).count()


def test_ink_components():
    from pagelayout.operators.images import ink_components

    gray = np.full((6, 8), 250, dtype=np.uint8)
    gray[0, 0] = gray[1, 1] = gray[4:6, 5:8] = 10
    assert [(c["x"], c["y"], c["w"], c["h"], c["area"]) for c in ink_components(gray)] == [(0, 0, 2, 2, 2), (5, 4, 3, 2, 6)]


def test_sampled_regions_are_the_same_again(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 400, 300), (1, 10, 400, 80, 500), (2, 0, 0, 40, 300)], "page_id long, x1 int, y1 int, x2 int, y2 int")
    a, b = (sorted(map(tuple, skew.sampled_regions(boxes, "page_id", 600, 600).collect())) for _ in range(2))
    assert a == b and {r[0] for r in a} == {1} and len(a) == 20
    assert all(0 <= r[2] < r[4] <= 600 for r in a)


def test_sampled_regions_of_boxes_with_one_corner_are_ordered(spark):
    rows = [(1, 1, 0, 0, 400, 300), (1, 2, 0, 0, 300, 400), (1, 3, 0, 0, 120, 90)]
    found = {}
    for rank in (None, ("det_id",)):
        for name, own in (("as is", rows), ("reversed", rows[::-1])):
            boxes = spark.createDataFrame(own, "page_id long, det_id int, x1 int, y1 int, x2 int, y2 int").coalesce(1)
            found[rank, name] = sorted(map(tuple, skew.sampled_regions(boxes, "page_id", 600, 600, tries=9, **({"rank": rank} if rank else {})).collect()))
        assert found[rank, "as is"] == found[rank, "reversed"] and len(found[rank, "as is"]) == 19
    assert found[None, "as is"] != found[("det_id",), "as is"]


def test_lines_in_one_pass_equal_the_steps(spark):
    from pagelayout.sources import fixtures

    rows = fixtures.word_boxes(spark, "/root/testdata/sf0.001")
    steps = lines.merge_close_lines(lines.text_lines(rows)).collect()
    assert sorted(map(tuple, lines.group_words(rows).collect())) == sorted(map(tuple, steps)) and steps
    assert lines.group_words(rows.where("page_id < 0")).count() == 0


def test_pixels_and_cells_give_the_same_angles(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 255, (8, 8)).astype(np.uint8) for _ in range(12)] + [np.zeros((8, 8), dtype=np.uint8)]
    cells = spark.createDataFrame([(n, r, c, float(g[r, c])) for n, g in enumerate(images) for r in range(8) for c in range(8)], "k int, r int, c int, z double")
    want = {r.k: r.angle for r in skew.region_angles(cells, "k", 2, 2, 3).collect()}
    crops = spark.createDataFrame([(n, g.tobytes(), 8, 8) for n, g in enumerate(images)] + [(99, None, 0, 0)], "k int, pixels binary, h int, w int")
    got = {r.k: r.angle for r in skew.crop_angles(crops, 2, 2, 3).collect()}
    assert got.pop(99) is None and got.keys() == want.keys()
    for k, angle in got.items():
        assert angle == want[k] if angle is None else abs(angle - want[k]) < 1e-9


def test_components_of_crops(spark):
    from pagelayout.operators.images import with_components

    gray = np.full((5, 5), 200, dtype=np.uint8)
    gray[1:3, 1:3] = 5
    rows = with_components(spark.createDataFrame([(1, gray.tobytes(), 5, 5), (2, None, 0, 0)], "k int, pixels binary, h int, w int")).collect()
    assert [[tuple(c) for c in r.components] for r in rows] == [[(1, 1, 1, 2, 2, 4)], []]
