"""Semantic blocks from detections.

Input: page_id, det_id (rank by confidence, the canonical order), label, conf and
x1..y2. Everything is keyed by page; the order-dependent pairings are folds over a
page's few boxes. Results carry (step, seq, sub), the order in which a page's
blocks are made, which decides ties in later steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelayout.functions.geometry import BOX, Box, union_box
from pagelayout.functions.pages import per_page
from pagelayout.schema import CLASS_ID

OUT = ("page_id", "step", "seq", "sub", "label", "conf", *BOX)
CAPTION_OF = {"figure": "figure_caption", "isolate_formula": "formula_caption", "table": "table_caption"}
HANDLED = (*CAPTION_OF, *CAPTION_OF.values(), "table_footnote", "plain text")

# the folds read these names from arrays of structs
_FIELDS = ("det_id", *BOX)


def class_id(label: Column) -> Column:
    """A label's class id; synthetic and unknown labels are class 0."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in CLASS_ID.items() for x in (F.lit(k), F.lit(v))]), label), F.lit(0))


def enclosed(rects: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rectangles that no other encloses; of equal ones the last stays."""
    a, b = Box(), Box("o_")
    other = rects.select(*keys, F.col(order).alias("o_n"), *Box().aliased("o_"))
    within = (b.x1 <= a.x1) & (b.y1 <= a.y1) & (b.x2 >= a.x2) & (b.y2 >= a.y2)
    same = (b.x1 == a.x1) & (b.y1 == a.y1) & (b.x2 == a.x2) & (b.y2 == a.y2)
    hit = within & (F.col("o_n") != F.col(order)) & (~same | (F.col("o_n") > F.col(order)))
    return rects.join(other.select(*(F.col(k).alias(f"o_{k}") for k in keys), "o_n", *(f"o_{c}" for c in BOX)), on=_all(*(F.col(k) == F.col(f"o_{k}") for k in keys), hit), how="left_anti")


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def expand_text(dets: DataFrame, page_w: int, page_h: int, by: int = 5) -> DataFrame:
    """Plain text grows by `by` on every side, within the page."""
    grown = {c: F.greatest(F.lit(0), F.col(c) - by) for c in ("x1", "y1")} | {"x2": F.least(F.lit(page_w), F.col("x2") + by), "y2": F.least(F.lit(page_h), F.col("y2") + by)}
    return dets.withColumns({c: F.when(F.col("label") == "plain text", g).otherwise(F.col(c)).cast("int") for c, g in grown.items()})


def _gathered(dets: DataFrame, label: str, name: str) -> Column:
    return F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct(*_FIELDS)))).alias(name)


def greedy_pairs(dets: DataFrame, target: str, caption: str, distance: Callable[[Box, Box], Column]) -> DataFrame:
    """(page_id, caption_id, target_id): each caption, in order, takes the nearest target not yet taken."""
    lists = dets.where(F.col("label").isin(target, caption)).groupBy("page_id").agg(_gathered(dets, caption, "captions"), _gathered(dets, target, "targets")).where((F.size("captions") > 0) & (F.size("targets") > 0))
    zero = F.array().cast("array<struct<caption_id:int,target_id:int>>")

    def step(pairs: Column, cap: Column) -> Column:
        free = F.filter("targets", lambda t: ~F.exists(pairs, lambda p: p["target_id"] == t["det_id"]))
        best = F.array_min(F.transform(free, lambda t: F.struct(distance(Box.of(cap), Box.of(t)).cast("long").alias("d"), t["det_id"].alias("id"))))
        return F.when(best.isNull(), pairs).otherwise(F.concat(pairs, F.array(F.struct(cap["det_id"].alias("caption_id"), best["id"].alias("target_id")))))

    return lists.select("page_id", F.inline(F.aggregate("captions", zero, step)))


def caption_pairs(dets: DataFrame, target: str) -> DataFrame:
    """E3 (figures), E4 (formulas, by height on the page) and E5 (tables)."""
    by_height = target == "isolate_formula"
    return greedy_pairs(dets, target, CAPTION_OF[target], (lambda a, b: a.double_y_distance(b)) if by_height else (lambda a, b: a.square_distance(b)))


def nearest_tables(dets: DataFrame) -> DataFrame:
    """(page_id, footnote_id, table_id): the nearest table of each footnote; tables may serve several."""
    notes = dets.where("label = 'table_footnote'").select("page_id", F.col("det_id").alias("footnote_id"), *Box().aliased("n_"))
    tables = dets.where("label = 'table'").select("page_id", F.col("det_id").alias("table_id"), *Box().aliased("t_"))
    near = F.struct(Box("n_").square_distance(Box("t_")), "table_id")
    return notes.join(tables, "page_id").groupBy("page_id", "footnote_id").agg(F.min_by("table_id", near).alias("table_id"))


def _rows(df: DataFrame, step: int, label: Column | None = None, seq: str = "det_id") -> DataFrame:
    return df.select("page_id", F.lit(step).alias("step"), F.col(seq).alias("seq"), F.lit(0).alias("sub"), (F.col("label") if label is None else label).alias("label"), "conf", *BOX)


def _paired(dets: DataFrame, pairs: DataFrame, label: str, step: int) -> DataFrame:
    """Union box and greater confidence of each caption with its target, in the captions' order."""
    links = pairs.select("page_id", F.col("caption_id").alias("seq"), F.col("caption_id").alias("det_id")).union(pairs.select("page_id", "caption_id", "target_id"))
    merged = dets.drop("label").join(links, ["page_id", "det_id"]).groupBy("page_id", "seq").agg(F.max("conf").alias("conf"), *union_box())
    return _rows(merged, step, F.lit(label), "seq")


def leftovers(dets: DataFrame, pairs: DataFrame, label: str, column: str) -> DataFrame:
    """Detections of a label that no pair has."""
    return dets.where(F.col("label") == label).join(pairs.select("page_id", F.col(column).alias("det_id")), ["page_id", "det_id"], "left_anti")


def captioned(dets: DataFrame, target: str, step: int) -> DataFrame:
    """E3/E4 with E8: merged blocks, then targets and captions left over."""
    pairs = caption_pairs(dets, target)
    return _paired(dets, pairs, f"{target}_and_caption", step).unionByName(_rows(leftovers(dets, pairs, target, "target_id"), step + 1)).unionByName(_rows(leftovers(dets, pairs, CAPTION_OF[target], "caption_id"), step + 2))


def table_groups(dets: DataFrame) -> DataFrame:
    """Every table with its caption and footnotes: union box, greatest confidence, members."""
    tables = dets.where("label = 'table'").select("page_id", F.col("det_id").alias("table_id"), "det_id")
    captions = caption_pairs(dets, "table").select("page_id", F.col("target_id").alias("table_id"), F.col("caption_id").alias("det_id"))
    notes = nearest_tables(dets).select("page_id", "table_id", F.col("footnote_id").alias("det_id"))
    links = tables.unionByName(captions).unionByName(notes)
    return links.join(dets.drop("label"), ["page_id", "det_id"]).groupBy("page_id", "table_id").agg(F.count("*").cast("int").alias("members"), F.max("conf").alias("conf"), *union_box())


def tabled(dets: DataFrame, step: int) -> DataFrame:
    """E5-E8 for tables."""
    groups = _rows(table_groups(dets), step, F.when(F.col("members") > 1, "table_and_caption").otherwise("table"), "table_id")
    caps = _rows(leftovers(dets, caption_pairs(dets, "table"), "table_caption", "caption_id"), step + 1)
    notes = _rows(leftovers(dets, nearest_tables(dets), "table_footnote", "footnote_id"), step + 2)
    return groups.unionByName(caps).unionByName(notes)


def merged_text(dets: DataFrame, least: float = 0.1) -> DataFrame:
    """Plain text boxes that overlap by `least` of the smaller one, closed transitively: (page_id, seq, members, box).

    A fold that keeps each group's own boxes: a new box joins every group it touches.
    seq is the group's least det_id.
    """
    kinds = "array<array<struct<det_id:int,x1:int,y1:int,x2:int,y2:int>>>"

    def touches(a: Column, b: Column) -> Column:
        one, two = Box.of(a), Box.of(b)
        inter, smaller = one.intersection(two).area(), F.least(one.area(), two.area())
        return one.intersects(two) & (smaller > 0) & (inter / smaller >= least)

    def step(groups: Column, d: Column) -> Column:
        near = lambda g: F.exists(g, lambda m: touches(m, d))
        return F.concat(F.filter(groups, lambda g: ~near(g)), F.array(F.concat(F.flatten(F.filter(groups, near)), F.array(d))))

    lists = dets.where("label = 'plain text'").groupBy("page_id").agg(_gathered(dets, "plain text", "boxes"))
    groups = lists.select("page_id", F.explode(F.aggregate("boxes", F.array().cast(kinds), step)).alias("g"))
    pick = lambda f, c: f(F.transform("g", lambda m: m[c])).alias(c)
    return groups.select("page_id", F.array_min(F.transform("g", lambda m: m["det_id"])).alias("seq"), F.size("g").alias("members"), pick(F.array_min, "x1"), pick(F.array_min, "y1"), pick(F.array_max, "x2"), pick(F.array_max, "y2"))


def cut_bands(text: DataFrame, regions: DataFrame, least: int = 10) -> DataFrame:
    """(page_id, seq, top, bottom): where regions cross a text box over `least` or more of height."""
    box, region = Box(), Box("r_")
    other = regions.select("page_id", *Box().aliased("r_"))
    inter = box.intersection(region)
    return text.join(other, "page_id").where(box.intersects(region) & (inter.y2 - inter.y1 >= least)).select("page_id", "seq", inter.y1.alias("top"), inter.y2.alias("bottom"))


def merged_bands(bands: DataFrame) -> DataFrame:
    """Bands of a box joined where they overlap or touch."""
    w = Window.partitionBy("page_id", "seq").orderBy("top", "bottom")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = bands.withColumn("_new", F.when(reach.isNull() | (F.col("top") > reach), 1).otherwise(0))
    islands = islands.withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return islands.groupBy("page_id", "seq", "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def text_slices(text: DataFrame, bands: DataFrame, least: int = 20) -> DataFrame:
    """What is left of text boxes between merged bands, from `least` high on; boxes without bands stay as they are."""
    lists = bands.groupBy("page_id", "seq").agg(F.sort_array(F.collect_list(F.struct("top", "bottom"))).alias("bands"))
    cuts = text.join(lists, ["page_id", "seq"], "left")
    tops = F.concat(F.array("y1"), F.transform("bands", lambda b: b["bottom"]))
    ends = F.concat(F.transform("bands", lambda b: b["top"]), F.array("y2"))
    pieces = F.when(F.col("bands").isNull(), F.array(F.struct(F.lit(0).alias("sub"), F.col("y1").alias("a"), F.col("y2").alias("b")))).otherwise(
        F.filter(F.zip_with(F.zip_with(tops, F.sequence(F.lit(0), F.size("bands")), lambda t, i: F.struct(i.alias("sub"), t.alias("a"))), ends, lambda t, e: F.struct(t["sub"].alias("sub"), t["a"].alias("a"), e.alias("b"))), lambda p: p["b"] - p["a"] >= least)
    )
    return cuts.select("page_id", "seq", "x1", "x2", F.inline(pieces)).select("page_id", "seq", "sub", "x1", F.col("a").alias("y1"), "x2", F.col("b").alias("y2"))


def passed_through(dets: DataFrame, step: int) -> DataFrame:
    """Other labels, one after another in the order of their first detection."""
    first = F.min("det_id").over(Window.partitionBy("page_id", "label"))
    rest = dets.where(~F.col("label").isin(*HANDLED)).withColumn("seq", first * 100_000 + F.col("det_id"))
    return _rows(rest, step, None, "seq")


def title_pairs(blocks: DataFrame, most_gap: int = 50, least_overlap: float = 0.5) -> DataFrame:
    """(page_id, title, body): keys (step, seq, sub) of each title and the nearest free text below it."""
    key = F.struct("step", "seq", "sub")
    rows = blocks.where("label IN ('title', 'plain text')")
    item = F.struct(key.alias("key"), *BOX)
    lists = rows.groupBy("page_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("label") == v, item))).alias(n) for v, n in (("title", "titles"), ("plain text", "texts")))).where((F.size("titles") > 0) & (F.size("texts") > 0))
    kind = "struct<step:int,seq:int,sub:int>"
    zero = F.array().cast(f"array<struct<title:{kind},body:{kind}>>")

    def step(pairs: Column, t: Column) -> Column:
        def fits(p: Column) -> Column:
            gap, narrower = p["y1"] - t["y2"], F.least(t["x2"] - t["x1"], p["x2"] - p["x1"])
            overlap = F.least(t["x2"], p["x2"]) - F.greatest(t["x1"], p["x1"])
            return (gap >= 0) & (gap <= most_gap) & (narrower > 0) & (overlap / narrower >= least_overlap) & ~F.exists(pairs, lambda q: q["body"] == p["key"])

        best = F.array_min(F.transform(F.filter("texts", fits), lambda p: F.struct((p["y1"] - t["y2"]).alias("gap"), p["key"].alias("key"))))
        return F.when(best.isNull(), pairs).otherwise(F.concat(pairs, F.array(F.struct(t["key"].alias("title"), best["key"].alias("body")))))

    return lists.select("page_id", F.inline(F.aggregate("titles", zero, step)))


def titled(blocks: DataFrame) -> DataFrame:
    """Paired titles and texts become titled_block_title and _body, both at the title's place and with its confidence."""
    key = F.struct("step", "seq", "sub")
    pairs = title_pairs(blocks)
    keyed = blocks.withColumn("_key", key)
    rest = keyed.join(pairs.select("page_id", F.explode(F.array("title", "body")).alias("_key")), ["page_id", "_key"], "left_anti").drop("_key")
    titles = keyed.join(pairs.select("page_id", F.col("title").alias("_key"), "body"), ["page_id", "_key"])
    heads = titles.select("page_id", "step", "seq", F.lit(0).alias("sub"), F.lit("titled_block_title").alias("label"), "conf", *BOX)
    places = titles.select("page_id", F.col("body").alias("_key"), "step", "seq", "conf")
    bodies = keyed.select("page_id", "_key", *BOX).join(places, ["page_id", "_key"]).select("page_id", "step", "seq", F.lit(1).alias("sub"), F.lit("titled_block_body").alias("label"), "conf", *BOX)
    return rest.unionByName(heads).unionByName(bodies)


def uncovered_text(blocks: DataFrame) -> DataFrame:
    """Plain text that another one covers goes; two that cover each other both go."""
    key = F.struct("step", "seq", "sub")
    text = blocks.where("label = 'plain text'").withColumn("_key", key)
    a, b = Box(), Box("o_")
    other = text.select(F.col("page_id").alias("o_page"), F.col("_key").alias("o_key"), *Box().aliased("o_"))
    overlap = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    covers = (F.col("page_id") == F.col("o_page")) & (F.col("_key") != F.col("o_key")) & (a.y1 >= b.y1 - 2) & (a.y2 <= b.y2 + 2) & (overlap > 0.7 * (a.x2 - a.x1))
    return blocks.where("label <> 'plain text'").unionByName(text.join(other, covers, "left_anti").drop("_key"))


def _span(a: tuple, b: tuple) -> tuple:
    """Intersection of two boxes."""
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def _size(box: tuple) -> int:
    return max(0, box[2] - box[0]) * max(0, box[3] - box[1])


def _hull(boxes: list[tuple]) -> tuple:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _far(a: tuple, b: tuple) -> int:
    return (a[0] + a[2] - b[0] - b[2]) ** 2 + (a[1] + a[3] - b[1] - b[3]) ** 2


def _slices(box: tuple, regions: list[tuple], least_band: int = 10, least_slice: int = 20) -> list[tuple]:
    """E10 for one text box."""
    bands: list[list[int]] = []
    for top, bottom in sorted((s[1], s[3]) for s in (_span(box, r) for r in regions) if _size(s) > 0 and s[3] - s[1] >= least_band):
        if bands and top <= bands[-1][1]:
            bands[-1][1] = max(bands[-1][1], bottom)
        else:
            bands.append([top, bottom])
    if not bands:
        return [box]
    tops, ends = [box[1], *(b for _, b in bands)], [*(t for t, _ in bands), box[3]]
    return [(box[0], t, box[2], e) for t, e in zip(tops, ends, strict=True) if e - t >= least_slice]


def group_page(page: list[dict], page_w: int, page_h: int) -> list[tuple]:
    """E1-E13 for the detections of one page in det_id order: (label, conf, box) in the order they are made."""
    box, by_label = {}, {}
    for d in page:
        b = tuple(d[c] for c in BOX)
        if d["label"] == "plain text":
            b = (max(0, b[0] - 5), max(0, b[1] - 5), min(page_w, b[2] + 5), min(page_h, b[3] + 5))
        box[d["det_id"]] = b
        by_label.setdefault(d["label"], []).append(d["det_id"])
    conf = {d["det_id"]: d["conf"] for d in page}
    of = lambda label: by_label.get(label, [])
    out: list[tuple] = []

    def paired(target: str) -> dict[int, int]:
        """Caption -> target."""
        measure = (lambda a, b: abs(a[1] + a[3] - b[1] - b[3])) if target == "isolate_formula" else _far
        free, pairs = list(of(target)), {}
        for c in of(CAPTION_OF[target]):
            if free:
                pairs[c] = min(free, key=lambda t: (measure(box[c], box[t]), t))
                free.remove(pairs[c])
        return pairs

    def alone(label: str, taken) -> None:
        out.extend((label, conf[i], box[i]) for i in of(label) if i not in taken)

    for target in ("figure", "isolate_formula"):
        pairs = paired(target)
        out.extend((f"{target}_and_caption", max(conf[c], conf[t]), _hull([box[c], box[t]])) for c, t in pairs.items())
        alone(target, set(pairs.values()))
        alone(CAPTION_OF[target], pairs)

    groups: dict[int, list[int]] = {t: [t] for t in of("table")}
    pairs = paired("table")
    for c, t in pairs.items():
        groups[t].append(c)
    notes = of("table_footnote") if groups else []
    for n in notes:
        groups[min(groups, key=lambda t: (_far(box[n], box[t]), t))].append(n)
    out.extend(("table_and_caption" if len(own) > 1 else "table", max(conf[i] for i in own), _hull([box[i] for i in own])) for own in groups.values())
    alone("table_caption", pairs)
    alone("table_footnote", notes)

    parts: list[list[int]] = []
    for i in of("plain text"):
        near = [g for g in parts if any((s := _size(_span(box[i], box[j]))) > 0 and s / min(_size(box[i]), _size(box[j])) >= 0.1 for j in g)]
        parts = [g for g in parts if g not in near] + [[*(j for g in near for j in g), i]]
    regions = [b for _, _, b in out] + [box[d["det_id"]] for d in page if d["label"] != "plain text"]
    for own in sorted(parts, key=min):
        out.extend(("plain text", 1.0, b) for b in _slices(_hull([box[i] for i in own]), regions))
    for label, own in by_label.items():
        if label not in HANDLED:
            out.extend((label, conf[i], box[i]) for i in own)

    # Each title takes the nearest free text below it
    body: dict[int, int] = {}
    for t, (label, _, tb) in enumerate(out):
        if label != "title":
            continue
        best = None
        for p, (other, _, pb) in enumerate(out):
            gap, narrower = pb[1] - tb[3], min(tb[2] - tb[0], pb[2] - pb[0])
            if other == "plain text" and p not in body.values() and 0 <= gap <= 50 and narrower > 0 and (min(tb[2], pb[2]) - max(tb[0], pb[0])) / narrower >= 0.5 and (best is None or gap < best[0]):
                best = (gap, p)
        if best:
            body[t] = best[1]
    made = []
    for i, (label, c, b) in enumerate(out):
        if i in body:
            made += [("titled_block_title", c, b), ("titled_block_body", c, out[body[i]][2])]
        elif i not in body.values():
            made.append((label, c, b))

    # Text that another covers goes, both where they cover each other
    text = [b for label, _, b in made if label == "plain text"]

    def covered(b: tuple) -> bool:
        others = list(text)
        others.remove(b)
        return any(b[1] >= o[1] - 2 and b[3] <= o[3] + 2 and min(b[2], o[2]) - max(b[0], o[0]) > 0.7 * (b[2] - b[0]) for o in others)

    return [x for x in made if x[0] != "plain text" or not covered(x[2])]


def group_detections(dets: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """page_id, block_id (order on the page), label, class_id, conf and box of every block.

    All steps of a page in one pass: its detections (hundreds at most) are exchanged
    once by page, where the steps' own tables would take some twenty exchanges.
    """
    rows = dets.select("page_id", "det_id", "label", "conf", *BOX)
    work = lambda page: [(n, label, c, *b) for n, (label, c, b) in enumerate(group_page(page, page_w, page_h), 1)]
    made = per_page(rows, ["page_id"], ["det_id"], work, "block_id int, label string, conf double, x1 int, y1 int, x2 int, y2 int")
    return made.select("page_id", "block_id", "label", class_id(F.col("label")).alias("class_id"), "conf", *BOX)


def group_detections_by_steps(dets: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """As group_detections, from the single steps' tables: for those who want the tables, and to check against.

    Steps read what earlier ones made several times, so those tables are kept in
    memory, or on disk where it runs short; a lost part is made again.
    """
    kept = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    dets = kept(expand_text(dets.select("page_id", "det_id", "label", "conf", *BOX), page_w, page_h).repartition("page_id"))
    made = kept(captioned(dets, "figure", 1).unionByName(captioned(dets, "isolate_formula", 4)).unionByName(tabled(dets, 7)))
    text = kept(merged_text(dets))
    regions = made.select("page_id", *BOX).union(dets.where("label <> 'plain text'").select("page_id", *BOX))
    slices = text_slices(text, merged_bands(cut_bands(text, regions)))
    slices = slices.select("page_id", F.lit(10).alias("step"), "seq", "sub", F.lit("plain text").alias("label"), F.lit(1.0).alias("conf"), *BOX)
    blocks = uncovered_text(kept(titled(kept(made.unionByName(slices).unionByName(passed_through(dets, 11))))))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("step", "seq", "sub"))
    return blocks.select("page_id", rank.alias("block_id"), "label", class_id(F.col("label")).alias("class_id"), "conf", *BOX)
