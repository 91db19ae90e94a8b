"""DuckDB SQL for the registered queries, written on its own from the operators' definitions."""

from __future__ import annotations

from pagelayout.schema import CLASS_ID, CLASSES, LANGUAGES, NON_TEXT_LABELS, TEXT_LABELS
from pagelayout.sources.fixtures import DETECTIONS, PAGE_H, PAGE_W, WORD_BOXES
from pagelayout.sources.remote import BOUNDARY

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LABELS = "(VALUES " + ", ".join(f"({i}, '{label}')" for i, (label, _) in enumerate(CLASSES)) + ") cl(class_id, label)"
_LET = {
    "det_all": DETECTIONS.format(lineitem="lineitem"),
    "det": "SELECT * FROM det_all WHERE conf >= 0.51",
    "lab": f"SELECT d.*, coalesce(label, CAST(d.class_id AS VARCHAR)) AS label FROM det d LEFT JOIN {_LABELS} ON cl.class_id = d.class_id",
    "reg": "SELECT page_id, det_id AS block_id, CASE WHEN label = 'title' AND det_id % 2 = 0 THEN 'titled_block_title' WHEN label = 'plain text' AND det_id % 3 = 0 THEN 'titled_block_body' ELSE label END AS label, x1, y1, x2, y2 FROM lab",
    "raw": "SELECT vec_id // 50 AS page_id, vec_id % 50 AS anchor_id, bx1, by1, bx1 + 20 + 600 * abs(CAST(embedding[13] AS DOUBLE)) AS bx2, by1 + 20 + 600 * abs(CAST(embedding[14] AS DOUBLE)) AS by2, [CAST(v AS DOUBLE) * 10 FOR v IN embedding[1:10]] AS logits, CAST(800 + (vec_id // 50 % 5) * 100 AS INT) AS img_w, CAST(1100 + (vec_id // 50 % 3) * 150 AS INT) AS img_h FROM (SELECT *, 512 + 900 * CAST(embedding[11] AS DOUBLE) AS bx1, 512 + 900 * CAST(embedding[12] AS DOUBLE) AS by1 FROM embeddings)",
    "grid": "SELECT vec_id, CAST(k // 8 AS INT) AS r, CAST(k % 8 AS INT) AS c, CAST(v AS DOUBLE) * 10 AS z FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS k FROM embeddings)",
    "ang": "SELECT user_id AS region_set, event_id, value - 3 * floor(value / 3) - 1.5 AS angle FROM events",
    "comp": "SELECT word_key, CAST(row_number() OVER (PARTITION BY word_key ORDER BY x, y, w, h, l_partkey, l_suppkey) AS INT) AS comp_id, x, y, w, h, w * h AS area, 200 AS word_w, 60 AS word_h FROM (SELECT l_orderkey AS word_key, CAST(l_partkey % 180 AS INT) AS x, CAST(l_suppkey % 40 AS INT) AS y, CAST(2 + CAST(l_quantity AS INT) % 18 AS INT) AS w, CAST(2 + 3 * l_linenumber AS INT) AS h, l_partkey, l_suppkey FROM lineitem)",
    "tokl": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents",
    "tok": "SELECT doc_id, ln, length(line) AS llen, generate_subscripts(string_split(line, ' '), 1) - 1 AS wi, unnest(string_split(line, ' ')) AS word FROM tokl",
    "word": WORD_BOXES.format(tok="tok"),
    "ses0": "SELECT *, (y1 + y2) / 2 AS cy, median(y2 - y1) OVER (PARTITION BY page_id) AS med FROM word",
    "ses1": "SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, word_id) >= 0.6 * med THEN 1 ELSE 0 END AS fresh FROM ses0",
    "ses2": "SELECT *, CAST(1 + sum(fresh) OVER (PARTITION BY page_id ORDER BY cy, word_id ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM ses1",
    "ses": "SELECT page_id, word_id, x1, y1, x2, y2, line, med, CAST(row_number() OVER (PARTITION BY page_id, line ORDER BY x1, word_id) AS INT) AS pos FROM ses2",
    "para0": "SELECT page_id, line, min(x1) AS x1 FROM ses GROUP BY page_id, line",
    "para1": "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line) = 1 AS first_line, lag(x1) OVER (PARTITION BY page_id ORDER BY line) AS before, avg(x1) OVER (PARTITION BY page_id) AS m, stddev_pop(x1) OVER (PARTITION BY page_id) AS sd, count(*) OVER (PARTITION BY page_id) AS n FROM para0",
    "para2": "SELECT *, first_line OR (n > 1 AND x1 > round(m + 1.5 * sd, 9)) AS one, first_line OR coalesce(x1 > before + 20, false) AS two FROM para1",
    "para": "SELECT page_id, line, x1, CASE WHEN sum(one::INT) OVER (PARTITION BY page_id) >= sum(two::INT) OVER (PARTITION BY page_id) THEN one ELSE two END AS para_start FROM para2",
    "gap0": "SELECT *, lag(x2) OVER (PARTITION BY page_id, line ORDER BY x1, pos) AS before FROM ses",
    "gapm": "SELECT page_id, trunc(list_sort(list(y2 - y1))[CAST(count(*) // 2 AS INT) + 1] * 1.5 * 0.30) AS avg_space FROM ses GROUP BY page_id",
    "gaps": "SELECT gap0.*, CAST(CASE WHEN before IS NULL THEN 0 WHEN x1 - before > 0 THEN trunc((x1 - before) * 1.5) WHEN x1 - before >= -10 THEN greatest(1, floor((x1 - before + 10) * 1.5 / 2)) ELSE avg_space END AS INT) AS space FROM gap0 JOIN gapm USING (page_id)",
    "plc": "SELECT g.page_id, g.line AS out_line, g.pos, g.word_id, g.x1, g.y1, g.x2, g.y2, g.space, p.para_start, g.y2 - g.y1 AS above, g.word_id % 4 AS bl FROM gaps g JOIN para p ON p.page_id = g.page_id AND p.line = g.line",
}
# what each of them reads, in the order of definition
_NEEDS = {"det": ["det_all"], "lab": ["det"], "reg": ["lab"], "tok": ["tokl"], "word": ["tok"], "ses0": ["word"], "ses1": ["ses0"], "ses2": ["ses1"], "ses": ["ses2"], "para0": ["ses"], "para1": ["para0"], "para2": ["para1"], "para": ["para2"], "gap0": ["ses"], "gapm": ["ses"], "gaps": ["gap0", "gapm"], "plc": ["gaps", "para"]}


def _with(*names: str, recursive: bool = False) -> str:
    seen: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('det', 'lab', 'word', 'ses', 'grid', 'comp', 'pw', 'mk2', 'lg', 'sd', 'mt', 'le') else ''}({_LET[n]})" for n in seen)


def _sql(name: str, needs: list[str], body: str, recursive: bool = False) -> None:
    """`body` is a SELECT, or further CTEs after a comma and a SELECT."""
    head = _with(*needs, recursive=recursive) if needs else ""
    ORACLES[name] = f"{head}{body}" if body.startswith(",") or not head else f"{head}\n{body}"


_INTER = "greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
_AREA = "(greatest(0, {a}x2 - {a}x1) * greatest(0, {a}y2 - {a}y1))"
_MEETS = "{a}x1 < {b}x2 AND {b}x1 < {a}x2 AND {a}y1 < {b}y2 AND {b}y1 < {a}y2"


def _inter(a: str, b: str) -> str:
    return "(" + _INTER.format(a=a, b=b) + ")"


def _area(a: str) -> str:
    return _AREA.format(a=a)


def _meets(a: str, b: str) -> str:
    return "(" + _MEETS.format(a=a, b=b) + ")"


def _iou(a: str, b: str) -> str:
    return f"(CASE WHEN {_inter(a, b)} = 0 THEN 0.0 ELSE {_inter(a, b)}::DOUBLE / ({_area(a)} + {_area(b)} - {_inter(a, b)}) END)"


_LB = "1024.0 / greatest(img_w, img_h)"
_LBC = f"SELECT *, {_LB} AS scale, CAST(round_even(img_w * ({_LB}), 0) AS INT) AS new_w, CAST(round_even(img_h * ({_LB}), 0) AS INT) AS new_h FROM raw"
_sql("b1_letterbox", ["raw"], f", l AS ({_LBC}) SELECT DISTINCT page_id, img_w, img_h, round(scale, 6) AS scale, new_w, new_h, CAST(floor((1024 - new_w) / 2) AS INT) AS pad_left, CAST(floor((1024 - new_h) / 2) AS INT) AS pad_top FROM l")
_sql("b2_normalise", ["grid"], "SELECT vec_id, r, c, round(v / 255.0, 6) AS unit, round((v / 255.0 - 0.694) / 0.298, 6) AS value FROM (SELECT *, CAST(floor(abs(z) * 10) AS BIGINT) % 256 AS v FROM grid)")
_sql("b3_crop_geometry", ["det"], "SELECT page_id, det_id, new_w, least(new_w, 320) AS kept_w, greatest(0, 320 - new_w) AS pad_right FROM (SELECT *, greatest(1, CAST(trunc((x2 - x1) * 48 / (y2 - y1)) AS INT)) AS new_w FROM det)")
_sql("b4_sigmoid", ["grid"], "SELECT vec_id, r, c, round(1 / (1 + exp(-z)), 6) AS p, round(1 / (1 + exp(-greatest(-88.0, least(88.0, z * 40)))), 6) AS clipped FROM grid")
_sql("b5_background", ["grid"], "SELECT vec_id AS page_id, c AS channel, CAST(trunc(median(CAST(floor(abs(z) * 10) AS BIGINT) % 256)) AS INT) AS value FROM grid GROUP BY vec_id, c")
_sql(
    "b7_zoom_crop",
    ["det"],
    ", s AS (SELECT *, CAST(trunc((x2 - x1) * z) AS INT) AS zw, CAST(trunc((y2 - y1) * z) AS INT) AS zh FROM (SELECT *, 1 + (det_id % 5) * 0.5::DOUBLE AS z FROM det)), t AS (SELECT *, greatest(1, least(zw, 380)) AS w, greatest(1, CASE WHEN zw > 380 THEN CAST(trunc(zh * (380::DOUBLE / zw)) AS INT) ELSE zh END) AS h FROM s) SELECT page_id, det_id, w, h, greatest(0, least(CAST(10 + floor((380 - w) / 2) AS INT), 400 - w)) AS x_off FROM t",
)
_sql("b8_display_size", ["raw"], "SELECT DISTINCT page_id, least(900, img_w) AS w, CAST(trunc(least(900, img_w) * img_h / img_w) AS INT) AS h FROM raw")
_sql("b9_rotated_size", ["ang"], f", a AS (SELECT event_id, round(angle, 4) AS d, abs(cos(round(angle, 4) * (pi() / 180))) AS co, abs(sin(round(angle, 4) * (pi() / 180))) AS si FROM ang) SELECT event_id, CAST(CASE WHEN abs(d) < 0.1 THEN {PAGE_W} ELSE trunc({PAGE_H} * si + {PAGE_W} * co) END AS INT) AS w, CAST(CASE WHEN abs(d) < 0.1 THEN {PAGE_H} ELSE trunc({PAGE_H} * co + {PAGE_W} * si) END AS INT) AS h FROM a")
_N = ", ".join(f"lead({c}) OVER (PARTITION BY page_id ORDER BY det_id) AS n_{c}" for c in ("x1", "y1", "x2", "y2"))
_sql(
    "d1_box_algebra",
    ["det"],
    f", p AS (SELECT * FROM (SELECT *, {_N} FROM det) WHERE n_x1 IS NOT NULL), q AS (SELECT *, {_meets('', 'n_')} AS meets FROM p) SELECT page_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round(sqrt((x1 + x2 - n_x1 - n_x2) ** 2 + (y1 + y2 - n_y1 - n_y2) ** 2) / 2, 6) AS distance, abs(y1 + y2 - n_y1 - n_y2) / 2 AS y_distance, {_area('')}::BIGINT AS area, meets, {_inter('', 'n_')}::BIGINT AS shared, CASE WHEN meets THEN greatest(x1, n_x1) END AS i_x1, CASE WHEN meets THEN greatest(y1, n_y1) END AS i_y1, CASE WHEN meets THEN least(x2, n_x2) END AS i_x2, CASE WHEN meets THEN least(y2, n_y2) END AS i_y2 FROM q",
)
_sql("d4_page_union", ["det"], "SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det GROUP BY page_id")
_sql("d9_class_ids", ["reg"], "SELECT label, CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASS_ID.items()) + " ELSE 0 END AS class_id, count(*) AS n FROM reg GROUP BY label")
_sql("g11_hyphen_size", ["det"], ", i AS (SELECT page_id, det_id, greatest(4, CAST(trunc((y2 - y1) * 0.37::DOUBLE) AS INT)) AS h FROM det) SELECT page_id, det_id, h, greatest(4, CAST(round_even(h * 0.35::DOUBLE, 0) AS INT)) + 4 AS w, greatest(2, CAST(round_even(h * 0.07::DOUBLE, 0) AS INT)) AS stroke_h, greatest(4, CAST(round_even(h * 0.35::DOUBLE, 0) AS INT)) AS stroke_w FROM i")

_LET["best"] = "SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS class_id, list_max(logits) AS logit FROM raw"
_LET["topk"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, anchor_id) AS rk FROM best) WHERE rk <= 20"
_NEEDS |= {"best": ["raw"], "topk": ["best"]}
_PADS = f"{_LB} AS scale, floor((1024 - round_even(img_w * ({_LB}), 0)) / 2) AS pl, floor((1024 - round_even(img_h * ({_LB}), 0)) / 2) AS pt"
_BACK = ", ".join(f"greatest(0, least(CAST(trunc(({b} - {pad}) / scale) AS INT), {size} - 1)) AS {c}" for b, c, pad, size in (("bx1", "x1", "pl", "img_w"), ("by1", "y1", "pt", "img_h"), ("bx2", "x2", "pl", "img_w"), ("by2", "y2", "pt", "img_h")))
_sql("c1_best_class", ["best"], "SELECT page_id, anchor_id, class_id, round(logit, 6) AS logit FROM best")
_sql("c2_top_k", ["topk"], "SELECT page_id, anchor_id, class_id FROM topk")
_sql("c4_decode", ["topk"], f", b AS (SELECT *, {_BACK} FROM (SELECT *, {_PADS} FROM topk)), k AS (SELECT * FROM b WHERE 1 / (1 + exp(-logit)) >= 0.51 AND x2 > x1 AND y2 > y1) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, anchor_id) AS INT) AS det_id, cl.label, k.class_id, round(1 / (1 + exp(-logit)), 6) AS conf, x1, y1, x2, y2 FROM k JOIN {_LABELS} ON cl.class_id = k.class_id")
_sql("c9_iou_pairs", ["det"], f"SELECT a.page_id, a.class_id, a.det_id AS a_id, b.det_id AS b_id, round({_iou('a.', 'b.')}, 6) AS iou FROM det a JOIN det b ON a.page_id = b.page_id AND a.class_id = b.class_id AND a.det_id < b.det_id WHERE {_iou('a.', 'b.')} > 0.45")
_LET["nmsr"] = "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS rn FROM det"
_LET["nms"] = f"SELECT page_id, rn, [det_id] AS kept FROM nmsr WHERE rn = 1 UNION ALL SELECT f.page_id, d.rn, CASE WHEN EXISTS (SELECT 1 FROM det k WHERE k.page_id = d.page_id AND list_contains(f.kept, k.det_id) AND k.class_id = d.class_id AND {_iou('k.', 'd.')} > 0.45) THEN f.kept ELSE list_append(f.kept, d.det_id) END FROM nms f JOIN nmsr d ON d.page_id = f.page_id AND d.rn = f.rn + 1"
_LET["nmsk"] = "SELECT page_id, unnest(arg_max(kept, rn)) AS det_id FROM nms GROUP BY page_id"
_NEEDS |= {"nmsr": ["det"], "nms": ["nmsr"], "nmsk": ["nms"]}
_sql("c10_nms", ["nmsk"], "SELECT page_id, det_id FROM nmsk", recursive=True)
_sql("nms_class_counts", ["nmsk"], f"SELECT d.class_id, cl.label, count(*) AS n FROM nmsk JOIN det d USING (page_id, det_id) LEFT JOIN {_LABELS} ON cl.class_id = d.class_id GROUP BY d.class_id, cl.label", recursive=True)
_LET["px"] = "SELECT vec_id AS map_id, r, c, 1 / (1 + exp(-z)) AS p FROM grid"
_LET["on_"] = "SELECT map_id, r, c, r * 8 + c AS k FROM px WHERE p >= 0.5"
_LET["reach"] = "SELECT map_id, k, k AS o FROM on_ UNION SELECT f.map_id, f.k, b.k FROM reach f JOIN on_ a ON a.map_id = f.map_id AND a.k = f.o JOIN on_ b ON b.map_id = a.map_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"
# what lies outside every component, within a frame of one cell around the map
_LET["off_"] = "SELECT m.map_id, a.i AS r, b.i AS c FROM (SELECT DISTINCT map_id FROM on_) m, (SELECT unnest(range(-1, 9)) AS i) a, (SELECT unnest(range(-1, 9)) AS i) b WHERE NOT EXISTS (SELECT 1 FROM on_ o WHERE o.map_id = m.map_id AND o.r = a.i AND o.c = b.i)"
_LET["air"] = "SELECT DISTINCT map_id, CAST(-1 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS c FROM on_ UNION SELECT o.map_id, o.r, o.c FROM air f JOIN off_ o ON o.map_id = f.map_id AND abs(o.r - f.r) + abs(o.c - f.c) = 1"
_LET["comps"] = "SELECT map_id, k, min(o) AS root FROM reach GROUP BY map_id, k"
_LET["outer_"] = "SELECT DISTINCT s.map_id, s.root FROM comps s JOIN on_ o ON o.map_id = s.map_id AND o.k = s.k JOIN air f ON f.map_id = o.map_id AND abs(o.r - f.r) + abs(o.c - f.c) = 1"
_LET["rects"] = "SELECT map_id, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2, CAST(count(*) AS INT) AS n_cells FROM comps JOIN on_ USING (map_id, k) JOIN outer_ USING (map_id, root) GROUP BY map_id, root HAVING max(r) - min(r) >= 2 AND max(c) - min(c) >= 2"
_NEEDS |= {"px": ["grid"], "on_": ["px"], "reach": ["on_"], "off_": ["on_"], "air": ["on_", "off_"], "comps": ["reach"], "outer_": ["comps", "on_", "air"], "rects": ["comps", "outer_"]}
_sql("c11_map_components", ["rects"], "SELECT * FROM rects", recursive=True)
_sql("c14_rect_scores", ["rects"], "SELECT map_id, r1, c1, r2, c2, round(avg(p), 6) AS score FROM (SELECT DISTINCT map_id, r1, c1, r2, c2 FROM rects) JOIN px USING (map_id) WHERE r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY map_id, r1, c1, r2, c2 HAVING avg(p) >= 0.5", recursive=True)
_sql("c15_unclip", ["det"], ", d AS (SELECT *, CAST(trunc((x2 - x1) * (y2 - y1) * 1.0::DOUBLE / (2 * (x2 - x1 + y2 - y1))) AS INT) AS g FROM det) SELECT page_id, det_id, greatest(0, x1 - g) AS x1, greatest(0, y1 - g) AS y1, least(1024, x2 + g) AS x2, least(1024, y2 + g) AS y2 FROM d")
_sql("c16_undo_letterbox", ["raw"], f", b AS (SELECT *, {_BACK} FROM (SELECT *, {_PADS} FROM raw)) SELECT page_id, anchor_id, x1, y1, x2, y2 FROM b WHERE x2 > x1 AND y2 > y1")

_sql("d10_enclosed_rects", ["det"], "SELECT page_id, det_id FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.page_id = a.page_id AND b.det_id <> a.det_id AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2 AND (b.det_id > a.det_id OR b.x1 < a.x1 OR b.y1 < a.y1 OR b.x2 > a.x2 OR b.y2 > a.y2))")
_sql("e1_expand_text", ["lab"], f"SELECT page_id, det_id, CASE WHEN label = 'plain text' THEN greatest(0, x1 - 5) ELSE x1 END AS x1, CASE WHEN label = 'plain text' THEN greatest(0, y1 - 5) ELSE y1 END AS y1, CASE WHEN label = 'plain text' THEN least({PAGE_W}, x2 + 5) ELSE x2 END AS x2, CASE WHEN label = 'plain text' THEN least(1000, y2 + 5) ELSE y2 END AS y2 FROM lab")
_sql("e2_label_counts", ["lab"], "SELECT page_id, label, count(*) AS n, min(det_id) AS first_id FROM lab GROUP BY page_id, label")
_CENTRE = "(c.x1 + c.x2 - t.x1 - t.x2) ** 2 + (c.y1 + c.y2 - t.y1 - t.y2) ** 2"


def _pairing(target: str, caption: str, distance: str, tag: str) -> None:
    """CTEs cap{tag} ... pairs{tag}: captions one by one, the state being the targets taken (0 for none)."""
    _LET[f"cap{tag}"] = f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS rn FROM lab WHERE label = '{caption}'"
    _LET[f"tgt{tag}"] = f"SELECT * FROM lab WHERE label = '{target}'"
    _LET[f"fold{tag}"] = f"SELECT DISTINCT page_id, 0::BIGINT AS rn, CAST([] AS INT[]) AS taken FROM cap{tag} UNION ALL SELECT f.page_id, c.rn, list_append(f.taken, coalesce((SELECT arg_min(t.det_id, ({distance}) * 100000 + t.det_id) FROM tgt{tag} t WHERE t.page_id = c.page_id AND NOT list_contains(f.taken, t.det_id)), 0)) FROM fold{tag} f JOIN cap{tag} c ON c.page_id = f.page_id AND c.rn = f.rn + 1"
    _LET[f"last{tag}"] = f"SELECT page_id, arg_max(taken, rn) AS taken FROM fold{tag} GROUP BY page_id"
    _LET[f"pairs{tag}"] = f"SELECT c.page_id, c.det_id AS caption_id, taken[c.rn] AS target_id FROM cap{tag} c JOIN last{tag} USING (page_id) WHERE taken[c.rn] <> 0"
    _NEEDS.update({f"cap{tag}": ["lab"], f"tgt{tag}": ["lab"], f"fold{tag}": [f"cap{tag}", f"tgt{tag}"], f"last{tag}": [f"fold{tag}"], f"pairs{tag}": [f"last{tag}"]})


_pairing("figure", "figure_caption", _CENTRE, "f")
_pairing("isolate_formula", "formula_caption", "abs(c.y1 + c.y2 - t.y1 - t.y2)", "i")
_pairing("table", "table_caption", _CENTRE, "t")
_sql("e3_figure_captions", ["pairsf"], "SELECT * FROM pairsf", recursive=True)
_sql("e4_formula_captions", ["pairsi"], "SELECT * FROM pairsi", recursive=True)
_sql("e5_table_captions", ["pairst"], "SELECT * FROM pairst", recursive=True)
_LET["notes"] = f"SELECT c.page_id, c.det_id AS footnote_id, arg_min(t.det_id, ({_CENTRE}) * 100000 + t.det_id) AS table_id FROM lab c JOIN lab t ON t.page_id = c.page_id AND t.label = 'table' WHERE c.label = 'table_footnote' GROUP BY c.page_id, c.det_id"
_NEEDS["notes"] = ["lab"]
_sql("e6_table_footnotes", ["notes"], "SELECT * FROM notes")
_sql("e7_table_groups", ["pairst", "notes"], ", m AS (SELECT page_id, det_id AS table_id, det_id FROM lab WHERE label = 'table' UNION ALL SELECT page_id, target_id, caption_id FROM pairst UNION ALL SELECT page_id, table_id, footnote_id FROM notes) SELECT m.page_id, m.table_id, CAST(count(*) AS INT) AS members, round(max(conf), 6) AS conf, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM m JOIN lab l ON l.page_id = m.page_id AND l.det_id = m.det_id GROUP BY m.page_id, m.table_id", recursive=True)
_sql("e8_leftovers", ["pairsf"], "SELECT page_id, det_id, label FROM lab l WHERE label IN ('figure', 'figure_caption') AND NOT EXISTS (SELECT 1 FROM pairsf p WHERE p.page_id = l.page_id AND l.det_id IN (p.caption_id, p.target_id))", recursive=True)
_LET["pt"] = "SELECT * FROM lab WHERE label = 'plain text'"
_LET["near"] = f"SELECT a.page_id, a.det_id AS a, b.det_id AS b FROM pt a JOIN pt b ON a.page_id = b.page_id WHERE {_meets('a.', 'b.')} AND {_inter('a.', 'b.')}::DOUBLE / least({_area('a.')}, {_area('b.')}) >= 0.1"
_LET["conn"] = "SELECT page_id, det_id AS a, det_id AS b FROM pt UNION SELECT c.page_id, c.a, n.b FROM conn c JOIN near n ON n.page_id = c.page_id AND n.a = c.b"
_LET["text"] = "SELECT page_id, seq, CAST(count(*) AS INT) AS members, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM (SELECT page_id, a AS det_id, min(b) AS seq FROM conn GROUP BY page_id, a) JOIN pt USING (page_id, det_id) GROUP BY page_id, seq"
_LET["band0"] = f"SELECT DISTINCT t.page_id, t.seq, greatest(t.y1, r.y1) AS top, least(t.y2, r.y2) AS bottom FROM text t JOIN lab r ON r.page_id = t.page_id AND r.label <> 'plain text' WHERE {_meets('t.', 'r.')} AND least(t.y2, r.y2) - greatest(t.y1, r.y1) >= 10"
_LET["band1"] = "SELECT *, max(bottom) OVER (PARTITION BY page_id, seq ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM band0"
_LET["band2"] = "SELECT *, CAST(sum(CASE WHEN so_far IS NULL OR top > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, seq ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM band1"
_LET["bands"] = "SELECT page_id, seq, band, min(top) AS top, max(bottom) AS bottom FROM band2 GROUP BY page_id, seq, band"
_NEEDS |= {"pt": ["lab"], "near": ["pt"], "conn": ["near"], "text": ["conn"], "band0": ["text"], "band1": ["band0"], "band2": ["band1"], "bands": ["band2"]}
_sql("e9_merged_text", ["text"], "SELECT * FROM text", recursive=True)
_sql("e10_cut_bands", ["bands"], "SELECT * FROM bands", recursive=True)
_sql(
    "e10_text_slices",
    ["bands"],
    ", n AS (SELECT t.*, coalesce(max(b.band), 0) AS bands FROM text t LEFT JOIN bands b USING (page_id, seq) GROUP BY ALL), s AS (SELECT n.*, unnest(range(bands + 1))::INT AS sub FROM n), p AS (SELECT s.page_id, s.seq, s.sub, s.bands, s.x1, s.x2, coalesce(a.bottom, s.y1) AS y1, coalesce(b.top, s.y2) AS y2 FROM s LEFT JOIN bands a ON a.page_id = s.page_id AND a.seq = s.seq AND a.band = s.sub LEFT JOIN bands b ON b.page_id = s.page_id AND b.seq = s.seq AND b.band = s.sub + 1) SELECT page_id, seq, sub, x1, y1, x2, y2 FROM p WHERE bands = 0 OR y2 - y1 >= 20",
    recursive=True,
)
_HANDLED = ("figure", "figure_caption", "isolate_formula", "formula_caption", "table", "table_caption", "table_footnote", "plain text")
_sql("e11_passed_through", ["lab"], f"SELECT page_id, label, round(conf, 6) AS conf, x1, y1, x2, y2 FROM lab WHERE label NOT IN {_list(_HANDLED)}")
_LET["ti"] = "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS rn FROM lab WHERE label = 'title'"
_LET["tp"] = "SELECT t.page_id, t.det_id AS title_id, p.det_id AS body_id, p.y1 - t.y2 AS gap FROM ti t JOIN lab p ON p.page_id = t.page_id AND p.label = 'plain text' WHERE p.y1 - t.y2 BETWEEN 0 AND 50 AND least(t.x2 - t.x1, p.x2 - p.x1) > 0 AND (least(t.x2, p.x2) - greatest(t.x1, p.x1))::DOUBLE / least(t.x2 - t.x1, p.x2 - p.x1) >= 0.5"
_LET["tfold"] = "SELECT DISTINCT page_id, 0::BIGINT AS rn, CAST([] AS INT[]) AS taken FROM ti UNION ALL SELECT f.page_id, t.rn, list_append(f.taken, coalesce((SELECT arg_min(c.body_id, c.gap * 100000 + c.body_id) FROM tp c WHERE c.page_id = t.page_id AND c.title_id = t.det_id AND NOT list_contains(f.taken, c.body_id)), 0)) FROM tfold f JOIN ti t ON t.page_id = f.page_id AND t.rn = f.rn + 1"
_NEEDS |= {"ti": ["lab"], "tp": ["ti"], "tfold": ["tp"]}
_sql("e12_title_pairs", ["tfold"], ", l AS (SELECT page_id, arg_max(taken, rn) AS taken FROM tfold GROUP BY page_id) SELECT t.page_id, t.det_id AS title_id, taken[t.rn] AS body_id FROM ti t JOIN l USING (page_id) WHERE taken[t.rn] <> 0", recursive=True)
_sql("e13_uncovered_text", ["lab"], "SELECT page_id, det_id FROM lab a WHERE label <> 'plain text' OR NOT EXISTS (SELECT 1 FROM lab b WHERE b.page_id = a.page_id AND b.label = 'plain text' AND b.det_id <> a.det_id AND a.y1 >= b.y1 - 2 AND a.y2 <= b.y2 + 2 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0.7 * (a.x2 - a.x1))")

_LET["tall"] = "SELECT page_id, word_id, x1, y1, x2, y2 FROM (SELECT *, median(y2 - y1) OVER (PARTITION BY page_id) AS m FROM word) WHERE y2 - y1 >= 0.6 * m"
_LET["edge"] = "SELECT a.page_id, a.word_id AS a, b.word_id AS b FROM tall a JOIN tall b ON a.page_id = b.page_id AND a.word_id <> b.word_id AND b.y1 + b.y2 BETWEEN 2 * a.y1 AND 2 * a.y2 AND b.x1 <= a.x2 + 2 * (a.y2 - a.y1) AND b.x2 >= a.x2"
_LET["edges"] = "SELECT page_id, a, b FROM edge UNION SELECT page_id, b, a FROM edge"
_LET["join_"] = "SELECT page_id, word_id AS a, word_id AS b FROM tall UNION SELECT j.page_id, j.a, e.b FROM join_ j JOIN edges e ON e.page_id = j.page_id AND e.a = j.b"
_LET["lcomp"] = "SELECT page_id, a AS word_id, min(b) AS component FROM join_ GROUP BY page_id, a"
_NEEDS |= {"tall": ["word"], "edge": ["tall"], "edges": ["edge"], "join_": ["edges"], "lcomp": ["join_"]}
_sql("f1_tall_words", ["tall"], "SELECT page_id, word_id FROM tall")
_sql("f2_line_edges", ["edge"], "SELECT page_id, count(*) AS n, sum(a)::BIGINT AS a_sum, sum(b)::BIGINT AS b_sum FROM edge GROUP BY page_id")
_sql("f3_line_components", ["lcomp"], "SELECT * FROM lcomp", recursive=True)
_sql("f4_text_lines", ["lcomp"], ", w AS (SELECT t.*, component, min(y1) OVER (PARTITION BY t.page_id, component) AS top FROM tall t JOIN lcomp l ON l.page_id = t.page_id AND l.word_id = t.word_id) SELECT page_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY top, component) AS INT) AS line, CAST(row_number() OVER (PARTITION BY page_id, component ORDER BY x1, word_id) AS INT) AS pos, word_id FROM w", recursive=True)
_LET["lined"] = "SELECT t.*, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY top, component) AS INT) AS line FROM (SELECT t.*, component, min(y1) OVER (PARTITION BY t.page_id, component) AS top FROM tall t JOIN lcomp l ON l.page_id = t.page_id AND l.word_id = t.word_id) t"
_LET["spans"] = "SELECT page_id, list([{'t': t, 'b': b, 'ids': [line], 'm': false}] ORDER BY line) AS g, least(30.0::DOUBLE, 0.8::DOUBLE * (arg_max(t + b, line) - arg_min(t + b, line)) / 2 / nullif(count(*) - 1, 0)) AS thr FROM (SELECT page_id, line, min(y1) AS t, max(y2) AS b FROM lined GROUP BY page_id, line) GROUP BY page_id"
_LET["passes"] = "SELECT page_id, 0 AS k, g, thr FROM spans UNION ALL SELECT page_id, k + 1, [[{'t': z.t, 'b': z.b, 'ids': z.ids, 'm': false}] FOR z IN list_reduce(g, LAMBDA a, y: CASE WHEN NOT a[-1].m AND abs((y[1].t + y[1].b) / 2 - (a[-1].t + a[-1].b) / 2) <= thr THEN list_append(a[1:len(a) - 1], {'t': least(a[-1].t, y[1].t), 'b': greatest(a[-1].b, y[1].b), 'ids': list_concat(a[-1].ids, y[1].ids), 'm': true}) ELSE list_concat(a, y) END)], thr FROM passes WHERE k < 10"
_LET["merged"] = "SELECT page_id, n AS line, unnest(ids) AS old FROM (SELECT page_id, generate_subscripts(g, 1) AS n, unnest([x[1].ids FOR x IN g]) AS ids FROM passes WHERE k = 10)"
_NEEDS |= {"lined": ["lcomp"], "spans": ["lined"], "passes": ["spans"], "merged": ["passes"]}
_sql("f5_merge_close_lines", ["merged"], "SELECT w.page_id, CAST(m.line AS INT) AS line, CAST(row_number() OVER (PARTITION BY w.page_id, m.line ORDER BY x1, w.line, w.word_id) AS INT) AS pos, w.word_id FROM lined w JOIN merged m ON m.page_id = w.page_id AND m.old = w.line", recursive=True)
_sql("g1_line_sessions", ["ses"], "SELECT page_id, word_id, line FROM ses")
_sql("g2_clamp_words", ["ses"], ", m AS (SELECT *, least(median(y2 - y1) OVER (PARTITION BY page_id, line), med) / 2 * 1.15::DOUBLE AS half, (y1 + y2) / 2 AS cy FROM ses), t AS (SELECT *, greatest(y1, CAST(trunc(cy - half) AS INT)) AS a, least(y2, CAST(trunc(cy + half) AS INT)) AS b FROM m) SELECT page_id, word_id, line, CASE WHEN b > a THEN a ELSE y1 END AS y1, CASE WHEN b > a THEN b ELSE y2 END AS y2 FROM t")
_sql("g14_paragraph_starts", ["para"], "SELECT page_id, line, x1, para_start FROM para")
_sql("g17_word_gaps", ["gaps"], "SELECT page_id, line, pos, space FROM gaps")
_FIT = "SELECT page_id, line, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n FROM {t} GROUP BY page_id, line"
_sql("g21_robust_fit", ["ses"], f", pts AS (SELECT page_id, line, (x1 + x2) / 2 AS x, y2::DOUBLE AS y FROM ses), f AS ({_FIT.format(t='pts')}), near AS (SELECT p.* FROM pts p JOIN f USING (page_id, line) WHERE abs(y - (a * x + b)) <= 3.0 + 1e-9), g AS ({_FIT.format(t='near')} HAVING count(*) >= 2) SELECT k.page_id, k.line, round(CASE WHEN isnan(a) THEN NULL ELSE a END, 6) AS slope, round(CASE WHEN isnan(b) THEN NULL ELSE b END, 6) AS intercept FROM (SELECT DISTINCT page_id, line FROM pts) k LEFT JOIN g USING (page_id, line)")


def _robust(column: str, tag: str) -> str:
    """CTEs that fit `column` of lines of four words or more, twice."""
    return f", p{tag} AS (SELECT page_id, line, x, {column}::DOUBLE AS y, 0.3 * m AS eps FROM base WHERE n >= 4), f{tag} AS ({_FIT.format(t=f'p{tag}')}), n{tag} AS (SELECT p.* FROM p{tag} p JOIN f{tag} USING (page_id, line) WHERE abs(y - (a * x + b)) <= eps + 1e-9), g{tag} AS ({_FIT.format(t=f'n{tag}')} HAVING count(*) >= 2)"


_sql(
    "g22_baselines",
    ["ses"],
    f", base AS (SELECT *, (x1 + x2) / 2 AS x, median(y2 - y1) OVER w AS m, count(*) OVER w AS n, quantile_cont(y2, 0.1) OVER w AS q2, quantile_cont(y1, 0.1) OVER w AS q1, min(y2) OVER w AS m2, min(y1) OVER w AS m1, max((x1 + x2) / 2) OVER w - min((x1 + x2) / 2) OVER w AS spread FROM ses WINDOW w AS (PARTITION BY page_id, line)){_robust('y2', 'b')}{_robust('y1', 'c')}, j AS (SELECT base.*, gb.a AS ba, gb.b AS bb, gc.a AS ca, gc.b AS cb, coalesce(NOT isnan(gb.a) AND NOT isnan(gc.a) AND abs(gb.a) * spread > 0.15 * m + 1e-9, false) AS fit, CASE WHEN base.n >= 4 THEN trunc(round(q2, 6)) ELSE m2 END AS b0, CASE WHEN base.n >= 4 THEN trunc(round(q1, 6)) ELSE m1 END AS t0 FROM base LEFT JOIN gb USING (page_id, line) LEFT JOIN gc USING (page_id, line)) SELECT page_id, line, word_id, CAST(greatest(1, CASE WHEN fit THEN round_even(round((ba * x + bb) - (ca * x + cb), 6), 0) ELSE b0 - t0 END) AS INT) AS above, CAST(greatest(0, least(CASE WHEN fit THEN round_even(round(y2 - (ba * x + bb), 6), 0) ELSE y2 - b0 END, (y2 - y1) // 2)) AS INT) AS bl FROM j",
)
_LET["lh"] = "SELECT page_id, CAST(trunc(trunc(round(quantile_cont(trunc(above * 1.5), 0.95), 6)) * 1.3::DOUBLE) AS INT) AS line_height FROM plc GROUP BY page_id"
_LET["ol"] = "SELECT page_id, out_line, bool_or(para_start) AS para_start, max(trunc(above * 1.5)) AS rise FROM plc GROUP BY page_id, out_line"
_NEEDS |= {"lh": ["plc"], "ol": ["plc"]}
_sql("g19_line_heights", ["lh", "ol"], "SELECT page_id, line_height, CAST(trunc(line_height * 0.5) AS INT) AS para_space, CAST(12 + count(*) * line_height + sum(CASE WHEN para_start AND out_line > 1 THEN 1 ELSE 0 END) * trunc(line_height * 0.5) AS INT) AS total_height FROM ol JOIN lh USING (page_id) GROUP BY page_id, line_height")
_sql(
    "g20_place_words",
    ["lh", "ol"],
    f", y AS (SELECT page_id, out_line, 5 + sum(CASE WHEN para_start AND out_line > 1 THEN trunc(line_height * 0.5) ELSE 0 END) OVER (PARTITION BY page_id ORDER BY out_line) + (row_number() OVER (PARTITION BY page_id ORDER BY out_line) - 1) * line_height + rise AS baseline FROM ol JOIN lh USING (page_id)), s AS (SELECT *, CAST(trunc((x2 - x1) * 1.5) AS INT) AS w, CAST(trunc((y2 - y1) * 1.5) AS INT) AS h FROM plc), x AS (SELECT *, CAST(10 + sum(space + w) OVER (PARTITION BY page_id, out_line ORDER BY pos) - w AS INT) AS x FROM s) SELECT page_id, out_line, pos, word_id, x, CAST(baseline - (h - trunc(bl * 1.5)) AS INT) AS y, w, h, CAST(least({PAGE_W - 10}, x + w) AS INT) AS x_end FROM x JOIN y USING (page_id, out_line)",
)
_sql("g3_main_components", ["comp"], "SELECT word_key, comp_id FROM comp WHERE w >= 2 AND h >= 2 AND area >= 4 AND h >= word_h * 0.3")
_LET["valid"] = "SELECT * FROM comp c WHERE w >= 2 AND h >= 2 AND area >= 4 AND (h >= 18 OR EXISTS (SELECT 1 FROM comp m WHERE m.word_key = c.word_key AND m.w >= 2 AND m.area >= 4 AND m.h >= 18 AND c.y < m.y + m.h + 24 AND c.y + c.h > m.y - 24 AND greatest(0, c.x - (m.x + m.w), m.x - (c.x + c.w)) < 60))"
_NEEDS["valid"] = ["comp"]
_sql("g4_valid_components", ["valid"], "SELECT word_key, comp_id FROM valid UNION ALL SELECT word_key, comp_id FROM comp c WHERE w >= 2 AND h >= 2 AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.word_key = c.word_key)")
_sql("g5_diacritics", ["comp"], "SELECT word_key, comp_id, med AS median_h, h < med * 0.4 AND w < med * 0.8 AND w * h < med * med * 0.3 AND h < 15 AND w < 100 AS is_mark FROM (SELECT *, median(h) OVER (PARTITION BY word_key) AS med FROM comp)")
_sql("g9_fragments", ["comp"], ", f AS (SELECT *, count(*) OVER (PARTITION BY word_key) AS n, w * h >= median(w * h) OVER (PARTITION BY word_key) * 0.25 OR h >= 10 AS big FROM comp) SELECT word_key, comp_id FROM (SELECT *, sum(big::INT) OVER (PARTITION BY word_key) AS stay FROM f) WHERE n <= 2 OR stay < 2 OR big")
_LET["pad"] = "SELECT word_key, comp_id, greatest(0, x - 2) AS x1, greatest(0, y - 2) AS y1, greatest(0, x - 2) + least(w + 4, 200 - greatest(0, x - 2)) AS x2, greatest(0, y - 2) + least(h + 4, 60 - greatest(0, y - 2)) AS y2 FROM comp"
_NEEDS["pad"] = ["comp"]
_sql("g10_padded_rects", ["pad"], "SELECT * FROM pad")
_sql("g12_split_point", ["pad"], "SELECT word_key, arg_max(x2 - 2, x1 * 100000 + comp_id) FILTER (x2 - 2 <= 120) AS cut FROM pad GROUP BY word_key")
_sql("g13_split_words", ["pad"], ", k AS (SELECT word_key, count(*) AS n, arg_max(x2 - 2, x1 * 100000 + comp_id) FILTER (x2 - 2 <= 100) AS cut FROM pad GROUP BY word_key) SELECT word_key, 200 AS word_w, CASE WHEN n >= 2 AND cut > 0 AND least(cut, 199) >= 30 THEN least(cut, 199) END AS cut FROM k")
_sql("g15_hyphens", ["comp"], "SELECT word_key, max(x) AS x FROM comp WHERE h >= 3 AND w * 3 >= 12 AND h <= 20 * 0.6 AND h <= 18 AND w * 3 / h >= 2.0 GROUP BY word_key")
_sql("g16_without_hyphen", ["det"], "SELECT page_id, det_id, CASE WHEN det_id % 3 = 0 THEN x2 ELSE greatest(x1 + 1, x1 + greatest(0, x2 - x1 - (x2 - x1) // 4) + det_id % 30 - 2) END AS x2 FROM det")

_LET["rg"] = f"SELECT *, CAST(row_number() OVER w AS INT) AS position, y1 - lag(y2, 1, 0) OVER w AS up, lead(y1, 1, {PAGE_H}) OVER w - y2 AS down FROM reg WINDOW w AS (PARTITION BY page_id ORDER BY y1, block_id)"
_LET["rm"] = f"SELECT page_id, coalesce(median(x2 - x1) FILTER (label IN ('plain text', 'titled_block_body')), {float(PAGE_W)}) AS median_w FROM reg GROUP BY page_id"
_LET["rl"] = "SELECT *, arg_max(CASE WHEN label NOT IN ('titled_block_title', 'abandon') THEN label END, CASE WHEN label NOT IN ('titled_block_title', 'abandon') THEN position END) OVER (PARTITION BY page_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_label FROM rg"
_NEEDS |= {"rg": ["reg"], "rm": ["reg"], "rl": ["rg"]}
_sql("h1_region_gaps", ["rg"], "SELECT page_id, block_id, position, greatest(4, CAST(trunc(up * 1.5) AS INT)) AS gap_before, greatest(4, CAST(trunc(down * 1.5) AS INT)) AS gap_after FROM rg")
_sql("h2_median_width", ["rm"], "SELECT * FROM rm")
_sql("h3_margins", [], "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 33 ELSE greatest(10, CAST(trunc(20 * (event_id % 7 / 2) / 2) AS INT)) END AS margin FROM events")
_LET["dpg"] = "SELECT doc_id, unnest(range(CAST((sum(1 + length(line) // 80) - 1) // 60 + 1 AS BIGINT))) AS k FROM tokl GROUP BY doc_id"
_LET["preg"] = "SELECT d.doc_id * 1000 + d.k AS page_id, r.* EXCLUDE (page_id) FROM dpg d JOIN reg r ON r.page_id = (d.doc_id + d.k) % (SELECT max(page_id) + 1 FROM reg)"
_LET["wr"] = "SELECT w.page_id, r.block_id, r.label, r.x2 - r.x1 AS rw, r.y2 - r.y1 AS rh, w.word_id, w.x1 - r.x1 AS x1, w.y1 - r.y1 AS y1, w.x2 - r.x1 AS x2, w.y2 - r.y1 AS y2 FROM word w JOIN preg r ON w.page_id = r.page_id WHERE w.x1 + w.x2 BETWEEN 2 * r.x1 AND 2 * r.x2 AND w.y1 + w.y2 BETWEEN 2 * r.y1 AND 2 * r.y2"
_NEEDS |= {"dpg": ["tokl"], "preg": ["dpg", "reg"], "wr": ["word", "preg"]}
_sql("h4_words_in_regions", ["wr"], "SELECT page_id, block_id, word_id, x1, y1, x2, y2 FROM wr")
_sql("h5_padded_words", ["wr"], ", p AS (SELECT *, CASE WHEN label = 'title' THEN 35 ELSE 5 END AS g, count(*) OVER (PARTITION BY page_id, block_id) AS n FROM wr), q AS (SELECT page_id, block_id, label, n, rw, rh, word_id, greatest(0, x1 - g) AS x1, greatest(0, y1 - g) AS y1, least(rw, x2 + g) AS x2, least(rh, y2 + g) AS y2 FROM p) SELECT page_id, block_id, word_id, x1, y1, x2, y2 FROM q WHERE label <> 'title' OR n = 1 UNION ALL SELECT page_id, block_id, min(word_id), greatest(0, min(x1) - 20), greatest(0, min(y1) - 20), least(rw, max(x2) + 20), least(rh, max(y2) + 20) FROM q WHERE label = 'title' AND n > 1 GROUP BY page_id, block_id, rw, rh")
_CAPPED = f"label IN {_list((*TEXT_LABELS, 'titled_block_title'))} AND coalesce(last_label IN {_list(NON_TEXT_LABELS)}, false)"
_sql("h7_last_placed", ["rl"], f"SELECT page_id, block_id, last_label, CASE WHEN {_CAPPED} THEN least(greatest(4, CAST(trunc(up * 0.2::DOUBLE) AS INT)), 10) ELSE greatest(4, CAST(trunc(up * 0.2::DOUBLE) AS INT)) END AS gap_before FROM rl")
_sql("h9_narrow_blocks", ["rm"], "SELECT page_id, block_id, label IN ('plain text', 'titled_block_body') AND x2 - x1 < median_w * 0.9 AS is_narrow FROM reg JOIN rm USING (page_id)")
_sql(
    "h10_work_units",
    ["rl", "rm"],
    f", a AS (SELECT page_id, block_id, label, position, CASE WHEN {_CAPPED} THEN least(greatest(4, CAST(trunc(up * 1.5) AS INT)), 75) ELSE greatest(4, CAST(trunc(up * 1.5) AS INT)) END AS gb, greatest(4, CAST(trunc(up * 1.5) AS INT)) AS bg, greatest(4, CAST(trunc(down * 1.5) AS INT)) AS ga, label IN ('plain text', 'titled_block_body') AND x2 - x1 < median_w * 0.65 AS narrow FROM rl JOIN rm USING (page_id) WHERE label <> 'abandon'), b AS (SELECT *, lag(label) OVER w = 'titled_block_title' AS waits, lag(block_id) OVER w AS tid, lag(gb) OVER w AS tgb FROM a WINDOW w AS (PARTITION BY page_id ORDER BY position)), c AS (SELECT *, label = 'titled_block_body' AND coalesce(waits, false) AS takes, label NOT IN {_list(TEXT_LABELS)} OR narrow AS image FROM b WHERE label <> 'titled_block_title'), u AS (SELECT page_id, position, 0 AS i, 'title' AS kind, tid AS block_id, CAST(NULL AS INT) AS title_id, tgb AS gap_before, bg AS gap_after FROM c WHERE takes AND NOT image UNION ALL SELECT page_id, position, 1, CASE WHEN image AND takes THEN 'titled image' WHEN image THEN 'image' ELSE 'text' END, block_id, CASE WHEN image AND takes THEN tid END, CASE WHEN takes AND image THEN tgb WHEN takes THEN bg ELSE gb END, ga FROM c) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position, i) AS INT) AS unit, kind, block_id, title_id, gap_before, gap_after FROM u",
)
_sql("h11_mask_rects", ["reg"], f"SELECT t.page_id, t.block_id, greatest(t.x1, o.x1) - t.x1 AS x1, greatest(t.y1, o.y1) - t.y1 AS y1, least(t.x2, o.x2) - t.x1 AS x2, least(t.y2, o.y2) - t.y1 AS y2 FROM reg t JOIN reg o ON o.page_id = t.page_id AND o.label NOT IN {_list(TEXT_LABELS)} WHERE t.label IN {_list(TEXT_LABELS)} AND {_meets('t.', 'o.')}")
_sql("h12_stacked_units", ["rg"], ", u AS (SELECT page_id, position AS unit, greatest(4, CAST(trunc(up * 1.5) AS INT)) AS gb, greatest(4, CAST(trunc(down * 1.5) AS INT)) AS ga, y2 - y1 AS h FROM rg WHERE block_id % 6 <> 0), y AS (SELECT *, sum(gb + h) OVER (PARTITION BY page_id ORDER BY unit) - h AS y FROM u) SELECT page_id, unit, y::BIGINT AS y, arg_max(y + h + ga, unit) OVER (PARTITION BY page_id)::BIGINT AS page_height FROM y")
_sql("h13_base_zoom", ["word"], "SELECT page_id, round(greatest(0.1, 840.0 / (coalesce(median(x2 - x1) FILTER (x2 > x1), 50.0) * 4)) * 1.2::DOUBLE ** (page_id % 4 - 1), 6) AS zoom FROM word GROUP BY page_id")
_sql("h14_font_scale", [], "SELECT event_id, greatest(0.5, round(1 + 0.1 * (event_id % 21 - 10), 2))::DOUBLE AS scale FROM events")


def _correlation(line: str, along: str, d: int = 2) -> str:
    return f", s AS (SELECT unnest(range(-2, 3)) AS s), p AS (SELECT a.vec_id, s.s, a.{line} AS l, CASE WHEN stddev_pop(a.z) <= 1e-10 OR stddev_pop(b.z) <= 1e-10 THEN NULL ELSE corr(a.z, b.z) * count(*) END AS v FROM grid a JOIN s ON true JOIN grid b ON b.vec_id = a.vec_id AND b.{line} = a.{line} + {d} AND b.{along} = a.{along} + s.s GROUP BY a.vec_id, s.s, a.{line})"


_sql("i1_vertical_correlation", ["grid"], f"{_correlation('c', 'r')} SELECT vec_id, s::INT AS s, round(coalesce(avg(v), 0), 6) AS value FROM p GROUP BY vec_id, s")
_sql("i2_horizontal_correlation", ["grid"], f"{_correlation('r', 'c')} SELECT vec_id, s::INT AS s, round(coalesce(avg(v), 0), 6) AS value FROM p GROUP BY vec_id, s")


def _region_angles() -> str:
    """I5 on the grids: distance 2, second distance 3, shifts -2..2."""
    parts = ["s AS (SELECT unnest(range(-2, 3)) AS s)"]
    for tag, line, along in (("v", "c", "r"), ("h", "r", "c")):
        for d in (2, 3):
            t = f"{tag}{d}"
            parts += [
                f"p{t} AS (SELECT a.vec_id, s.s, CASE WHEN stddev_pop(a.z) <= 1e-10 OR stddev_pop(b.z) <= 1e-10 THEN NULL ELSE corr(a.z, b.z) * count(*) END AS v FROM grid a JOIN s ON true JOIN grid b ON b.vec_id = a.vec_id AND b.{line} = a.{line} + {d} AND b.{along} = a.{along} + s.s GROUP BY a.vec_id, s.s, a.{line})",
                f"r{t} AS (SELECT vec_id, s, coalesce(avg(v), 0) AS value FROM p{t} GROUP BY vec_id, s)",
                f"w{t} AS (SELECT *, value - lag(value) OVER w AS step, value > lag(value) OVER w AND value > lead(value) OVER w AS top FROM r{t} WINDOW w AS (PARTITION BY vec_id ORDER BY s))",
                f"k{t} AS (SELECT vec_id, sum(abs(step)) AS tv, count(*) FILTER (top) AS n, coalesce(arg_max(s, value) FILTER (top), arg_max(s, value)) AS s FROM w{t} GROUP BY vec_id)",
            ]
    pick = lambda c, d: f"CASE WHEN kv2.tv >= kh2.tv THEN kv{d}.{c} ELSE kh{d}.{c} END"
    body = f"SELECT kv2.vec_id, greatest(kv2.tv, kh2.tv) < 10 AS flat, {pick('n', 2)} AS n, degrees(atan(({pick('s', 2)}) / 2)) AS a, degrees(atan(({pick('s', 3)}) / 3)) AS b FROM kv2 JOIN kh2 USING (vec_id) JOIN kv3 USING (vec_id) JOIN kh3 USING (vec_id)"
    return ", " + ", ".join(parts) + f", j AS ({body}) SELECT vec_id, round(CASE WHEN flat THEN NULL WHEN n > 1 AND abs(a - b) < 1 THEN (a + b) / 2 ELSE a END, 6) AS angle FROM j"


_sql("i5_region_angles", ["grid"], _region_angles())
_sql("i3_total_variation", ["grid"], "SELECT vec_id, round(sum(abs(d)), 6) AS tv FROM (SELECT vec_id, z - lag(z) OVER (PARTITION BY vec_id ORDER BY r, c) AS d FROM grid) GROUP BY vec_id")
_sql("i4_peaks", ["grid"], ", s AS (SELECT vec_id, r * 8 + c AS s, z, z > lag(z) OVER w AND z > lead(z) OVER w AS top FROM grid WINDOW w AS (PARTITION BY vec_id ORDER BY r, c)), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, s) AS first_, bool_or(coalesce(top, false)) OVER (PARTITION BY vec_id) AS any_ FROM s) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, s) AS INT) AS rank, s, round(z, 6) AS value FROM t WHERE coalesce(top, false) OR (NOT any_ AND first_ = 1)")
_LET["ra"] = "SELECT region_set, angle, avg(angle) OVER w AS m, stddev_pop(angle) OVER w AS s, count(*) OVER w AS n FROM ang WINDOW w AS (PARTITION BY region_set)"
_LET["rob"] = "SELECT region_set, max(n) AS n, CASE WHEN max(n) < 5 OR stddev_pop(angle) FILTER (s = 0 OR abs(angle - m) <= 2 * s + 1e-12) > 0.9 THEN 0.0 ELSE median(angle) FILTER (s = 0 OR abs(angle - m) <= 2 * s + 1e-12) END AS angle FROM ra GROUP BY region_set"
_NEEDS |= {"ra": ["ang"], "rob": ["ra"]}
_sql("i7_robust_angle", ["rob"], "SELECT region_set, n, round(angle, 6) AS angle FROM rob")
_sql("i8_median_angle", ["ang"], "SELECT region_set, count(*) AS n, round(median(angle), 6) AS angle FROM ang GROUP BY region_set")
_sql("i9_turned", ["rob"], "SELECT region_set, n, round(angle, 6) AS angle FROM rob WHERE abs(angle) > 0.1")


def _ctc(vocabulary: str, blank: int) -> str:
    return f", b AS (SELECT vec_id, r, arg_max(c, z * 1000 - c * 1e-9) AS k FROM grid GROUP BY vec_id, r), q AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY r) AS before FROM b) SELECT vec_id, coalesce(string_agg({vocabulary}[k + 1], '' ORDER BY r) FILTER (k <> {blank} AND (before IS NULL OR k <> before) AND k < len({vocabulary})), '') AS text FROM q GROUP BY vec_id"


_sql("j1_ctc_last_blank", ["grid"], _ctc("['a','b','c','d','e','f','g']", 7))
_sql("j2_ctc_first_blank", ["grid"], _ctc("['','a','b','c','d','e','f',' ']", 0))
_sql("j3_sample_pages", [], "WITH b AS (SELECT source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_no, count(*) OVER (PARTITION BY source) AS n FROM documents), r AS (SELECT *, greatest(0, n // 2 - greatest(1, n // 4)) AS lo, least(n, n // 2 + greatest(1, n // 4)) AS hi FROM b), s AS (SELECT *, greatest(1, (hi - lo) // 3) AS step FROM r) SELECT book, page_no FROM s WHERE page_no >= lo AND page_no < hi AND (page_no - lo) % step = 0 AND (page_no - lo) // step < 3")
_sql("j4_sample_words", ["word"], ", n AS (SELECT page_id, word_id, row_number() OVER (PARTITION BY page_id ORDER BY word_id) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM word), r AS (SELECT *, CASE WHEN n * 3 // 4 > n // 4 THEN n // 4 ELSE 0 END AS lo, CASE WHEN n * 3 // 4 > n // 4 THEN n * 3 // 4 ELSE n END AS hi FROM n), s AS (SELECT *, greatest(1, (hi - lo) // 20) AS step FROM r) SELECT page_id, word_id FROM s WHERE i >= lo AND i < hi AND (i - lo) % step = 0 AND (i - lo) // step < 20")
_sql("j5_clamped_crops", ["det"], "SELECT * FROM (SELECT page_id, det_id, greatest(0, x1 - 20) AS x1, greatest(0, y1 - 20) AS y1, least(600, x2) AS x2, least(900, y2) AS y2 FROM det) WHERE x2 > x1 AND y2 > y1")
_sql("j6_joined_text", ["tokl"], "SELECT doc_id, coalesce(string_agg(trim(line), ' ' ORDER BY ln) FILTER (length(trim(line)) > 0), '') AS text FROM tokl GROUP BY doc_id")
_LET["pd"] = "SELECT doc_id, lang, string_split(' ' || lower(regexp_replace(text, '\\s+', ' ', 'g')) || ' ', '') AS ch FROM documents"
_LET["tri"] = "SELECT doc_id, lang, unnest([ch[i] || coalesce(ch[i + 1], '') || coalesce(ch[i + 2], '') FOR i IN range(1, greatest(2, len(ch) - 1))]) AS gram FROM pd"
_LET["prof"] = "SELECT lang, gram, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS INT) AS rank FROM tri GROUP BY lang, gram QUALIFY rank <= 300"
_NEEDS |= {"tri": ["pd"], "prof": ["tri"]}
_sql("j7_language_profiles", ["prof"], "SELECT lang, gram, rank FROM prof")
_sql("j7_classified", ["prof"], ", own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS mine FROM tri GROUP BY doc_id, gram QUALIFY mine <= 300), s AS (SELECT doc_id, count(*) AS grams FROM own GROUP BY doc_id), d AS (SELECT o.doc_id, p.lang, sum(abs(mine - rank) - 300) AS saved FROM own o JOIN prof p ON p.gram = o.gram GROUP BY o.doc_id, p.lang), b AS (SELECT doc_id, lang, saved, row_number() OVER (PARTITION BY doc_id ORDER BY saved, lang) AS n FROM d) SELECT s.doc_id, coalesce(b.lang, 'en') AS lang, CAST(grams * 300 + coalesce(saved, 0) AS BIGINT) AS distance FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND b.n = 1")
_sql("j8_confidence", [], f"SELECT event_id, CASE iso WHEN 'no' THEN 'nb' ELSE CASE WHEN iso IN {_list(LANGUAGES)} THEN iso ELSE 'en' END END AS app_lang, round(greatest(0.0, least(1.0, 1 - value * 7 / 500)), 6) AS confidence FROM (SELECT *, ['en', 'no', 'xx', 'fr'][event_id % 4 + 1] AS iso FROM events)")
_sql("a1_render_size", ["raw"], "SELECT DISTINCT page_id, CAST(trunc(img_w * 150 / CASE WHEN page_id % 2 = 0 THEN 72 ELSE 300 END) AS INT) AS w, CAST(trunc(img_h * 150 / CASE WHEN page_id % 2 = 0 THEN 72 ELSE 300 END) AS INT) AS h FROM raw")
_sql("a3_documents", [], "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'djvu' END AS kind, unnest(range(page_id % 4)) AS page_no FROM pages WHERE page_id % 5 IN (0, 1, 2)")
_sql("a6_content_type", [], "SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'image/jpeg' ELSE 'image/png' END AS content_type FROM pages")
_sql("a9_health", [], "SELECT event_id, event_id % 10 <> 0 AND coalesce(json_extract_string(props, '$.k') = '3', false) AS healthy FROM events")
_ANSWERED = "FROM lab WHERE page_id % 7 <> 0"
_sql("a10_answered_blocks", ["lab"], f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS INT) AS det_id, CASE WHEN det_id % 5 = 0 THEN 'sidebar' ELSE label END AS label, CASE WHEN det_id % 5 = 0 THEN 1 ELSE class_id END AS class_id, 1.0::DOUBLE AS conf, x1, y1, x2, y2 {_ANSWERED}")
_sql("a10_answered_words", ["lab"], f", w AS (SELECT *, row_number() OVER (PARTITION BY page_id, CASE WHEN page_id % 2 = 0 THEN det_id ELSE 0 END, x1, y1, x2, y2 ORDER BY det_id) AS copy {_ANSWERED}) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS INT) AS word_id, x1, y1, x2, y2 FROM w WHERE copy = 1")
_sql("a12_manifest_gaps", [], "WITH f AS (SELECT url AS name, max(length(html)) AS size, max(page_id) AS page_id FROM pages GROUP BY url) SELECT name, size, CASE WHEN page_id % 3 <> 0 THEN size + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END END AS found FROM f WHERE page_id % 3 = 0 OR page_id % 4 = 0")
_sql("a13_settings", [], "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")


# requests to a remote analyser
_sql("a4_page_address", [], "SELECT page_id, 'http://localhost:8000/page?page_width=' || (1000 + page_id % 3 * 500) || '&zoom_factor=2.5&bin=' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END || '&toc_algorithm=layoutlm' || CASE page_id % 4 WHEN 0 THEN '&lang=en' WHEN 1 THEN '&lang=zh-Hans' ELSE '' END AS url FROM pages")
_sql("a6_multipart", [], f"WITH f AS (SELECT *, ['JPG', 'jpeg', 'png', ''][page_id % 4 + 1] AS e FROM pages), b AS (SELECT page_id, '--{BOUNDARY}' || chr(13) || chr(10) || 'Content-Disposition: form-data; name=\"image\"; filename=\"p' || page_id || CASE WHEN e = '' THEN '' ELSE '.' || e END || '\"' || chr(13) || chr(10) || 'Content-Type: image/' || CASE WHEN lower(e) IN ('jpg', 'jpeg') THEN 'jpeg' ELSE 'png' END || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || '--{BOUNDARY}--' || chr(13) || chr(10) AS body FROM f) SELECT page_id, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size FROM b")
_sql("a7_ocr_address", [], "SELECT page_id, 'http://localhost:8000/ocr_page?no_pix2tex=' || CASE WHEN page_id % 2 = 1 THEN 'true' ELSE 'false' END || '&cache_key=' || CASE WHEN page_id % 3 <> 0 THEN 'k' || page_id ELSE '' END AS url FROM pages")
_sql("a8_stream_tickets", [], "SELECT event_id, CASE WHEN whole THEN '/stream/' || event_id END AS stream_url, CASE WHEN whole THEN 't' || event_id END AS token, NOT whole AS missing FROM (SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS whole FROM events)")
_sql("a13_saved_settings", [], "SELECT event_id, '{\"page\":' || user_id || CASE WHEN event_id % 3 <> 0 THEN ',\"lang\":\"' || event_type || '\"' ELSE '' END || '}' AS text FROM events")
_LET["ink"] = "SELECT vec_id AS map_id, r, c, r * 8 + c AS k FROM grid WHERE z >= 0 OR vec_id IN (SELECT vec_id FROM grid GROUP BY vec_id HAVING max(z) < 0)"
_LET["spill"] = "SELECT map_id, k, k AS o FROM ink UNION SELECT f.map_id, f.k, b.k FROM spill f JOIN ink a ON a.map_id = f.map_id AND a.k = f.o JOIN ink b ON b.map_id = a.map_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"
_NEEDS |= {"ink": ["grid"], "spill": ["ink"]}
_sql("b10_ink_components", ["spill"], ", s AS (SELECT map_id, k, min(o) AS root FROM spill GROUP BY map_id, k) SELECT map_id AS vec_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY root) AS INT) AS comp_id, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, CAST(count(*) AS INT) AS area FROM s JOIN ink USING (map_id, k) GROUP BY map_id, root", recursive=True)


# packing: what each word knows, a fold over the words of a page, and lines from where they begin
_LET["pw0"] = "SELECT s.*, p.para_start, row_number() OVER w AS rn, lag(s.x2) OVER w AS before, lag(s.line) OVER w IS DISTINCT FROM s.line AS first, coalesce(lag(s.word_id % 17 = 0) OVER w, false) AS joined, avg(s.x2 - s.x1) OVER (PARTITION BY s.page_id) AS mean_w FROM ses s JOIN para p ON p.page_id = s.page_id AND p.line = s.line WINDOW w AS (PARTITION BY s.page_id ORDER BY s.line, s.x1, s.word_id)"
_LET["pw"] = "SELECT page_id, rn, word_id, x1, x2, x2 - x1 AS px, CAST(trunc((x2 - x1) * 1.5::DOUBLE) AS INT) AS size, CAST(CASE WHEN first THEN CASE WHEN joined THEN 0 ELSE avg_space END WHEN x1 > before THEN trunc((x1 - before) * 1.5::DOUBLE) WHEN x1 - before >= -10 THEN greatest(1, floor((x1 - before + 10) * 1.5::DOUBLE / 2)) ELSE avg_space END AS INT) AS gap, CAST(CASE WHEN first AND para_start THEN trunc(mean_w * 1.5 * 0.5) ELSE 0 END AS INT) AS indent, first AND para_start AS mark, CAST(greatest(4, round_even(greatest(4, trunc((y2 - y1) * 1.5::DOUBLE)) * 0.35::DOUBLE, 0)) AS INT) + 4 AS hyphen FROM pw0 JOIN gapm USING (page_id)"
# the last letter end (8, 18, ... up to the word's width) within the room, if the word can be cut there
_ROOM = "(640 - p.indent - CASE WHEN p.rn = 1 THEN 0 ELSE f.used + p.gap END)"
_AT = f"least(8 + 10 * CAST(floor((least(floor({_ROOM} / 1.5::DOUBLE), p.px) - 8) / 10) AS INT), p.px - 1)"
_FATE = f"CASE WHEN p.size <= {_ROOM} THEN 0 WHEN {_ROOM} >= 12 AND p.px >= 18 AND {_AT} >= greatest(10, CAST(trunc(p.px * 0.15::DOUBLE) AS INT)) THEN 2 WHEN p.rn > 1 THEN 1 ELSE 0 END"
_LET["pf"] = f"SELECT DISTINCT page_id, 0::BIGINT AS rn, 0 AS used, 0 AS fate, 0 AS cut FROM pw UNION ALL SELECT page_id, rn, CASE fate WHEN 2 THEN CAST(trunc((px - cut) * 1.5::DOUBLE) AS INT) WHEN 1 THEN size ELSE size + CASE WHEN rn = 1 THEN indent ELSE used + gap END END, fate, cut FROM (SELECT p.page_id, p.rn, p.px, p.size, p.gap, p.indent, f.used, {_FATE} AS fate, {_AT} AS cut FROM pf f JOIN pw p ON p.page_id = f.page_id AND p.rn = f.rn + 1)"
_NEEDS |= {"pw0": ["ses", "para"], "pw": ["pw0", "gapm"], "pf": ["pw"]}
_sql("g18_pack_lines", ["pf"], ", d AS (SELECT p.*, f.fate, f.cut, half FROM pw p JOIN pf f ON f.page_id = p.page_id AND f.rn = p.rn, (VALUES (1), (2)) h(half) WHERE half = 1 OR fate = 2), l AS (SELECT *, CASE WHEN half = 2 OR fate = 1 OR rn = 1 THEN 1 ELSE 0 END AS fresh FROM d), n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page_id ORDER BY rn, half ROWS UNBOUNDED PRECEDING) AS INT) AS out_line FROM l), m AS (SELECT page_id, out_line - 1 AS out_line, true AS para_start FROM n WHERE fate = 1 AND mark) SELECT n.page_id, n.out_line, CAST(row_number() OVER (PARTITION BY n.page_id, n.out_line ORDER BY rn, half) AS INT) AS pos, word_id, CASE WHEN half = 2 THEN x1 + cut ELSE x1 END AS x1, CASE WHEN half = 1 AND fate = 2 THEN x1 + cut ELSE x2 END AS x2, CASE WHEN half = 2 OR fate = 1 THEN 0 WHEN rn = 1 THEN indent ELSE gap END AS space, CASE WHEN half = 1 AND fate = 2 THEN hyphen ELSE 0 END AS hyphen_w, coalesce(m.para_start, false) AS para_start FROM n LEFT JOIN m ON m.page_id = n.page_id AND m.out_line = n.out_line", recursive=True)


# letters: strokes are joined letter by letter, then marks mark by mark; both folds carry the numbers that are taken
_LET["mk"] = "SELECT *, median(h) OVER (PARTITION BY word_key) AS m FROM (SELECT * FROM valid UNION ALL SELECT * FROM comp c WHERE w >= 2 AND h >= 2 AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.word_key = c.word_key))"
_LET["mk2"] = "SELECT word_key, comp_id, x, y, w, h, m, h < m * 0.4 AND w < m * 0.8 AND w * h < m * m * 0.3 AND h < 15 AND w < 100 AS is_mark FROM mk"
_LET["lt"] = "SELECT *, row_number() OVER (PARTITION BY word_key ORDER BY comp_id) AS rn FROM mk2 WHERE NOT is_mark"
_LET["lk"] = "SELECT a.word_key, a.comp_id AS a, b.comp_id AS b FROM lt a JOIN lt b ON b.word_key = a.word_key AND b.comp_id <> a.comp_id WHERE greatest(0, a.x - (b.x + b.w), b.x - (a.x + a.w)) < a.m * 0.3 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > least(a.h, b.h) * 0.5 AND greatest(a.h, b.h) / greatest(least(a.h, b.h), 1) < 1.5"
_LET["lg"] = "SELECT l.*, coalesce(k.own, CAST([] AS INT[])) AS own FROM lt l LEFT JOIN (SELECT word_key, a, list(b) AS own FROM lk GROUP BY word_key, a) k ON k.word_key = l.word_key AND k.a = l.comp_id"
_LET["sf"] = "SELECT DISTINCT word_key, 0::BIGINT AS rn, CAST([] AS INT[]) AS taken, CAST([] AS INT[]) AS grp FROM lg UNION ALL SELECT word_key, rn, list_concat(taken, grp), grp FROM (SELECT l.word_key, l.rn, f.taken, CASE WHEN list_contains(f.taken, l.comp_id) THEN [] ELSE list_prepend(l.comp_id, list_filter(l.own, LAMBDA j: NOT list_contains(f.taken, j))) END AS grp FROM sf f JOIN lg l ON l.word_key = f.word_key AND l.rn = f.rn + 1)"
_LET["sd"] = "SELECT g.word_key, g.id, min(c.x) AS x, min(c.y) AS y, max(c.x + c.w) - min(c.x) AS w, max(c.y + c.h) - min(c.y) AS h FROM (SELECT word_key, grp[1] AS id, unnest(grp) AS j FROM sf WHERE len(grp) > 0) g JOIN mk2 c ON c.word_key = g.word_key AND c.comp_id = g.j GROUP BY g.word_key, g.id"
_LET["mt"] = "SELECT k.*, row_number() OVER (PARTITION BY k.word_key ORDER BY k.comp_id) AS rn, coalesce(o.own, CAST([] AS INT[])) AS own FROM mk2 k LEFT JOIN (SELECT a.word_key, a.comp_id, list(s.id) AS own FROM mk2 a JOIN sd s ON s.word_key = a.word_key WHERE a.is_mark AND least(a.x + a.w, s.x + s.w) > greatest(a.x, s.x) AND abs(a.x + a.w / 2 - (s.x + s.w / 2)) < s.w * 0.5 AND s.y - (a.y + a.h) < a.m AND a.y + a.h <= s.y + s.h GROUP BY a.word_key, a.comp_id) o ON o.word_key = k.word_key AND o.comp_id = k.comp_id WHERE k.is_mark"
_LET["mf"] = "SELECT DISTINCT word_key, 0::BIGINT AS rn, CAST([] AS INT[]) AS used, CAST([] AS INT[]) AS grp FROM mt UNION ALL SELECT word_key, rn, list_concat(used, grp), grp FROM (SELECT t.word_key, t.rn, f.used, CASE WHEN len(list_filter(t.own, LAMBDA j: NOT list_contains(f.used, j))) = 0 THEN [] ELSE list_prepend(t.comp_id, list_filter(t.own, LAMBDA j: NOT list_contains(f.used, j))) END AS grp FROM mf f JOIN mt t ON t.word_key = f.word_key AND t.rn = f.rn + 1)"
_LET["mu"] = "SELECT word_key, unnest(grp) AS id FROM mf"
_LET["mm"] = "SELECT g.word_key, g.id, min(b.x) AS x, min(b.y) AS y, max(b.x + b.w) - min(b.x) AS w, max(b.y + b.h) - min(b.y) AS h FROM (SELECT word_key, grp[1] AS id, unnest(grp) AS j, generate_subscripts(grp, 1) = 1 AS own FROM mf WHERE len(grp) > 0) g JOIN (SELECT word_key, comp_id AS id, x, y, w, h, true AS own FROM mk2 UNION ALL SELECT word_key, id, x, y, w, h, false FROM sd) b ON b.word_key = g.word_key AND b.id = g.j AND b.own = g.own GROUP BY g.word_key, g.id"
_LET["le0"] = "SELECT 1 AS part, * FROM mm UNION ALL SELECT 2, * FROM sd s WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.word_key = s.word_key AND mu.id = s.id) UNION ALL SELECT 3, word_key, comp_id, x, y, w, h FROM mk2 c WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.word_key = c.word_key AND mu.id = c.comp_id) AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.word_key = c.word_key AND sd.id = c.comp_id)"
_LET["le1"] = "SELECT l.word_key, CAST(row_number() OVER (PARTITION BY l.word_key ORDER BY part, id) - 1 AS INT) AS letter, x, y, w, h, k.m, count(*) OVER (PARTITION BY l.word_key) AS n, median(w * h) OVER (PARTITION BY l.word_key) AS a FROM le0 l JOIN (SELECT DISTINCT word_key, m FROM mk) k USING (word_key)"
_LET["le2"] = "SELECT *, w * h >= a * 0.25 OR h >= m * 0.5 AS big, sum((w * h >= a * 0.25 OR h >= m * 0.5)::INT) OVER (PARTITION BY word_key) AS stay FROM le1"
_LET["le"] = "SELECT word_key, letter, x, y, w, h FROM le2 WHERE n <= 2 OR stay < 2 OR big"
_NEEDS |= {"mk": ["comp", "valid"], "mk2": ["mk"], "lt": ["mk2"], "lk": ["lt"], "lg": ["lt", "lk"], "sf": ["lg"], "sd": ["sf", "mk2"], "mt": ["mk2", "sd"], "mf": ["mt"], "mu": ["mf"], "mm": ["mf", "mk2", "sd"], "le0": ["mm", "sd", "mu", "mk2"], "le1": ["le0", "mk"], "le2": ["le1"], "le": ["le2"]}
_sql("g8_letter_boxes", ["le"], "SELECT * FROM le", recursive=True)
_sql("g10_letter_rects", ["le"], ", p AS (SELECT word_key, letter, greatest(0, x - 2) AS x1, greatest(0, y - 2) AS y1, greatest(0, x - 2) + least(w + 4, 200 - greatest(0, x - 2)) AS x2, greatest(0, y - 2) + least(h + 4, 60 - greatest(0, y - 2)) AS y2 FROM le) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.word_key = a.word_key AND b.letter <> a.letter AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2 AND (b.letter > a.letter OR b.x1 < a.x1 OR b.y1 < a.y1 OR b.x2 > a.x2 OR b.y2 > a.y2))", recursive=True)


def _digest(n: int) -> str:
    return f"md5('0:{n}:' || page_id || ':' || x1 || ':' || y1 || ':' || attempt)"


def _place(n: int, room: str) -> str:
    return f"CAST('0x' || substr({_digest(n)}, 1, 12) AS BIGINT) % greatest(1, {room})"


_sql("i6_sampled_regions", ["lab"], f", b AS (SELECT page_id, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h, unnest(range(1, 201)) AS attempt FROM lab WHERE label = 'plain text' AND x2 - x1 > 50 AND y2 - y1 > 50), t AS (SELECT *, w < 150 OR h < 150 AS small FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {_digest(2)}, x1, y1, attempt) AS region FROM t WHERE NOT small OR attempt = 1), p AS (SELECT *, CASE WHEN small THEN x1 ELSE greatest(0, least(x1 + {_place(0, 'w - 149')}, {PAGE_W - 150})) END AS px, CASE WHEN small THEN y1 ELSE greatest(0, least(y1 + {_place(1, 'h - 149')}, {PAGE_H - 150})) END AS py FROM k WHERE region <= 20) SELECT page_id, CAST(region AS INT) AS region, CAST(px AS INT) AS x1, CAST(py AS INT) AS y1, CAST(CASE WHEN small THEN x2 ELSE px + 150 END AS INT) AS x2, CAST(CASE WHEN small THEN y2 ELSE py + 150 END AS INT) AS y2 FROM p")


# all of a page's blocks: the steps' CTEs over the kept and grown detections, then titles and covered texts over what they made
_DET = "SELECT l.page_id, l.det_id, l.class_id, l.conf, l.label, CASE WHEN plain THEN greatest(0, x1 - 5) ELSE x1 END AS x1, CASE WHEN plain THEN greatest(0, y1 - 5) ELSE y1 END AS y1, CASE WHEN plain THEN least({w}, x2 + 5) ELSE x2 END AS x2, CASE WHEN plain THEN least({h}, y2 + 5) ELSE y2 END AS y2 FROM (SELECT *, label = 'plain text' AS plain FROM lab0) l JOIN nmsk k ON k.page_id = l.page_id AND k.det_id = l.det_id"
_ALONE = "SELECT page_id, {step} AS step, det_id AS seq, label, conf, x1, y1, x2, y2 FROM lab l WHERE label = '{label}' AND NOT EXISTS (SELECT 1 FROM {pairs} p WHERE p.page_id = l.page_id AND p.{column} = l.det_id)"
_PAIRED = "SELECT p.page_id, {step} AS step, p.caption_id AS seq, '{label}' AS label, greatest(a.conf, b.conf) AS conf, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 FROM {pairs} p JOIN lab a ON a.page_id = p.page_id AND a.det_id = p.caption_id JOIN lab b ON b.page_id = p.page_id AND b.det_id = p.target_id"


def _blocks_oracle() -> str:
    steps = []
    for step, label, caption, pairs in ((1, "figure", "figure_caption", "pairsf"), (4, "isolate_formula", "formula_caption", "pairsi")):
        steps.append(_PAIRED.format(step=step, label=f"{label}_and_caption", pairs=pairs))
        steps.append(_ALONE.format(step=step + 1, label=label, pairs=pairs, column="target_id"))
        steps.append(_ALONE.format(step=step + 2, label=caption, pairs=pairs, column="caption_id"))
    groups = "SELECT page_id, det_id AS table_id, det_id FROM lab WHERE label = 'table' UNION ALL SELECT page_id, target_id, caption_id FROM pairst UNION ALL SELECT page_id, table_id, footnote_id FROM notes"
    steps.append(f"SELECT m.page_id, 7 AS step, m.table_id AS seq, CASE WHEN count(*) > 1 THEN 'table_and_caption' ELSE 'table' END AS label, max(conf) AS conf, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({groups}) m JOIN lab l ON l.page_id = m.page_id AND l.det_id = m.det_id GROUP BY m.page_id, m.table_id")
    steps.append(_ALONE.format(step=8, label="table_caption", pairs="pairst", column="caption_id"))
    steps.append(_ALONE.format(step=9, label="table_footnote", pairs="notes", column="footnote_id"))
    own = dict(_LET)
    needs = dict(_NEEDS)
    own["lab0"], needs["lab0"] = own["lab"], ["det"]
    own["lab"], needs["lab"] = _DET.format(w=PAGE_W, h=PAGE_H), ["lab0", "nmsk"]
    own["made"], needs["made"] = " UNION ALL ".join(steps), ["pairsf", "pairsi", "pairst", "notes"]
    own["regs"], needs["regs"] = "SELECT page_id, x1, y1, x2, y2 FROM made UNION ALL SELECT page_id, x1, y1, x2, y2 FROM lab WHERE label <> 'plain text'", ["made"]
    own["band0"], needs["band0"] = own["band0"].replace("JOIN lab r ON r.page_id = t.page_id AND r.label <> 'plain text'", "JOIN regs r ON r.page_id = t.page_id"), ["text", "regs"]
    own["cut0"], needs["cut0"] = "SELECT t.*, coalesce(max(b.band), 0) AS bands FROM text t LEFT JOIN bands b USING (page_id, seq) GROUP BY ALL", ["bands"]
    own["cut1"], needs["cut1"] = "SELECT *, unnest(range(bands + 1))::INT AS sub FROM cut0", ["cut0"]
    own["cut2"], needs["cut2"] = "SELECT s.page_id, s.seq, s.sub, s.bands, s.x1, coalesce(a.bottom, s.y1) AS y1, s.x2, coalesce(b.top, s.y2) AS y2 FROM cut1 s LEFT JOIN bands a ON a.page_id = s.page_id AND a.seq = s.seq AND a.band = s.sub LEFT JOIN bands b ON b.page_id = s.page_id AND b.seq = s.seq AND b.band = s.sub + 1", ["cut1"]
    own["rest"], needs["rest"] = f"SELECT page_id, 11 AS step, min(det_id) OVER (PARTITION BY page_id, label) * 100000::BIGINT + det_id AS seq, 0 AS sub, label, conf, x1, y1, x2, y2 FROM lab WHERE label NOT IN {_list(_HANDLED)}", ["lab"]
    own["blk0"], needs["blk0"] = "SELECT page_id, step, seq, 0 AS sub, label, conf, x1, y1, x2, y2 FROM made UNION ALL SELECT page_id, 10, seq, sub, 'plain text', 1.0::DOUBLE, x1, y1, x2, y2 FROM cut2 WHERE bands = 0 OR y2 - y1 >= 20 UNION ALL SELECT * FROM rest", ["made", "cut2", "rest"]
    own["blk"], needs["blk"] = "SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY step, seq, sub) AS INT) AS det_id FROM blk0", ["blk0"]
    # titles and their bodies, over the numbered blocks
    own["ti"], needs["ti"] = own["ti"].replace("FROM lab", "FROM blk"), ["blk"]
    own["tp"] = own["tp"].replace("JOIN lab p", "JOIN blk p")
    own["tl"], needs["tl"] = "SELECT page_id, arg_max(taken, rn) AS taken FROM tfold GROUP BY page_id", ["tfold"]
    own["tb"], needs["tb"] = "SELECT t.page_id, t.det_id AS title_id, taken[t.rn] AS body_id FROM ti t JOIN tl USING (page_id) WHERE taken[t.rn] <> 0", ["tl"]
    own["fin0"], needs["fin0"] = (
        "SELECT page_id, det_id AS id, 0 AS sub, label, conf, x1, y1, x2, y2 FROM blk b WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.page_id = b.page_id AND b.det_id IN (tb.title_id, tb.body_id))"
        " UNION ALL SELECT b.page_id, b.det_id, 0, 'titled_block_title', b.conf, b.x1, b.y1, b.x2, b.y2 FROM tb JOIN blk b ON b.page_id = tb.page_id AND b.det_id = tb.title_id"
        " UNION ALL SELECT b.page_id, t.det_id, 1, 'titled_block_body', t.conf, b.x1, b.y1, b.x2, b.y2 FROM tb JOIN blk t ON t.page_id = tb.page_id AND t.det_id = tb.title_id JOIN blk b ON b.page_id = tb.page_id AND b.det_id = tb.body_id",
        ["blk", "tb"],
    )
    own["fin"], needs["fin"] = "SELECT * FROM fin0 a WHERE label <> 'plain text' OR NOT EXISTS (SELECT 1 FROM fin0 b WHERE b.page_id = a.page_id AND b.label = 'plain text' AND b.id <> a.id AND a.y1 >= b.y1 - 2 AND a.y2 <= b.y2 + 2 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0.7 * (a.x2 - a.x1))", ["fin0"]
    seen: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, []):
            add(n)
        if name not in seen:
            seen.append(name)

    add("fin")
    kept = ("det", "lab", "made", "text", "bands", "blk", "fin0")
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in kept else ''}({own[n]})" for n in seen)
    names = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in CLASS_ID.items()) + ") c(name, id)"
    return f"{head}\nSELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY f.id, sub) AS INT) AS block_id, label, CAST(coalesce(c.id, 0) AS INT) AS class_id, round(conf, 6) AS conf, x1, y1, x2, y2 FROM fin f LEFT JOIN {names} ON c.name = f.label"


ORACLES["e14_blocks"] = _blocks_oracle()
