"""Queries work on all of their input: each equals its SQL, which has no cut, or a version by hand."""

import duckdb
import pandas as pd
import pytest

from pagelayout.plans.oracles import ORACLES
from pagelayout.plans.queries import QUERIES, regions
from pagelayout.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def assert_equal(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).sort_values(cols, key=lambda s: s.map(str)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_joined_text_has_every_line(spark, duck):
    rows = QUERIES["j6_joined_text"](spark, SF).toPandas()
    docs = duck.execute("SELECT doc_id, text FROM documents").df()
    docs["text"] = [" ".join(x.strip(" ") for x in t.split("\n") if x.strip(" ")) for t in docs["text"]]
    assert_equal(rows, docs)


@pytest.mark.parametrize("name", ["a10_answered_blocks", "a10_answered_words"])
def test_answers_have_every_detection(spark, duck, name):
    whole = ORACLES[name]
    assert "det_id <=" not in whole
    rows = QUERIES[name](spark, SF).toPandas()
    assert rows.iloc[:, 1].max() > 12
    assert_equal(rows, duck.execute(whole).df())


@pytest.mark.parametrize("name", ["j7_language_profiles", "j7_classified"])
def test_languages_are_learnt_from_and_told_for_every_document(spark, duck, name):
    whole = ORACLES[name]
    assert "% 5" not in whole
    rows = QUERIES[name](spark, SF).toPandas()
    if name == "j7_classified":
        assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert_equal(rows, duck.execute(whole).df())


@pytest.mark.parametrize("name", ["c11_map_components", "c14_rect_scores"])
def test_maps_are_cut_where_fixtures_say(spark, duck, name):
    assert "p >= 0.5" in ORACLES[name]
    assert_equal(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


def test_words_of_every_page_meet_regions(spark, duck):
    rows = QUERIES["h4_words_in_regions"](spark, SF).toPandas()
    words, own = fixtures.word_boxes(spark, SF).toPandas(), regions(spark, SF).toPandas()
    n = own["page_id"].max() + 1
    words["own_page"] = (words["page_id"] // 1000 + words["page_id"] % 1000) % n
    m = words.merge(own.rename(columns={"page_id": "own_page"}), on="own_page", suffixes=("", "_r"))
    x, y = m["x1"] + m["x2"], m["y1"] + m["y2"]
    m = m[(x >= 2 * m["x1_r"]) & (x <= 2 * m["x2_r"]) & (y >= 2 * m["y1_r"]) & (y <= 2 * m["y2_r"])]
    for c in ("x", "y"):
        m = m.assign(**{f"{c}2": m[f"{c}2"] - m[f"{c}1_r"], f"{c}1": m[f"{c}1"] - m[f"{c}1_r"]})
    assert (rows["page_id"] % 1000 > 0).any()
    assert_equal(rows, m[list(rows.columns)])


def test_padded_words_are_on_the_same_pages(spark):
    met = {tuple(x) for x in QUERIES["h4_words_in_regions"](spark, SF).select("page_id", "block_id").distinct().collect()}
    padded = {tuple(x) for x in QUERIES["h5_padded_words"](spark, SF).select("page_id", "block_id").distinct().collect()}
    assert padded == met and any(p % 1000 for p, _ in padded)
