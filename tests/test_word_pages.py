import pytest

from pagelayout.functions.pages import Pages
from pagelayout.operators import reflow
from pagelayout.plans import queries
from pagelayout.sources import fixtures
from pagelayout.sources.word_pages import word_pages

SF = "/root/testdata/sf0.001"
BOXES = "word_id int, x1 int, y1 int, x2 int, y2 int"


def boxes(pages: Pages):
    return pages.each(lambda page: tuple(page[c] for c in ("word_id", "x1", "y1", "x2", "y2")), BOXES)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts without words, words over several rows, spaces at ends, a text whose rows run on into the next document's pages, equal texts of one id."""
    texts = [(1, None), (2, ""), (3, " \n\n  "), (4, "a" * 500 + " b " + "cd " * 90), (5, "é 𝄞𝄞 x\n" * 70), (6, "\n" * 60010 + "far " * 50), (7, "near by\n" * 30), (8, "twice said " * 40), (8, "twice said " * 40), (None, "no id")]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_pages_hold_the_word_boxes(spark):
    assert rows(boxes(word_pages(spark, SF))) == rows(fixtures.word_boxes(spark, SF))


def test_pages_of_odd_documents(spark, odd):
    got, want = boxes(word_pages(spark, odd)), fixtures.word_boxes(spark, odd)
    # equal texts of one id tie, so their words' order is left out
    assert rows(got.where("page_id NOT BETWEEN 8000 AND 8999")) == rows(want.where("page_id NOT BETWEEN 8000 AND 8999"))
    assert rows(got, "page_id", "x1", "y1", "x2", "y2") == rows(want, "page_id", "x1", "y1", "x2", "y2")
    assert got.where("page_id = 7000").count() == 110


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_placing_words_exchanges_no_row_a_word(spark):
    assert exchanges(queries.g20_place_words(spark, SF)) == 2


def test_words_placed_in_one_pass_equal_the_steps(spark, odd):
    for sf in (SF, odd):
        steps = reflow.place_words(queries.placed_words(spark, sf), queries.ZOOM, 10, fixtures.PAGE_W, 10, 5).where("page_id NOT BETWEEN 8000 AND 8999")
        found = queries.g20_place_words(spark, sf)
        assert found.columns == steps.columns and found.count()
        assert rows(found.where("page_id NOT BETWEEN 8000 AND 8999")) == rows(steps)


def test_packing_lines_exchanges_no_row_a_word(spark):
    assert exchanges(queries.g18_pack_lines(spark, SF)) == 2


def test_lines_packed_in_one_pass_equal_the_steps(spark, odd):
    for sf in (SF, odd):
        steps = reflow.pack_lines(queries.packed_words(spark, sf), queries.ZOOM, 640).where("page_id NOT BETWEEN 8000 AND 8999")
        found = queries.g18_pack_lines(spark, sf)
        assert found.columns == steps.columns and found.count()
        assert rows(found.where("page_id NOT BETWEEN 8000 AND 8999")) == rows(steps)
