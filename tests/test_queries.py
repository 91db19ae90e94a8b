import duckdb
import pandas as pd
import pytest

from pagelayout.plans.oracles import ORACLES
from pagelayout.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["c4_decode", "c10_nms", "e3_figure_captions", "e10_text_slices", "f4_text_lines", "g22_baselines", "h10_work_units", "i4_peaks", "j7_classified", "a10_answered_words", "e14_blocks", "g8_letter_boxes", "g10_letter_rects", "g18_pack_lines", "i6_sampled_regions", "h5_padded_words", "a8_stream_tickets"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "documents", "embeddings", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).sort_values(cols, key=lambda s: s.map(str)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
