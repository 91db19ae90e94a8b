import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from pagelayout.llm import lookup
from tests.llm.test_joins import brute, brute_hits
from tests.llm.test_texts import brute_spans

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, token string, found int"


def test_stages():
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scans", "byte_bpe"]
    assert p.ORACLE_SQL is None


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(p.STAGES)
    kept = stage["language_id"](spark, docs, SF).cache()
    # all documents here are prose of known languages
    assert kept.count() == len(source)
    kept = stage["near_duplicates"](spark, docs, SF).cache()
    want = {d for d, _, c in brute([(d, r.text) for d, r in source.items()]) if d == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    clean = stage["decontamination"](spark, kept, SF).cache()
    dirty = {h[0] for h in brute_hits([(d, source[d].text) for d in want], items) if h[-1]}
    assert dirty and {r.doc_id for r in clean.collect()} == want - dirty
    safe = stage["secret_scans"](spark, clean, SF).cache()
    changed = 0
    for r in safe.collect():
        own = source[r.doc_id].text
        assert brute_spans(r.text) == "" or p.MARK in r.text
        assert (r.text == own) == (brute_spans(own) == "") and r.n_chars == len(r.text)
        changed += r.text != own
    assert changed and safe.columns == docs.columns
    last = stage["byte_bpe"](spark, safe, SF).collect()
    assert {r.doc_id for r in last} == want - dirty and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


@pytest.mark.parametrize("small", [0, 10**6])
def test_every_way_to_drop_copies(spark, monkeypatch, small):
    monkeypatch.setattr(p, "SMALL_IDS", small)
    monkeypatch.setattr(lookup, "MOST_HOT", 1)
    monkeypatch.setattr(lookup, "HOT_ROWS", 2)
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "x y"), (3, "x y"), (3, "z"), (3, "z"), (4, None), (5, ""), (None, "x y"), (6, "z"), (7, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rows": F.lit(1), "stays": F.lit("s")})
    kept = p.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(1, "a b c d e f"), (3, "x y"), (3, "z"), (4, ""), (5, ""), (7, "q r s")]


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES[:-1]])
def test_long_texts_and_clashing_names(spark, name):
    text = " ".join(f"w{i % 5000} the cat" for i in range(120_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), "t", 1), (2, "the dog and the cat", "en", "s", 19, "t", 2)], KINDS).withColumns({c: F.lit(None).cast("string") for c in ("_text", "language", "secrets", "contamination", "key", "sid", "_lookup_key", "blob", "n")})
    out = dict(p.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "the dog and the cat"}


def test_run_is_the_stages(spark):
    out = p.run(spark, SF)
    assert out.where("NOT round_trip").count() == 0 and 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None), (None, "", None, None, None, "t", 1), (2, "the cat and the dog sat on the mat", "en", "s", 1, "t", 2), (2, "the cat and the dog sat on the mat", "en", "s", 1, "t", 2), (None, "die Katze und der Hund und die Maus", "de", "s", 2, None, None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, KINDS)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "token", "found"]
    out = p.STAGES[-1][1](spark, docs, SF)
    # without a letter there is no language, and of the equal rows one stays
    assert sorted(r.doc_id or 0 for r in out.collect()) == ([0, 2] if rows else [])
    assert out.select(F.max("n_tokens")).first()[0] == (max(r.n_tokens for r in out.collect()) if rows else None)
