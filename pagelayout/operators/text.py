"""Recognised text and its language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.workers import ship
from pagelayout.schema import DEFAULT_LANGUAGE, languages


def ctc_greedy(steps: DataFrame, key: str, vocabulary: list[str], blank: int) -> DataFrame:
    """(key, text) from rows (key, t, logits): best class of each step, repeats and blanks dropped.

    Classes outside the vocabulary are dropped too; a blank between equal classes keeps both.
    """
    best = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    rows = steps.select(key, "t", best.alias("k"))
    before = F.lag("k").over(Window.partitionBy(key).orderBy("t"))
    letters = F.array(*(F.lit(x) for x in vocabulary))
    kept = (F.col("k") != blank) & ((before.isNull()) | (F.col("k") != before)) & (F.col("k") < len(vocabulary))
    rows = rows.withColumn("_x", F.when(kept, F.struct("t", F.get(letters, F.col("k")).alias("x"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["x"]), "").alias("text"))


def sample_pages(pages: DataFrame, book: str = "book", page: str = "page_no", most: int = 3) -> DataFrame:
    """Up to three pages from a book's middle half; pages are numbered from 0."""
    n = F.count("*").over(Window.partitionBy(book))
    middle, quarter = F.floor(n / 2), F.greatest(F.lit(1), F.floor(n / 4))
    low, high = F.greatest(F.lit(0), middle - quarter), F.least(n, middle + quarter)
    step = F.greatest(F.lit(1), F.floor((high - low) / 3))
    rows = pages.withColumns({"_low": low, "_high": high, "_step": step})
    off = F.col(page) - F.col("_low")
    return rows.where((F.col(page) >= F.col("_low")) & (F.col(page) < F.col("_high")) & (off % F.col("_step") == 0) & (off / F.col("_step") < most)).drop("_low", "_high", "_step")


def sample_words(words: DataFrame, key: str = "page_id", order: str = "word_id", most: int = 20) -> DataFrame:
    """Up to 20 words spread over the middle half of each page; all words where that half is empty."""
    rows = words.withColumns({"_n": F.count("*").over(Window.partitionBy(key)), "_i": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1})
    low, high = F.floor(F.col("_n") / 4), F.floor(F.col("_n") * 3 / 4)
    low, high = F.when(high > low, low).otherwise(0), F.when(high > low, high).otherwise(F.col("_n"))
    off, step = F.col("_i") - low, F.greatest(F.lit(1), F.floor((high - low) / most))
    return rows.where((F.col("_i") >= low) & (F.col("_i") < high) & (off % step == 0) & (off / step < most)).drop("_n", "_i")


def clamped_crops(boxes: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Boxes cut to the page; those that keep no area go."""
    edge = {"x1": F.greatest(F.lit(0), F.col("x1")), "y1": F.greatest(F.lit(0), F.col("y1")), "x2": F.least(F.lit(page_w), F.col("x2")), "y2": F.least(F.lit(page_h), F.col("y2"))}
    return boxes.withColumns(edge).where("x2 > x1 AND y2 > y1")


def joined(parts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The texts that aren't blank, trimmed and joined by spaces, in order."""
    trimmed = F.trim(F.col(text))
    kept = F.when(F.length(trimmed) > 0, F.struct(order, trimmed.alias("x")))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["x"]), " ").alias("text"))


#: Trigrams that a task counts before it passes them on.
HELD_GRAMS = 1 << 20


def _plain(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))


def _grams(text: str) -> np.ndarray:
    """A number for each trigram of code points, in the order of the strings; what is shorter is one gram."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(code) < 3:
        code = np.concatenate([code, np.zeros(3 - len(code), dtype=np.uint64)])
    return (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]


def _spelt(gram: int) -> str:
    return "".join(chr(x) for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


def language_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = 300) -> DataFrame:
    """(lang, gram, rank): the most frequent character trigrams of each language, ties by the gram.

    Tasks count the trigrams of their texts, so a row leaves them for a trigram and
    not for a character. Null texts have none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), _plain(F.col(text)).alias("text")).where("text IS NOT NULL")

    def run(batches):
        held: dict[str | None, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            for name, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                out[0].extend([name] * len(gram))
                out[1].extend(map(_spelt, gram.tolist()))
                out[2].extend(n.tolist())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = _grams(text)
                held.setdefault(name, []).append(grams)
                size += len(grams)
                if size >= HELD_GRAMS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counts = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank")


def classify(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", size: int = 300, most_languages: int = 1_000) -> DataFrame:
    """(key, lang, distance): the profile nearest to a text's own by the sum of rank differences (Cavnar and Trenkle).

    A gram that a profile lacks costs `size`; languages at one distance go by name. Each
    row is judged by its own text, in one pass without a shuffle; null texts give no
    row. The profiles, of `most_languages` at most (more are an error), are sent to all.
    """
    ship(docs.sparkSession)
    known: dict[str, list[tuple[int, int]]] = {}
    for r in profiles.where(F.col("lang").isNotNull()).limit(most_languages * size + 1).collect():
        code = _grams(r["gram"])
        known.setdefault(r["lang"], []).append((int(code[0]), r["rank"]))
    if len(known) > most_languages:
        raise ValueError(f"profiles of more than {most_languages} languages")
    tables = [(name, *np.array(sorted(known[name]), dtype=np.uint64).T) for name in sorted(known)]
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    rows = docs.select(F.col(key), _plain(F.col(text)).alias("_text")).where("_text IS NOT NULL")

    def judged(text: str, profiles: list) -> tuple[str, int]:
        gram, n = np.unique(_grams(text), return_counts=True)
        own = gram[np.lexsort((gram, -n))[:size]]
        mine = np.arange(1, len(own) + 1)
        near = []
        for name, grams, ranks in profiles:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            same = grams[at] == own
            if same.any():
                near.append((int((np.abs(mine[same] - ranks[at[same]].astype(np.int64)) - size).sum()), name))
        saved, name = min(near, default=(0, DEFAULT_LANGUAGE))
        return name, len(own) * size + saved

    def run(batches):
        profiles = shared.value
        for batch in batches:
            found = [judged(x, profiles) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([d for _, d in found], pa.int64())], names=[key, "lang", "distance"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("lang", T.StringType()), T.StructField("distance", T.LongType())]))


def confidence(score: Column) -> Column:
    """A log score as a confidence: 1 + score / 500, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + score / 500))


def offered(df: DataFrame, iso: str = "iso", name: str = "app_lang") -> DataFrame:
    """The language offered for an ISO code; the default where there is none."""
    dim = languages(df.sparkSession).select(F.col("iso").alias("_iso"), F.col("lang").alias("_lang"))
    return df.join(F.broadcast(dim), F.col(iso) == F.col("_iso"), "left").withColumn(name, F.coalesce("_lang", F.lit(DEFAULT_LANGUAGE))).drop("_iso", "_lang")
