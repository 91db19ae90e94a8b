"""Documents, page analysers and their answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelayout.functions.workers import ship
from pagelayout.schema import ANALYSER_CLASS_ID

REQUIRED = ("image_width", "image_height", "background_color", "skew_angle", "is_toc", "left_margin", "right_margin", "blocks")
ANSWER = (
    "image_width double, image_height double, background_color array<double>, skew_angle double, is_toc boolean, left_margin double, right_margin double,"
    " blocks array<struct<bbox:array<double>,block_type:string,lines:array<struct<words:array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>>>, word_boxes array<array<double>>"
)


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def document_kind(path: Column) -> Column:
    """A3: pdf for pdf files; whatever else is opened is taken as djvu."""
    return F.when(extension(path) == "pdf", "pdf").otherwise("djvu")


def can_open(path: Column) -> Column:
    """A3: only these extensions are offered."""
    return extension(path).isin("djvu", "djv", "pdf")


def page_rows(documents: DataFrame, n_pages: str = "n_pages") -> DataFrame:
    """A3: one row a page, numbered from 0."""
    return documents.where(F.col(n_pages) > 0).withColumn("page_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_pages).cast("long") - 1)))


def render_size(w: Column, h: Column, dpi: float, own_dpi: Column) -> Column:
    """A1, A2: size of a page rendered at `dpi`; own_dpi is 72 for pdf."""
    return F.struct((w * dpi / own_dpi).cast("int").alias("w"), (h * dpi / own_dpi).cast("int").alias("h"))


def content_type(filename: Column) -> Column:
    """By extension, png unless it is a jpeg."""
    return F.when(extension(filename).isin("jpg", "jpeg"), "image/jpeg").otherwise("image/png")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A1-A3: files with their kind; the bytes are read only where a renderer asks for them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,djvu,djv}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", document_kind(F.col("path")).alias("kind"), "content")


def through(rows: DataFrame, connect: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows passed to a renderer or model.

    `connect` runs once a task and returns the call (a loaded model, an open
    connection); each call gets one Arrow batch. Calls must stand being repeated, as
    tasks are.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for batch in batches:
            yield call(batch)

    ship(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def healthy(body: Column, field: str = "status", value: str = "ok") -> Column:
    """Whether a JSON answer has the value; anything else, and no answer, is false."""
    return F.coalesce(F.get_json_object(body, f"$.{field}") == value, F.lit(False))


def parse_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """A10: answers with `a`, the parsed struct, and `missing`, the required fields that a body lacks (all for no JSON)."""
    parsed = F.from_json(F.col(body), ANSWER)
    keys = F.coalesce(F.json_object_keys(F.col(body)), F.array().cast("array<string>"))
    return answers.withColumns({"a": parsed, "missing": F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), keys)})


def answered_blocks(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """A10: detections of complete answers, in order; unknown types count as plain text."""
    ids = F.create_map(*[x for k, v in ANALYSER_CLASS_ID.items() for x in (F.lit(k), F.lit(v))])
    rows = parsed.where(F.size("missing") == 0).select(key, F.posexplode("a.blocks").alias("n", "b"))
    box = [F.get(F.col("b.bbox"), i).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select(key, (F.col("n") + 1).alias("det_id"), F.col("b.block_type").alias("label"), F.coalesce(F.element_at(ids, F.col("b.block_type")), F.lit(1)).alias("class_id"), F.lit(1.0).alias("conf"), *box)


def answered_words(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """A10: word boxes: the page's own list, else the words of blocks and lines without repeats, first kept."""
    own = F.transform("a.word_boxes", lambda b: F.struct(*(F.get(b, i).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2")))))
    lines = F.flatten(F.transform("a.blocks", lambda b: F.coalesce(b["lines"], F.array().cast("array<struct<words:array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>"))))
    nested = F.flatten(F.transform(lines, lambda x: F.coalesce(x["words"], F.array().cast("array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>"))))
    fallback = F.array_distinct(F.transform(nested, lambda w: F.struct(w["xmin"].cast("int").alias("x1"), w["ymin"].cast("int").alias("y1"), w["xmax"].cast("int").alias("x2"), w["ymax"].cast("int").alias("y2"))))
    rows = parsed.where(F.size("missing") == 0).select(key, F.posexplode(F.coalesce(own, fallback)).alias("n", "w"))
    return rows.select(key, (F.col("n") + 1).alias("word_id"), "w.x1", "w.y1", "w.x2", "w.y2")


def manifest_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (name, size) that are missing or of another size, with what was found."""
    found = actual.select("name", F.col("size").alias("found"))
    return expected.join(found, "name", "left").where(~F.col("found").eqNullSafe(F.col("size")))


def settings(text: Column, schema: str) -> Column:
    """Settings from JSON; what can't be read is empty."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def settings_text(values: Column) -> Column:
    """A struct of settings as JSON, as it is saved; null fields are left out."""
    return F.to_json(values)


def first_copies(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A10: the first of equal rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
