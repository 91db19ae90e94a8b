"""Schemas and dimension tables of page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The layout model's classes, in the order of their ids, with colours.
CLASSES = [
    ("title", (220, 50, 50)),
    ("plain text", (50, 120, 220)),
    ("abandon", (160, 160, 160)),
    ("figure", (50, 200, 50)),
    ("figure_caption", (100, 220, 100)),
    ("table", (220, 150, 50)),
    ("table_caption", (240, 190, 80)),
    ("table_footnote", (240, 220, 100)),
    ("isolate_formula", (180, 50, 220)),
    ("formula_caption", (220, 130, 220)),
]
CLASS_ID = {label: i for i, (label, _) in enumerate(CLASSES)}
# Class ids that page-analyser answers give to composite labels; any other label is plain text.
ANALYSER_CLASS_ID = {**CLASS_ID, "titled_block_title": 0, "titled_block_body": 1, "figure_and_caption": 3}
# Labels whose regions are reflowed, and labels that end a run of text.
TEXT_LABELS = ("plain text", "title", "titled_block_body")
NON_TEXT_LABELS = ("figure", "figure_and_caption", "figure_caption", "table", "table_and_caption", "table_caption", "table_footnote", "isolate_formula", "isolate_formula_and_caption", "formula_caption")
# Languages offered, and the ISO 639-1 code that goes by another name.
LANGUAGES = "en ru de fr es pl uk bg cs sk nl pt it sv da fi nb hu ro hr sr sl lt lv et be ca eu gl ga el".split()
RENAMED_LANGUAGES = {"no": "nb"}
DEFAULT_LANGUAGE = "en"

DETECTION = "page_id long, det_id int, label string, class_id int, conf double, x1 int, y1 int, x2 int, y2 int"


def layout_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, label, *rgb) for i, (label, rgb) in enumerate(CLASSES)], "class_id int, label string, r int, g int, b int")


def languages(spark: SparkSession) -> DataFrame:
    """ISO code -> language offered."""
    return spark.createDataFrame([*((c, c) for c in LANGUAGES), *RENAMED_LANGUAGES.items()], "iso string, lang string")
