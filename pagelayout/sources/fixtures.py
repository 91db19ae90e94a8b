"""Inputs derived from the driver's tables, as FIXTURES.md describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = """
WITH det0 AS (
 SELECT cast(floor(l_orderkey/8) AS bigint) page_id, cast(l_suppkey % 10 AS int) class_id,
  cast(0.3 AS double) + ((cast(l_quantity AS bigint)*7919 + l_partkey*31 + l_orderkey*17) % 7000)/cast(10000 AS double) conf,
  cast((l_partkey % 3)*260 + (l_orderkey % 5)*8 AS int) x1,
  cast((cast(floor(l_partkey/3) AS bigint) % 8)*140 + l_linenumber*6 AS int) y1,
  cast((l_partkey % 3)*260 + (l_orderkey % 5)*8 + 180 + (l_suppkey % 4)*25 AS int) x2,
  cast((cast(floor(l_partkey/3) AS bigint) % 8)*140 + l_linenumber*6 + 30 + cast(l_quantity AS bigint)*3 AS int) y2,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM {lineitem})
SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS int) det_id,
       class_id, conf, x1, y1, x2, y2 FROM det0"""

WORD_BOXES = """
WITH lo AS (SELECT doc_id, ln, coalesce(sum(rows_) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) row0
            FROM (SELECT doc_id, ln, max(1+cast(floor(llen/80) AS bigint)) rows_ FROM {tok} GROUP BY doc_id, ln) a),
 w AS (SELECT doc_id, ln, wi, word, sum(length(word)+1) OVER (PARTITION BY doc_id, ln ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(word) - 1 cs FROM {tok}),
 r AS (SELECT w.doc_id, w.ln, w.wi, length(word) n, cs % 80 col, row0 + cast(floor(cs/80) AS bigint) vrow
       FROM w JOIN lo ON w.doc_id=lo.doc_id AND w.ln=lo.ln WHERE length(word)>0),
 b AS (SELECT doc_id, ln, wi, doc_id*1000 + cast(floor(vrow/60) AS bigint) page_id,
        cast(50+col*10 AS int) x1, cast(50+col*10+n*10-2 AS int) x2,
        cast(60+(vrow % 60)*30 + CASE WHEN wi % 11 = 5 THEN 14 ELSE 0 END AS int) y1,
        cast(CASE WHEN n=1 THEN 8 ELSE 20 + n % 4 END AS int) h FROM r)
SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY ln, wi) AS int) word_id, x1, y1, x2, y1+h y2 FROM b"""

PAGE_W, PAGE_H = 860, 1260


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, least: float | None = 0.51) -> DataFrame:
    """Boxes by page; det_id is the rank by confidence. Without `least` all of them."""
    df = spark.sql(DETECTIONS, lineitem=table(spark, sf_dir, "lineitem"))
    return df if least is None else df.where(F.col("conf") >= least)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelayout.operators.decode import with_labels

    return with_labels(detections(spark, sf_dir))


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    tok = docs.select("doc_id", "ln", F.length("line").alias("llen"), F.posexplode(F.split("line", " ")).alias("wi", "word"))
    return spark.sql(WORD_BOXES, tok=tok)


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    df = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("page_id"), (F.col("vec_id") % 50).alias("anchor_id"), "embedding")
    df = df.withColumns({"bx1": 512 + 900 * e(11), "by1": 512 + 900 * e(12)})
    return df.select(
        "page_id", "anchor_id", "bx1", "by1", (F.col("bx1") + 20 + 600 * F.abs(e(13))).alias("bx2"), (F.col("by1") + 20 + 600 * F.abs(e(14))).alias("by2"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("logits"),
        (800 + (F.col("page_id") % 5) * 100).cast("int").alias("img_w"), (1100 + (F.col("page_id") % 3) * 150).cast("int").alias("img_h"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return cells.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("r"), (F.col("k") % 8).alias("c"), (F.col("v").cast("double") * 10).alias("z"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("region_set"), "event_id", (F.col("value") - 3 * F.floor(F.col("value") / 3) - 1.5).alias("angle"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter components of words 200 by 60; comp_id orders them within a word."""
    return spark.sql(
        """SELECT word_key, cast(row_number() OVER (PARTITION BY word_key ORDER BY x, y, w, h, l_partkey, l_suppkey) AS int) comp_id, x, y, w, h, w*h area FROM (
  SELECT l_orderkey word_key, cast(l_partkey % 180 AS int) x, cast(l_suppkey % 40 AS int) y, cast(2 + cast(l_quantity AS int) % 18 AS int) w, cast(2 + 3*l_linenumber AS int) h, l_partkey, l_suppkey FROM {lineitem})""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )
