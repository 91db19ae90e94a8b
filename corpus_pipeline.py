"""From raw documents to token ids: a pipeline of five operators of pagelayout.llm.

Each stage takes the documents its predecessor kept and returns what it keeps,
with the columns of documents; the last returns token ids in place of the text.
Documents go by doc_id. Stages are written and read again in between, so a lost
executor costs tasks of one stage only.

Every stage takes any columns besides doc_id and text and gives them back as they
came; names that clash with its own are stepped aside. Texts of any length are
worked on whole. An empty table stays empty, with its columns. What a stage does
with nulls, empty texts and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.llm import bpe, decontaminate, folds, jaccard_join, language_id, secrets
from pagelayout.llm.annotate import free_name
from pagelayout.llm.lookup import lookup
from pagelayout.llm.queries import read, vocabulary
from pagelayout.llm.store import Scratch

#: A document stays if its language is known with this much confidence: little over chance.
LEAST_LANGUAGE_SCORE = 0.3
#: What stands for a secret in the text.
MARK = "[SECRET]"
#: Ids (8 bytes each) of documents to drop that are sent to all executors; beyond it texts are exchanged, no id's in one task.
SMALL_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or of no language that the model knows.

    Null and empty texts have no letter: they go. Repeated rows stay or go alike. Null
    languages, and documents without an id, teach nothing but are judged.
    """
    model = language_id.train(docs, F.col("doc_id").isNotNull() & ~folds.in_fold(F.col("doc_id"), 5, 0))
    name = free_name(docs, "language")
    found = language_id.identify(docs, model, name=name)
    return found.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id in each group that links connect.

    Rows of one doc_id stay or go together, and equal ones among them stay once. Null
    ids are no group's least: they stay only where no other document is linked. Null
    and empty texts are linked with nothing: they stay.
    """
    scratch = Scratch(spark, "near-duplicates")
    groups = scratch.save(jaccard_join.jaccard_components(docs), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = scratch.save(groups.groupBy("doc_id").agg(F.max(first).alias("stays"), F.count("*").alias("rows")), "ids")
    sums = ids.agg(F.count(F.when(~F.col("stays"), 1)).alias("gone"), F.sum("rows").alias("rows"), F.count(F.when(F.col("stays") & (F.col("rows") > 1), 1)).alias("repeated")).first()
    if sums.gone <= SMALL_IDS:
        gone = F.broadcast(ids.where("NOT stays").select(F.col("doc_id").alias("_id")))
        kept = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
    else:
        known = lookup(docs.where("doc_id IS NOT NULL"), ids.where("stays").select("doc_id", "rows"), "doc_id", "rows", F.col("text"), sums.rows)
        nameless = docs.where("doc_id IS NULL") if ids.where("stays AND doc_id IS NULL").count() else docs.limit(0)
        kept = known.unionByName(nameless)
    return kept.dropDuplicates(["doc_id", "text"]) if sums.repeated else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text.

    Null and empty texts have no words: they stay. Repeated rows stay or go alike.
    """
    name = free_name(docs, "contamination")
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), name=name)
    return found.where(~decontaminate.contaminated(F.col(name))).drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mark; n_chars follows the text. All documents stay.

    Null texts stay null. Repeated rows are scanned once and changed alike.
    """
    name = free_name(docs, "secrets")
    found = secrets.scan_versions(docs, name=name)
    # under a name of its own first: a length of `text` beside a new `text` could be that of either
    clean = free_name(found, "clean")
    found = found.withColumn(clean, secrets.redact(F.col("text"), F.col(name), MARK))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(name) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, their number, and whether decoding gives the text back.

    Null and empty texts have no ids. All rows stay, repeated ones too.
    """
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    name = free_name(docs, "coded")
    coded = bpe.round_trip(docs, vocabulary(), name=name)
    same = F.col(name)["decoded"] == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select(*rest, F.col(name)["ids"].alias("ids"), F.size(F.col(name)["ids"]).cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: Learnt models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), ""
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
