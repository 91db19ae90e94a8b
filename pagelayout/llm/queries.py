"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, folds, jaccard_join, language_id, pu_quality, quality_rules, secrets, sharding, toxicity, url_filter


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.quality_rules(read(spark, sf_dir, "documents", "doc_id", "text"), name="found")
    return docs.select("doc_id", *(f"found.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks")))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(), name="coded").select("doc_id", "coded.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


URL_RULES = [url_filter.Rule(h, p, v) for h, p, v in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, name="judged")
    return pages.select("page_id", *(f"judged.{c}" for c in ("host", "path", "rule", "verdict", "score")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"), name="found")
    found = F.col("found")
    return docs.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), decontaminate.contaminated(found).alias("contaminated"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = folds.in_fold(F.col("doc_id"), 4, 2)
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    trusted = read(spark, sf_dir, "labels", "doc_id", "quality").where((F.col("quality") == 1) & ~held_out)
    model = pu_quality.train(docs, trusted, ~held_out)
    found = pu_quality.score(docs, model, name="found")
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= 0.7).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = folds.in_fold(F.col("doc_id"), 3, 1)
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out)
    found = toxicity.score(docs, model, name="found")
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= 0.7).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = folds.in_fold(F.col("doc_id"), 5, 0)
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs, F.col("doc_id").isNotNull() & ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model, name="found")
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan_versions(read(spark, sf_dir, "documents", "doc_id", "text"), name="found").select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*(r.kind for r in secrets.RULES)))
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents", "doc_id", "text"), 8)


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_quality_rules, op3_byte_bpe, op4_url_filter, op5_decontamination, op6_quality_classifier, op7_toxicity, op8_language_id, op9_secret_scans, op10_sharding)}


#: The contract's base patterns, written for DuckDB: kind, pattern, group whose length counts, characters at least.
_SECRETS = (
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)


def _secrets_oracle() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {n} AS kind_order, {least} AS least, regexp_extract_all(body, '{pattern}', 0) AS m, regexp_extract_all(body, '{pattern}', {group}) AS g, string_split_regex(body, '{pattern}') AS gaps FROM d" for n, (kind, pattern, group, least) in enumerate(_SECRETS)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
k AS ({kinds}),
x AS (SELECT doc_id, kind, kind_order, least, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap FROM k WHERE len(m) > 0),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM x),
s AS (SELECT doc_id, kind, kind_order, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, kind_order) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


_CRC_TABLE = "(SELECT list(c ORDER BY n) FROM (WITH RECURSIVE t(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8) SELECT n, c FROM t WHERE k = 8))"

_SHARDING_ORACLE = f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, [CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(length(h) // 2)] AS bytes FROM b),
t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, size, xor(list_reduce(bytes, LAMBDA x, y: xor(x >> 8, t.crc[CAST(xor(x, y) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM c, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
n AS (SELECT doc_id, size, text_crc32, CAST(least((2 * upto - size) * 8 // (2 * total), 7) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n"""

_DECONTAMINATION_ORACLE = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bi AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hits AS (SELECT DISTINCT doc_id, dg.n, i, item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hw AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)"""

_JACCARD_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, least(5, len(w)) AS k FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN c ca ON ca.doc_id = a.doc_id JOIN c cb ON cb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, ca.n, cb.n HAVING 100 * count(*) >= 75 * (ca.n + cb.n - count(*))),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT node, min(other) AS m FROM r GROUP BY node) m ON m.node = d.doc_id"""

ORACLES: dict[str, str] = {"op1_jaccard_join": _JACCARD_ORACLE, "op5_decontamination": _DECONTAMINATION_ORACLE, "op9_secret_scans": _secrets_oracle(), "op10_sharding": _SHARDING_ORACLE}
