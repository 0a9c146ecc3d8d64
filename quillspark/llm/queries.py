"""The corpus operators bound to the driver tables, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, jaccard_join, knn, mixing, perplexity, pieces, pii, sharding, suffixes, toxicity


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_toxicity(spark: SparkSession, root: str) -> DataFrame:
    scored = toxicity.run(_read(spark, root, "documents"), _read(spark, root, "labels"))
    held_out = toxicity.fold(F.col("id")) == 0
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_exact", "n_stem", "n_misspelled", "n_quoted")


def op2_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = suffixes.find(_read(spark, root, "documents"))
    return found.select(F.col("id").alias("doc_id"), "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("n_words"), F.col("other_id").alias("other_doc_id"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The file of a public tokenizer, on every machine that has the tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return pieces.encode_digest(_read(spark, root, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op4_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.find(_read(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def op5_knn(spark: SparkSession, root: str) -> DataFrame:
    return knn.nearest(_read(spark, root, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.find(_read(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, root: str) -> DataFrame:
    trusted = _read(spark, root, "labels").filter("quality = 1").select("doc_id")
    judged = perplexity.judge(_read(spark, root, "documents").select("doc_id", "text", "lang"), trusted)
    return judged.select("doc_id", "lang", F.col("__bits").alias("bits"), F.col("__high").alias("high"), F.col("__kept").alias("kept"))


def op7_sharding(spark: SparkSession, root: str) -> DataFrame:
    plan = sharding.plan_shards(_read(spark, root, "documents"), shards=16)
    return plan.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_mixing(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, root, "documents"), weights=[5, 2, 1], percent=150, most=2)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op10_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    rows = exact_dedup.decide(_read(spark, root, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_suffix_dedup": op2_suffix_dedup, "op3_sentencepiece": op3_sentencepiece, "op4_jaccard": op4_jaccard, "op5_knn": op5_knn, "op6_pii": op6_pii, "op8_quality": op8_quality, "op7_sharding": op7_sharding, "op9_mixing": op9_mixing, "op10_exact_dedup": op10_exact_dedup}


_OP9 = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647) * 48271 + 29) % 2147483647 AS f FROM documents),
hashed AS (SELECT *, (xor(f >> 7, f) * 69621) % 2147483647 AS h FROM rows),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w,
  source_size * 2 AS cap, (SELECT sum(size) FROM rows) * 1.5::DOUBLE AS budget FROM sized),
levels AS (SELECT l.lvl FROM (
  SELECT (a.budget - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap::DOUBLE / b.w < a.cap::DOUBLE / a.w), 0))
    / (SELECT sum(b.w) FROM weighed b WHERE b.cap::DOUBLE / b.w >= a.cap::DOUBLE / a.w) AS lvl, a.cap::DOUBLE / a.w AS ratio
  FROM weighed a) l WHERE l.lvl <= l.ratio ORDER BY l.ratio LIMIT 1),
fair AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate
  FROM (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT lvl FROM levels)) AS target FROM weighed)),
least AS (SELECT source, min(size) AS least
  FROM (SELECT source, size, sum(count(*)) OVER (PARTITION BY source ORDER BY size DESC) AS upto FROM hashed WHERE size > 0 GROUP BY source, size)
  WHERE upto <= 256 GROUP BY source),
largest AS (SELECT g.*, f.rate, (g.size * g.alike)::DOUBLE AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, h, doc_id NULLS FIRST) AS nth
    FROM (SELECT d.source, doc_id, size, h, count(*) AS alike FROM hashed d JOIN least l ON d.source IS NOT DISTINCT FROM l.source WHERE size >= least GROUP BY ALL)) g
  JOIN fair f ON g.source IS NOT DISTINCT FROM f.source),
walk AS (
  SELECT source, doc_id, size, alike, nth, copies, rate * words - copies * words AS owed
  FROM (SELECT *, least(greatest(floor(rate * words / words + 0.5), 0), 2)::BIGINT AS copies FROM largest WHERE nth = 1)
  UNION ALL
  SELECT source, doc_id, size, alike, nth, copies, due - copies * words
  FROM (SELECT *, least(greatest(floor(due / words + 0.5), 0), 2)::BIGINT AS copies
    FROM (SELECT l.source, l.doc_id, l.size, l.alike, l.nth, l.words, w.owed + l.rate * l.words AS due
      FROM walk w JOIN largest l ON w.source IS NOT DISTINCT FROM l.source AND l.nth = w.nth + 1))),
marked AS (SELECT d.*, w.copies FROM hashed d LEFT JOIN walk w
  ON d.source IS NOT DISTINCT FROM w.source AND d.doc_id IS NOT DISTINCT FROM w.doc_id AND d.size = w.size),
rest AS (SELECT *, h % (SELECT greatest(1, (count(*) + 511) // 512) FROM marked WHERE copies IS NULL) AS bucket FROM marked WHERE copies IS NULL),
stepped AS (SELECT l.source, least(greatest(floor(coalesce((f.target - coalesce(g.given, 0)) / nullif(l.words, 0), 0) * 16777216)::BIGINT, 0), 33554432) AS step
  FROM (SELECT source, sum(size) AS words FROM rest GROUP BY ALL) l JOIN fair f ON l.source IS NOT DISTINCT FROM f.source
  LEFT JOIN (SELECT source, sum(alike * size * copies) AS given FROM walk GROUP BY ALL) g ON l.source IS NOT DISTINCT FROM g.source),
along AS (SELECT d.*, s.step, row_number() OVER (PARTITION BY d.source ORDER BY bucket,
    CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, h, doc_id) AS nth
  FROM rest d JOIN stepped s ON d.source IS NOT DISTINCT FROM s.source),
every AS (
  SELECT doc_id, source, size, ((nth * step + o) >> 24) - (((nth - 1) * step + o) >> 24) AS copies
  FROM (SELECT *, ('0x' || left(md5('29:' || coalesce(source, '')), 6))::BIGINT AS o FROM along)
  UNION ALL SELECT doc_id, source, size, copies FROM marked WHERE copies IS NOT NULL)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM every e JOIN fair f ON e.source IS NOT DISTINCT FROM f.source
"""

_OP10 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict:
    return {"op9_mixing": _OP9, "op10_exact_dedup": _OP10}
