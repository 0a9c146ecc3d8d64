"""A training corpus in five stages: quality, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and returns a DataFrame with
the columns of documents; the last returns the encoded corpus. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again; given the folder of an earlier run it goes on where that one stopped.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, jaccard_join, mixing, perplexity, pieces
from quillspark.llm.common import shared_folder
from quillspark.llm.queries import tokenizer_path

#: SQL has no SentencePiece, n-gram join or smoothed language model; tests use brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's bound."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return perplexity.judge(docs, trusted).filter("__kept").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    return mixing.draw(docs, weights=[5, 2, 1], percent=150, most=2)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document taken, with digests of ids and of the text they decode to."""
    return pieces.encode_ids(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("token_ids", token_ids)]


def _done(spark: SparkSession, marker: str) -> bool:
    """Whether a stage was written to its end; its marker, a table of one row, comes after."""
    try:
        return spark.read.schema("id long").parquet(marker).count() > 0
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, each written and read again. With a folder of a run that broke off, its finished stages are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        if not _done(spark, f"{folder}/{name}-done"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
            spark.range(1).write.mode("overwrite").parquet(f"{folder}/{name}-done")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
