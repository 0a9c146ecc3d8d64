"""Queries over the driver tables, one per inventory id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine
from quillspark.plans import bind_facts, bind_forms, bind_more, bind_relational, bind_rest, bind_review, bind_rules, bind_spark, bind_text  # noqa: F401
from quillspark.plans.registry import register
from quillspark.sources.tables import table


@register(
    "topk_vector",
    """WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score
FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) DESC, vec_id LIMIT 10""",
)
def topk_vector(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("qv"))
    scored = rows.crossJoin(F.broadcast(query)).select("vec_id", "label", cosine(F.col("embedding"), F.col("qv")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("score"))
