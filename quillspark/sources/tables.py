"""Readers for the star-schema and corpus tables, addressed by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; works with any store Spark can read."""
    return spark.read.parquet(f"{root}/{name}.parquet")
