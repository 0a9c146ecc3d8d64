"""Readers by file extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register_reader(extension: str, reader: Reader) -> None:
    _READERS[extension.lower().lstrip(".")] = reader


def read(spark: SparkSession, path: str, hint: str = "") -> DataFrame:
    """Read a path by its extension, which wins over the hint; an unknown type names those that are known."""
    name = path.rstrip("/").rpartition("/")[2]
    kind = (name.rpartition(".")[2] if "." in name else hint).lower().lstrip(".")
    if kind not in _READERS:
        raise ValueError(f"no reader for '{kind}'; known: {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, path)


register_reader("txt", lambda spark, path: spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))
register_reader("md", lambda spark, path: spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))
register_reader("jsonl", lambda spark, path: spark.read.json(path))
register_reader("json", lambda spark, path: spark.read.json(path, multiLine=True))
register_reader("csv", lambda spark, path: spark.read.csv(path, header=True))
register_reader("parquet", lambda spark, path: spark.read.parquet(path))
