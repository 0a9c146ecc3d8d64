"""Round trips through files and views: JSON lines, text files, SQL text, and snapshots of a vector table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import registry


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines see: below spark.checkpoint.dir, or, where Spark runs in one process, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="exchange-")
    return f"{named}/exchange-{uuid.uuid4().hex}"


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, so no field is lost on the way back."""
    rows.write.option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_texts(rows: DataFrame, text: str, path: str) -> None:
    """One text a line, with line ends and backslashes escaped."""
    safe = F.replace(F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    rows.select(safe.alias("value")).write.text(path)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL text over data frames named in braces."""
    return spark.sql(sql, **tables)


def export_snapshot(rows: DataFrame, path: str) -> None:
    """All rows of a vector table as JSON."""
    rows.write.option("ignoreNullFields", "false").json(path)


def import_snapshot(current: DataFrame, path: str, key: str, replace: bool) -> DataFrame:
    """The table after the snapshot's rows came in: in place of all, or of those with the same key."""
    found = current.sparkSession.read.schema(current.schema).json(path)
    return found if replace else current.join(found.select(key), key, "left_anti").unionByName(found)


def read_any(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of every path by the reader of its extension, as (name, kind, rows)."""
    out = None
    for name, path in sorted(paths.items()):
        kind = path.rstrip("/").rpartition(".")[2].lower()
        one = registry.read(spark, path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
