"""Traces too large for their field: cut to fit, with the whole kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shrink(rows: DataFrame, text: str, most: int, short: int, around: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their text cut to what fits in ``most`` bytes with ``around`` bytes of frame, and the whole rows that didn't.

    A text that is too large keeps its first ``short`` characters (minimal), or nothing if these are too many bytes (ultra).
    """
    said = F.coalesce(F.col(text), F.lit(""))
    whole, brief = F.octet_length(said) + around, F.octet_length(F.substring(said, 1, short)) + around
    form = F.when(whole <= most, "full").when(brief <= most, "minimal").otherwise("ultra")
    kept = F.when(F.col("form") == "full", F.col(text)).when(F.col("form") == "minimal", F.substring(text, 1, short)).otherwise("")
    marked = rows.withColumn("form", form)
    return marked.withColumn(text, kept).withColumn("bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))) + around), marked.filter("form != 'full'").drop("form")
