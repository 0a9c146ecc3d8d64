"""User functions as plug-ins: parsers, embedders and models by name, SQL functions, and a chunking table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MODELS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register_model(task: str, model: Callable[[pd.Series], pd.Series]) -> None:
    """A model for a task; it takes and gives a batch of texts."""
    _MODELS[task] = model


def model(task: str) -> Callable[[Column], Column]:
    """The model of a task as a column function; without one, a null model that gives nothing back."""
    chosen = _MODELS.get(task)
    if chosen is None:
        return lambda c: F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return chosen(texts)

    return run


def embedder(dim: int = 8) -> Callable[[Column], Column]:
    """Counts of code points by remainder, scaled to length one: a stand-in with the shape of a real embedder.

    Batches are embedded at once; a batch that fails is taken text by text, and a text that fails is null.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) % dim, minlength=dim).astype(float)
            return (v / max(np.sqrt((v * v).sum()), 1.0)).tolist()

        def safe(t):
            try:
                return one(t)
            except Exception:  # noqa: BLE001
                return None

        try:
            return texts.map(one)
        except Exception:  # noqa: BLE001
            return texts.map(safe)

    return embed


def parallel_map(rows: DataFrame, column: str, function: Callable[[str], str], result: str = "mapped") -> DataFrame:
    """A Python function over every item of a list column, in order, as Arrow batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[result] = [None if items is None else [function(x) for x in items] for items in frame[column]]
            yield frame

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInPandas(run, ", ".join([*kinds, f"`{result}` array<string>"]))


def register_sql(spark: SparkSession) -> None:
    """SQL functions of this library, for users who write SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ratio0(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b > 0 THEN a / b ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clamp01(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, x))")


def windows():
    """A table function that cuts a text into pieces of a size with an overlap."""

    class Windows:
        def eval(self, text: str, size: int, overlap: int):
            if text:
                start = 0
                while True:
                    yield start, text[start : start + size]
                    if start + size >= len(text):
                        break
                    start += size - overlap

    return F.udtf(Windows, returnType="start int, piece string")
