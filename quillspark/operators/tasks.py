"""Long-running tasks as folds over their events: lifecycle, staleness, pruning, latest attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lifecycle(events: DataFrame, task: str, kind: str, order: list[Column], claim: Column, finish: Column) -> DataFrame:
    """State per task: running after its first claim, final at its first finish; later events don't change a final state."""
    w = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("__final", F.coalesce(F.max(finish.cast("int")).over(w), F.lit(0)) == 1)
    live = seen.filter("not __final")
    state = F.when(F.max(finish.cast("int")) == 1, "completed").when(F.max(claim.cast("int")) == 1, "running").otherwise("pending")
    return live.groupBy(task).agg(state.alias("state"), F.count("*").alias("effective_events"))


def stale(tasks: DataFrame, seen: str, now: Column, seconds: int) -> DataFrame:
    """Tasks last seen longer ago than the limit become failed."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(seen).cast("timestamp"))
    return tasks.withColumn("status", F.when(age > seconds * 1_000_000, "failed").otherwise("running"))
