"""Streaming twins of the task operators: windows with watermarks and the lifecycle as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of event time; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: events closer than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def lifecycle(events: DataFrame, claim: str, finish: str, keep: str = "PT2H") -> DataFrame:
    """State changes per user: pending, running from the first claim, completed for good at the first finish.

    Events are folded in order of (ts, event_id) inside a batch; what follows the end has no effect. The state of a user who
    sends nothing for ``keep`` (processing time) is dropped, so state doesn't grow with all users ever seen.
    """

    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, count = state.get if state.exists else ("pending", 0)
        # Only what the fold looks at is held of a batch.
        rows = pd.concat([f[["ts", "event_id", "event_type"]] for f in frames]).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if now == "completed":
                break
            count += 1
            now = "completed" if kind == finish else "running" if kind == claim else now
        state.update((now, count))
        state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "effective_events": [count]})

    return events.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, state string, effective_events long", "state string, effective_events long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def copy_once(spark: SparkSession, source: str, schema, sink: str, log: str) -> None:
    """Move what is new in a folder to another, a file a batch; the log remembers what was taken."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", log).format("parquet").start(sink).awaitTermination()
