"""Connected components of links as DataFrames: labels shrink to the smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): id and component, the smallest id it can reach. Ids without links are not listed.

    Each round passes the smaller label along every link, from both ends and through the label's own label, so the
    longest chain of labels halves; rounds stop when no label changes. Links and labels stay distributed. The members of a giant
    component meet its label in a sort-merge join whose parts Spark splits as they run (adaptive skew join); what members find is combined before
    it is sent. Each round's shuffles are let go. Every id is linked with itself, which brings it its own label with its
    neighbours', and a label's node gets what members found in the same grouping as these: a round has few exchanges, as the driver keeps a record of every task.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]))
    both = cut(links.select(ends.alias("x")).select("x.a", "x.b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        passed = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        near = passed.groupBy("a").agg(F.min("component").alias("c1"), F.min(F.expr("CASE WHEN a = b THEN component END")).alias("own"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("c2"))
        found = near.join(jump, F.col("own") == F.col("via")).select("a", "own", F.least("c1", "c2").alias("best"))
        # The label's node also takes what its members have found.
        given = F.explode(F.array(F.struct(F.col("a").alias("id"), "best", "own"), F.struct(F.col("own").alias("id"), "best", F.lit(None).cast("long").alias("own"))))
        new = found.select(given.alias("x")).select("x.*").groupBy("id").agg(F.min("best").alias("component"), F.min("own").alias("old"))
        new = cut(new)
        changed = new.filter("old != component").limit(1).count()
        labels = new.select("id", "component")
        del passed, near, jump, found, new
        release(links.sparkSession)
        if not changed:
            return labels
