"""Feedback and replay metrics: confusion, case scores, totals, version gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.numbers import f1, ratio0, reward


def confusion(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """tp, fp, fn of valid, false_positive and missed per key, with the reward's parts."""
    count = lambda v: F.count_if(F.col(kind) == v)
    out = rows.groupBy(*keys).agg(count("valid").alias("tp"), count("false_positive").alias("fp"), count("missed").alias("fn"))
    return out.withColumns(reward(F.col("tp"), F.col("fp"), F.col("fn")))


def set_scores(expected: Column, actual: Column) -> dict[str, Column]:
    """Counts and precision, recall, F1 of two sets."""
    tp, fp, fn = F.size(F.array_intersect(expected, actual)), F.size(F.array_except(actual, expected)), F.size(F.array_except(expected, actual))
    p, r = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": f1(p, r)}


def review_case(success: Column, conclusion: Column, risk: Column, finding_f1: Column, rule_f1: Column) -> Column:
    """The composite of a case; 0 when its replay failed. ``risk`` matches when both sides are blank, not when one is."""
    score = 0.55 * F.when(conclusion, 1.0).otherwise(0.0) + 0.15 * F.when(risk, 1.0).otherwise(0.0) + 0.20 * finding_f1 + 0.10 * rule_f1
    return F.when(success, score).otherwise(0.0)


def version_gain(baseline: DataFrame, candidate: DataFrame, key: str, score: str) -> DataFrame:
    """One row: wins, losses and ties of cases, a missing side scoring 0, the mean difference and the verdict."""
    b, c = baseline.select(key, F.col(score).alias("b")), candidate.select(key, F.col(score).alias("c"))
    d = F.col("c") - F.col("b")
    cases = b.join(c, key, "full_outer").fillna(0.0, ["b", "c"])
    out = cases.agg(F.count_if(d > 1e-9).alias("wins"), F.count_if(d < -1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"))
    means = baseline.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mb")).crossJoin(candidate.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mc")))  # one row each
    out = out.crossJoin(means).withColumn("delta", F.col("mc") - F.col("mb"))
    verdict = F.when((F.col("delta") > 1e-9) & (F.col("losses") == 0), "candidate_preferred").when((F.col("delta") < -1e-9) | (F.col("losses") > F.col("wins")), "candidate_rejected").otherwise("manual_review_required")
    return out.withColumn("recommendation", verdict).drop("mb", "mc")
