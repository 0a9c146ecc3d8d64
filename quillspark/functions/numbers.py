"""Arithmetic with the conventions of the metrics: ratios are 0 on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio0(a: Column, b: Column) -> Column:
    """a over b, 0 when b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio0(2 * p * r, p + r)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_norm(x: Column) -> Column:
    """Scores up to 1 as they are, larger ones as fifths, between 0 and 1; null counts as 0."""
    v = F.coalesce(x.cast("double"), F.lit(0.0))
    return F.when(v <= 0, 0.0).when(v <= 1, v).otherwise(F.least(v / 5, F.lit(1.0)))


def reward(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and the reward that weighs misses more than false alarms."""
    total = tp + fp + fn
    p, r, acc = ratio0(tp, tp + fp), ratio0(tp, tp + fn), ratio0(tp, total)
    f = f1(p, r)
    score = clamp01(0.35 * f + 0.25 * acc + 0.20 * p + 0.20 * r - 0.10 * ratio0(fp, total) - 0.20 * ratio0(fn, total))
    return {"accuracy": acc, "precision": p, "recall": r, "f1": f, "reward_score": score}


def month_value(c: Column) -> Column:
    """Months of a time point: the first number; years times 12, weeks over 4; null without a number."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    n = F.regexp_extract(low, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(low.rlike("year|年"), n * 12).when(low.rlike("week|周"), n / 4).otherwise(n)


def recency(seconds: Column) -> Column:
    """1 for what isn't in the past, else falling with the age in hours."""
    return F.when(seconds <= 0, 1.0).otherwise(1 / (1 + seconds / 3600))
