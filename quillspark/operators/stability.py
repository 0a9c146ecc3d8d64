"""Stability records: enrichment, units, coverage of plans, significant change, risk and conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.numbers import month_value
from quillspark.operators import limits
from quillspark.operators.review import LACKING, PASSED, PROBLEM


def enrich(rows: DataFrame, time: str, result: str, uncertain: Column) -> DataFrame:
    """month, value and kind of each result; uncertain numbers give no value.

    Kinds: exact, not_detected, boundary (starts with a comparison), composite (parts between semicolons), qualitative.
    """
    raw = F.trim(F.coalesce(F.col(result), F.lit("")))
    q = limits.quantity(limits.normalise(raw))
    value = F.when(q["low"] == q["high"], q["low"].cast("double"))
    kind = (
        F.when(uncertain, "numeric_uncertain").when(value.isNotNull(), "exact").when(F.upper(raw).isin("ND", "未检出"), "not_detected")
        .when(raw.rlike("^[<>≤≥]"), "boundary").when(raw.rlike("[;；]"), "composite").otherwise("qualitative")
    )
    return rows.withColumns({"month": month_value(F.col(time)), "value": F.when(~uncertain, value), "kind": kind})


def split_by_unit(rows: DataFrame, keys: list[str], indicator: str, unit: str) -> DataFrame:
    """Indicators of more than one unit get the unit in their name; those of one keep it."""
    named = F.coalesce(F.nullif(F.trim(F.col(unit)), F.lit("")), F.lit("单位未知"))
    units = rows.groupBy(*keys, indicator).agg((F.count_distinct(F.coalesce(F.col(unit), F.lit(""))) > 1).alias("__several"))
    label = F.when(F.col("__several"), F.concat(F.col(indicator), F.lit(" ["), named, F.lit("]"))).otherwise(F.col(indicator))
    return rows.join(units, [*keys, indicator]).withColumn("series", label).drop("__several")


def coverage(rows: DataFrame, plan: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Of each series (keys, month, result) whether its end point is missing, blank results, and planned months without one.

    ``plan`` has (keys, month); later months than the target aren't asked for.
    """
    blank = F.trim(F.coalesce("result", F.lit(""))).isin("", "/")
    seen = rows.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("month") == target), F.lit(False)).alias("has_end"), F.count_if(blank).alias("blanks"))
    wanted = plan.filter(F.col("month") <= target).select(*keys, "month").distinct()
    gaps = wanted.join(rows.filter(~blank).select(*keys, "month").distinct(), [*keys, "month"], "left_anti").groupBy(*keys).agg(F.count("*").alias("gaps"))
    joined = seen.join(gaps, keys, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    lacking = ~F.col("has_end") | (F.col("blanks") > 0) | (F.col("gaps") > 0)
    return joined.withColumn("status", F.when(lacking, "存在缺口").otherwise("已核对"))


def criterion(text: Column) -> Column:
    """A written criterion as (indicator, condition, change, strict, threshold); null unless it names all of them and its basis."""
    part = lambda key: F.trim(F.regexp_extract(text, key + r"=([^;；]+)", 1))
    change = r"(绝对变化|下降|上升)\s*([>≥])\s*(\d+(?:\.\d+)?)\s*(?:%|mg/g|个百分点)"
    threshold = F.regexp_extract(text, change, 3).try_cast("double")
    named = F.struct(
        part("项目").alias("indicator"), part("适用条件").alias("condition"), F.regexp_extract(text, change, 1).alias("change"), (F.regexp_extract(text, change, 2) == ">").alias("strict"), threshold.alias("threshold")
    )
    return F.when((part("项目") != "") & (part("适用条件") != "") & (part("依据") != "") & threshold.isNotNull(), named)


def significant(points: DataFrame, criteria: DataFrame, group: list[str]) -> DataFrame:
    """Verdict of every point (group, indicator, condition, month, value) after month 0 by the criterion on its indicator.

    A group without exactly one value at month 0 lacks its basis.
    """
    c = criteria.select(criterion(F.col("text")).alias("c")).filter("c IS NOT NULL").select("c.*")
    zero = F.col("month") == 0
    base = points.groupBy(*group, "indicator", "condition").agg(F.count_distinct(F.when(zero, F.col("value"))).alias("n"), F.max(F.when(zero, F.col("value"))).alias("base"))
    later = points.filter(~zero).join(base, [*group, "indicator", "condition"]).join(c, ["indicator", "condition"])
    delta = F.col("value") - F.col("base")
    size = F.when(F.col("change") == "绝对变化", F.abs(delta)).when(F.col("change") == "下降", -delta).otherwise(delta)
    hit = F.when(F.col("strict"), size > F.col("threshold")).otherwise(size >= F.col("threshold"))
    return later.withColumn("status", F.when((F.col("n") != 1) | F.col("value").isNull(), LACKING).when(hit, PROBLEM).otherwise(PASSED))


def risk(within: str, numeric: str, near: str) -> Column:
    """The risk of a series from its limit decisions: high if any is out, open without numbers, middling if any is undecided or near."""
    out = F.coalesce(F.bool_or(~F.col(within)), F.lit(False))
    undecided = F.bool_or(F.col(within).isNull() | F.coalesce(F.col(near), F.lit(False)))
    return F.when(out, "高").when(~F.bool_or(F.col(numeric)), "待确认").when(undecided, "中").otherwise("低")


def conclusion(records: Column, out: Column, short: Column, undecided: Column, missing: Column, known: Column, significance: Column, conflicts: Column) -> Column:
    """The verdict on a longer shelf life; support is only kept if requirements, significance and records are beyond doubt."""
    doubt = ~known | (significance != PASSED) | (conflicts > 0)
    return (
        F.when(records == 0, "需补充资料").when(out > 0, "不支持延长").when((undecided > 0) & ~short, "需人工确认")
        .when(missing > 0, "需补充资料").when(doubt, "需人工确认").otherwise("支持延长")
    )
