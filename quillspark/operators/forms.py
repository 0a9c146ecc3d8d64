"""Fields of forms and tables: labelled values, options, specifications, plans, header roles and table shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Words that tell the role of a header, in the order in which roles are tried.
HEADER_ROLES = {
    "limit": ("可接受标准", "接受标准", "质量标准", "限度", "specification"),
    "indicator_detail": ("明细项目", "子项目", "分项", "检测指标"),
    "indicator": ("考察项目", "检测项目", "检验项目", "质量指标", "testitem"),
    "result": ("检测结果", "测定结果", "实测值", "结果", "result"),
    "time_point": ("时间点", "考察时间", "考察周期", "时间", "month"),
    "batch_no": ("批号", "batch"),
    "orientation": ("放置方向", "方向"),
}
# Words of a title by type of document.
DOCUMENT_TYPES = {
    "approval": ("药品注册证书", "药品批准证明", "批准文号"),
    "license": ("药品生产许可证", "营业执照", "许可证编号"),
    "standard": ("药品注册标准", "质量标准", "标准编号"),
    "label": ("说明书", "标签"),
    "inspection": ("检验报告", "报告编号"),
    "stability": ("稳定性", "长期试验"),
}
# Containers and units of an explicit fill, and marks of a chosen and an open option.
CONTAINERS, FILL_UNITS = ("瓶", "支", "袋", "罐"), ("毫升", "ml", "mL", "克", "g")
CHOSEN, OPEN = "☑☒■√", "□☐"


def any_of(c: Column, words) -> Column:
    """Whether a text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def labelled_fields(c: Column, labels: list[str]) -> Column:
    """Values behind labels (label: value, or 【label】 value) as an array of (label, value); a value runs to the next label."""
    names = "|".join(sorted(labels, key=len, reverse=True))
    pattern = rf"(?:【({names})】\s*[:：]?|(?<![\w\x{{4e00}}-\x{{9fff}}])({names})\s*[:：])\s*"
    found = F.transform(F.regexp_extract_all(T.text(c), F.lit(pattern), F.lit(0)), lambda m: F.regexp_extract(m, f"({names})", 1))
    values = F.transform(F.slice(F.split(T.text(c), pattern), 2, 10_000), lambda v: F.regexp_replace(v, r"^[\s；;]+|[\s；;]+$", ""))
    return F.transform(F.arrays_zip(found.alias("label"), values.alias("value")), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))


def fill_volumes(c: Column) -> Column:
    """Explicit fills per container, as (volumes, the rest of the specification)."""
    value = F.regexp_replace(T.text(c), r"\s+", "")
    pattern = rf"每(?:{'|'.join(CONTAINERS)})\d+(?:\.\d+)?(?:{'|'.join(FILL_UNITS)})"
    rest = F.regexp_replace(F.regexp_replace(value, pattern, ""), r"[;；,，]+(?=[)）]|$)", "")
    return F.struct(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("volumes"), rest.alias("content"))


def planned_items(c: Column) -> Column:
    """Planned items between marks outside brackets, each with the months its bracket names."""
    parts = F.split(T.text(c), r"[、;；](?![^（(]*[）)])")
    months = lambda p: F.regexp_extract_all(F.regexp_extract(p, r"[（(]([^）)]*)[）)]", 1), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    items = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^（(]*)", 1)).alias("name"), months(p).cast("array<double>").alias("months")))
    return F.filter(items, lambda x: (x["name"] != "") & ~x["name"].rlike(r"^[\d、,，.]+(?:个)?月"))


def option_state(c: Column, option: str, options: list[str]) -> Column:
    """selected, open, or unclear if the option has no mark of its own; options that hold it are looked past."""
    value = T.text(c)
    for other in sorted(options, key=len, reverse=True):
        if option in other and other != option:
            value = F.replace(value, F.lit(other), F.lit(" "))
    return F.when(value.rlike(rf"[{CHOSEN}]\s*{option}"), "selected").when(value.rlike(rf"[{OPEN}]\s*{option}"), "open").otherwise("unclear")


def validity(c: Column) -> Column:
    """Months of a shelf life in years and months, as text; else the text without blanks."""
    value = F.regexp_replace(T.text(c), r"\s+", "")
    years = F.regexp_extract(value, r"^(\d+)年(?:(\d+)个?月)?$", 1).try_cast("int")
    more = F.coalesce(F.regexp_extract(value, r"^(\d+)年(?:(\d+)个?月)?$", 2).try_cast("int"), F.lit(0))
    months = F.regexp_extract(value, r"^(\d+)个?月$", 1).try_cast("int")
    return F.coalesce((years * 12 + more).cast("string"), months.cast("string"), value)


def header_role(c: Column) -> Column:
    """The role of a header cell; blank if none."""
    value = F.regexp_replace(F.lower(T.text(c)), r"[\s/\\()（）]+", "")
    out = F.lit("")
    for role, words in reversed(HEADER_ROLES.items()):
        out = F.when(any_of(value, words), role).otherwise(out)
    return out


def document_types(title: Column) -> Column:
    """All types whose words a title holds."""
    return F.array_compact(F.array(*[F.when(any_of(title, words), kind) for kind, words in DOCUMENT_TYPES.items()]))


def table_kind(body: Column, heading: Column, caption: Column) -> Column:
    """What a table is, from all its cells, its first three rows and its caption; the first that fits."""
    has = lambda c, *words: any_of(c, words)
    planned, measured = ("研究方案", "试验方案", "计划时间", "取样计划"), ("检测结果", "实测值", "测定结果")
    return (
        F.when(has(body, "原申报") & has(body, "修订后"), "quality_standard_revision")
        .when(has(body, "报告单编号") & has(body, "报告时间"), "report_explanation")
        .when((has(body, "考察时间") & has(body, "检测标准") & has(body, "变化")) | has(caption, "标准版本变化"), "standard_version_timeline")
        .when(has(heading, "样品信息") & has(heading, "批号"), "sample_source")
        .when((has(caption, *planned) | has(heading, *planned)) & ~has(heading, *measured), "study_plan")
        .when(has(heading, "时间") & has(heading, "指标") & has(heading, "结果") & has(heading, "限度"), "stability_result")
        .when(has(body, *measured) & has(body, "考察项目", "检测项目", "检验项目", "质量指标"), "stability_result")
        .otherwise("generic")
    )


def entity_terms(c: Column, patterns: list[str]) -> Column:
    """The first match of each pattern, trimmed of marks, distinct by letters whatever their case."""
    found = F.array(*[F.regexp_replace(F.regexp_extract(T.text(c), f"(?i){p}", 1), r"^[ ;,:；，。]+|[ ;,:；，。]+$", "") for p in patterns])
    kept = F.filter(found, lambda x: x != "")
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def padded(rows: Column) -> Column:
    """Rows of cells, all as wide as the widest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def collapse_columns(rows: Column) -> Column:
    """Rows without the columns that repeat the one before them in every row."""
    even = padded(rows)
    width = F.array_max(F.transform(rows, F.size))
    kept = F.filter(F.sequence(F.lit(0), width - 1), lambda i: (i == 0) | F.exists(even, lambda r: F.get(r, i) != F.get(r, i - 1)))
    return F.transform(even, lambda r: F.transform(kept, lambda i: F.get(r, i)))


def joined_header(rows: Column) -> Column:
    """One header from stacked ones: the cells of a column joined by ' / ', without blanks and repeats in a row."""
    even = padded(rows)
    width = F.array_max(F.transform(rows, F.size))

    def column(i: Column) -> Column:
        cells = F.filter(F.transform(even, lambda r: T.strip(F.get(r, i))), lambda x: x != "")
        fresh = F.filter(cells, lambda x, n: (n == 0) | (x != F.get(cells, n - 1)))
        return F.array_join(fresh, " / ")

    return F.transform(F.sequence(F.lit(0), width - 1), column)


def find_header(tables: DataFrame, key: str, rows: str, starts: int = 15, depths: int = 3) -> DataFrame:
    """key, start, depth and headers of the best stacked header among the first rows, by the roles it shows."""
    n = F.size(rows)
    at = F.explode(F.sequence(F.lit(0), F.least(n, F.lit(starts)) - 1)).alias("start")
    deep = F.explode(F.sequence(F.lit(1), F.least(F.lit(depths), F.size(rows) - F.col("start")))).alias("depth")
    tried = tables.select(key, rows, at).select(key, rows, "start", deep)
    tried = tried.withColumn("headers", joined_header(F.slice(F.col(rows), F.col("start") + 1, F.col("depth"))))
    tried = tried.withColumn("roles", F.transform("headers", header_role))
    shows = lambda *names: F.exists("roles", lambda r: r.isin(*names)).cast("int")
    times = F.size(F.filter(F.arrays_zip("headers", "roles"), lambda x: x["roles"].isin("", "result") & x["headers"].rlike(r"(?i)\d+(?:\.\d+)?\s*(?:月|年|天|month)|起始|初始|正置|倒置")))
    score = 6 * shows("indicator", "indicator_detail") + 6 * shows("limit") + 4 * shows("result") + 3 * shows("time_point") + 2 * F.least(times, F.lit(6)) + shows("batch_no") - (F.col("depth") - 1)
    best = F.max_by(F.struct("start", "depth", "headers"), F.struct(score, -F.col("start"), -F.col("depth")))
    return tried.groupBy(key).agg(best.alias("b"), F.max(score).alias("score")).select(key, "b.start", "b.depth", "b.headers", "score")


def records(header: Column, row: Column) -> Column:
    """A row of a long table as a map from the role, or else the name, of its headers."""
    names = F.transform(header, lambda h: F.when(header_role(h) != "", header_role(h)).otherwise(h))
    cells = F.transform(F.sequence(F.lit(0), F.size(header) - 1), lambda i: F.coalesce(F.get(row, i), F.lit("")))
    return F.map_from_arrays(names, cells)


def continues(columns: Column, before: Column) -> Column:
    """Whether a table goes on with the one before: equal columns, or as many and all but one equal."""
    same = F.size(F.filter(F.arrays_zip(columns.alias("a"), before.alias("b")), lambda x: x["a"] == x["b"]))
    near = (F.size(columns) == F.size(before)) & (same >= F.greatest(F.lit(2), F.size(columns) - 1))
    return F.coalesce((F.size(columns) > 0) & ((columns == before) | near), F.lit(False))
