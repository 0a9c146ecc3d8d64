"""Filters, joins, windows and pages over tables with named role columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_all(rows: DataFrame, *, like: dict | None = None, equal: dict | None = None, since: tuple | None = None, until: tuple | None = None) -> DataFrame:
    """AND of the predicates whose value isn't blank.

    ``like`` ignores case and leaves the user's % and _ as wildcards; ``since`` and ``until`` are (column, value) and
    compare as strings.
    """
    tests = [F.col(c).ilike(f"%{v.strip()}%") for c, v in (like or {}).items() if v and v.strip()]
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v is not None and str(v).strip() != ""]
    tests += [F.col(c) >= v for c, v in [since or ("", "")] if v] + [F.col(c) <= v for c, v in [until or ("", "")] if v]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def like_any(rows: DataFrame, tokens: list[str], columns: list[str]) -> DataFrame:
    """Rows of which any column holds any of at most eight tokens, case ignored."""
    tests = [F.col(c).ilike(f"%{t}%") for t in tokens[:8] for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, tests)) if tests else rows


def live_sources(rows: DataFrame, deleted: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """Rows whose source isn't deleted and, if asked, is in scope."""
    kept = rows.join(deleted.select(key), key, "left_anti")
    return kept if scope is None else kept.filter(scope)


def section_matches(section: Column, pattern: Column) -> Column:
    """``a.*`` or ``a``: the section itself or one below, case ignored."""
    p = F.regexp_replace(F.lower(F.trim(pattern)), r"\.\*$", "")
    s = F.lower(F.trim(section))
    return (s == p) | s.startswith(F.concat(p, F.lit(".")))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int | None = None) -> DataFrame:
    """One page of ordered rows; number and size are at least 1, and size at most ``most``."""
    size = max(1, size if most is None else min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_total(rows: DataFrame, size: int) -> DataFrame:
    """Rows and pages of a listing."""
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / max(1, size)).cast("long"))


def nth_per(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1, name: str | None = None) -> DataFrame:
    """The first ``most`` rows of each key in the order given; ``name`` keeps their rank."""
    ranked = rows.withColumn(name or "__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name or "__nth") <= most)
    return kept if name else kept.drop("__nth")


def carry_forward(rows: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """Blank cells take the last value before them."""
    value = F.nullif(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit("")))


def islands(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "island") -> DataFrame:
    """Number runs of equal values in order, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return rows.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def global_rank(rows: DataFrame, lead: Column, rest: list[Column], name: str, falling: bool = False) -> DataFrame:
    """Number all rows from 1 along ``lead`` (from the largest if ``falling``) and then ``rest``.

    Rows are numbered inside each value of ``lead``, after the counts of the values before; only the distinct values meet in one task.
    """
    led = rows.withColumn("__lead", lead)
    first = F.desc_nulls_last("__lead") if falling else F.asc_nulls_first("__lead")
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    counts = led.groupBy("__lead").agg(F.count("*").alias("__n"))
    starts = counts.select(F.col("__lead").alias("__value"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = led.withColumn("__nth", F.row_number().over(Window.partitionBy("__lead").orderBy(*rest)))
    joined = inside.join(starts, F.col("__lead").eqNullSafe(F.col("__value")))
    return joined.withColumn(name, F.col("__start") + F.col("__nth")).drop("__lead", "__value", "__start", "__nth")


def scope_join(items: DataFrame, rules: DataFrame, path: str, scope: str) -> DataFrame:
    """Items with each rule whose scope is 'all', their dotted path or a prefix of it, as an equi-join on the prefixes."""
    parts = F.split(F.col(path), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return items.withColumn(scope, F.explode(F.concat(F.array(F.lit("all")), prefixes))).join(rules, scope)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Pairs of half-open ranges (start, stop) of a and (begin, finish) of b that overlap, with the length they share.

    With ``width`` ranges meet only in the stretches of that length that both touch, so a key of many ranges isn't
    compared pair by pair; each pair counts in the stretch where the later of the two starts.
    """
    if width is not None:
        bins = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor((F.greatest(F.col(y), F.col(x) + 1) - 1) / width)))
        a, b = a.withColumn("__bin", bins("start", "stop")), b.withColumn("__bin", bins("begin", "finish"))
        joined = a.join(b, [*keys, "__bin"]).filter(F.col("__bin") == F.floor(F.greatest("start", "begin") / width)).drop("__bin")
    else:
        joined = a.join(b, keys)
    return joined.filter("start < finish AND begin < stop").withColumn("shared", F.least("stop", "finish") - F.greatest("start", "begin"))


def _alike(rows: DataFrame, by: list[str], name: str, most: int = 128) -> DataFrame:
    """Rows that agree in ``by`` as arrays of the rest of about ``most`` at a time; rows with a null in ``by`` are left out."""
    rest = [F.col(c) for c in rows.columns if c not in by] or [F.lit(True).alias(f"{name}_row")]
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("__parts"))
    large = parts.filter("__parts > 1")
    rows = rows.join(large, by, "left").withColumn("__part", F.pmod(F.xxhash64(*rest), F.coalesce("__parts", F.lit(1))))
    return rows.groupBy(*by, "__part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__part")


def box_join(outer: DataFrame, inner: DataFrame, keys: list[str], wide: float, high: float) -> DataFrame:
    """Boxes (x0, x1, y0, y1) with the boxes (u0, u1, v0, v1) inside them, met in the grid cell of the inner corner.

    Equal boxes of a key meet once, as arrays of their rows; pairs of rows are only made where the boxes fit. Few bytes make many pairs, so the number
    of tasks isn't left to sizes.
    """
    spark = outer.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 200)
    cells = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    spread = _alike(outer, [*keys, "x0", "x1", "y0", "y1"], "__o").withColumn("__x", cells("x0", "x1", wide)).withColumn("__y", cells("y0", "y1", high))
    placed = _alike(inner, [*keys, "u0", "u1", "v0", "v1"], "__i").withColumns({"__x": F.floor(F.col("u0") / wide), "__y": F.floor(F.col("v0") / high)})
    at = [*keys, "__x", "__y"]
    met = spread.repartition(tasks, *at).join(placed.repartition(tasks, *at), at).filter("x0 <= u0 AND x1 >= u1 AND y0 <= v0 AND y1 >= v1")
    pairs = met.select("*", F.inline("__o")).select("*", F.inline("__i"))
    return pairs.select(*keys, *[c for d in (outer, inner) for c in d.columns if c not in keys])


def containment_join(a: DataFrame, b: DataFrame, left: str, right: str, opening: int = 4) -> DataFrame:
    """Distinct pairs (left, right) of non-empty texts of which one holds the other.

    A text held starts somewhere in its holder, so its opening letters, at most ``opening``, are among the holder's
    substrings of that length: pairs meet by these and are then verified.
    """

    def held(inner: DataFrame, i: str, holder: DataFrame, h: str) -> DataFrame:
        opens = inner.filter(F.length(i) > 0).withColumn("__gram", F.substring(i, 1, opening))
        sizes = F.sequence(F.lit(1), F.least(F.length(h), F.lit(opening)))
        text = F.col(h)
        grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n))))
        # Shorter openings than the rule are whole texts; they are looked for at their own length.
        spread = holder.filter(F.length(h) > 0).withColumn("__gram", F.explode(F.array_distinct(grams)))
        return spread.join(opens, "__gram").filter(F.col(h).contains(F.col(i))).select(left, right)

    return held(a, left, b, right).union(held(b, right, a, left)).distinct()


def greedy_budget(items: Column, most_items: int, most_chars: int) -> Column:
    """Pick structs (id, size, sig) in order: skip a signature seen among the picked and what no longer fits, stop at most_items."""
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), F.expr("cast(array() as array<string>)").alias("sigs"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) < most_items) & (acc["used"] + x["size"] <= most_chars) & ~F.array_contains(acc["sigs"], x["sig"])
        taken = F.struct(F.concat(acc["ids"], F.array(x["id"])).alias("ids"), F.concat(acc["sigs"], F.array(x["sig"])).alias("sigs"), (acc["used"] + x["size"]).alias("used"))
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(items, start, step)["ids"]


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the last row of ``right`` at or before it, by key; null without one.

    ``at`` is a number in both. Time is cut into stretches of ``width``: rows meet inside theirs, and the last value of the
    stretches before is carried in, so a key with much history is many tasks.
    """
    side = lambda df, is_right: df.withColumns({"__right": F.lit(is_right), "__bin": F.floor(F.col(at) / width)})
    known = side(right.select(*keys, at, F.col(value).alias("__value")), True)
    asked = side(left, False)
    order = Window.partitionBy(*keys, "__bin").orderBy(at, F.desc("__right"), "__value")
    both = asked.withColumn("__value", F.lit(None).cast(known.schema["__value"].dataType)).unionByName(known, allowMissingColumns=True)
    inside = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("__inside", inside).filter(~F.col("__right")).drop("__right", "__value")
    tops = known.groupBy(*keys, "__bin").agg(F.max_by("__value", F.struct(at, "__value")).alias("__top"))
    marks = tops.unionByName(asked.select(*keys, "__bin").distinct(), allowMissingColumns=True).groupBy(*keys, "__bin").agg(F.first("__top", ignorenulls=True).alias("__top"))
    carried = F.last("__top", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("__carried", carried).drop("__top")
    return inside.join(marks, [*keys, "__bin"], "left").withColumn(value, F.coalesce("__inside", "__carried")).drop("__inside", "__carried", "__bin")


def feature_flags(overrides: Column, defaults: dict[str, bool]) -> Column:
    """A map of all known flags; an override counts only for a known key and if it says true or false."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    known = F.map_filter(overrides, lambda k, v: k.isin(*defaults) & v.isin("true", "false"))
    said = F.transform_values(known, lambda _, v: v == "true")
    return F.map_zip_with(base, said, lambda _, a, b: F.coalesce(b, a))


def deep_merge(a: Column, b: Column) -> Column:
    """Maps of maps: keys of both, the second one's values over the first one's."""
    inner = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.map_zip_with(x, y, lambda _, p, q: F.coalesce(q, p)))
    return F.map_zip_with(a, b, lambda _, x, y: inner(x, y))


def replace_documents(current: DataFrame, fresh: DataFrame, key: str, force: bool) -> DataFrame:
    """An index after documents came in: forced ones replace their old entries, others only come in if they are new."""
    if force:
        return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
    return current.unionByName(fresh.join(current.select(key).distinct(), key, "left_anti"))


def late_rows(rows: DataFrame, batch: Column, at: str, allowed: int) -> DataFrame:
    """Mark rows that come after the watermark of the batches before them: the largest time seen less what is allowed.

    Batches, not rows, go through one task for the running maximum.
    """
    numbered = rows.withColumn("__batch", batch)
    tops = numbered.groupBy("__batch").agg(F.max(at).alias("__top"))
    before = Window.orderBy("__batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = tops.withColumn("__mark", F.max("__top").over(before) - allowed).drop("__top")
    return numbered.join(marks, "__batch").withColumn("late", F.coalesce(F.col(at) < F.col("__mark"), F.lit(False))).drop("__batch", "__mark")
