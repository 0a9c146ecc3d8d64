"""Documents cut into chunks, as folds over sentence arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

_NONE = "cast(array() as array<string>)"


def split_long(c: Column, limit: int) -> Column:
    """Sentences packed greedily, joined by a space, while they fit; longer ones cut into slices of the limit."""
    whole = T.norm_ws(c)

    def step(acc: Column, s: Column) -> Column:
        out, held = acc["out"], acc["held"]
        flushed = F.when(held != "", F.concat(out, F.array(held))).otherwise(out)
        starts = F.sequence(F.lit(1), F.length(s), F.lit(limit))
        cut = F.filter(F.transform(starts, lambda i: T.strip(F.substring(s, i, F.lit(limit)))), lambda x: x != "")
        joined = F.when(held == "", s).otherwise(F.concat(held, F.lit(" "), s))
        state = lambda a, b: F.struct(a.alias("out"), b.alias("held"))
        return (
            F.when(F.length(s) > limit, state(F.concat(flushed, cut), F.lit("")))
            .when(F.length(held) + F.length(s) + 1 <= limit, state(out, joined))
            .otherwise(state(flushed, s))
        )

    start = F.struct(F.expr(_NONE).alias("out"), F.lit("").alias("held"))
    packed = F.aggregate(T.sentences(whole), start, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))
    return F.when(whole == "", F.expr(_NONE)).when(F.length(whole) <= limit, F.array(whole)).otherwise(packed)


def merge_small(segments: Column, least: int, limit: int) -> Column:
    """Segments below ``least`` join the next; a joined one over the limit is cut anew, a small last one joins the one before."""

    def step(acc: Column, s: Column) -> Column:
        out, held = acc["out"], acc["held"]
        joined = F.concat(held, F.lit(" "), s)
        state = lambda a, b: F.struct(a.alias("out"), b.alias("held"))
        return (
            F.when(held == "", state(out, s))
            .when((F.length(held) < least) & (F.length(joined) > limit), state(F.concat(out, split_long(joined, limit)), F.lit("")))
            .when(F.length(held) < least, state(out, joined))
            .otherwise(state(F.concat(out, F.array(held)), s))
        )

    def finish(acc: Column) -> Column:
        out, held = acc["out"], acc["held"]
        n = F.size(out)
        onto_last = F.concat(F.slice(out, F.lit(1), n - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), held)))
        return F.when(held == "", out).when((n > 0) & (F.length(held) < least), onto_last).otherwise(F.concat(out, F.array(held)))

    clean = F.filter(F.transform(segments, T.norm_ws), lambda x: x != "")
    start = F.struct(F.expr(_NONE).alias("out"), F.lit("").alias("held"))
    merged = F.aggregate(clean, start, step, finish)
    return F.flatten(F.transform(merged, lambda x: F.when(F.length(x) > limit, split_long(x, limit)).otherwise(F.array(x))))


def windows(c: Column, limit: int) -> Column:
    """Texts over max(4000, 8 limits) in pieces of that size."""
    budget = max(4000, 8 * limit)
    whole = T.norm_ws(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(budget))
    return F.transform(starts, lambda i: F.substring(whole, i, F.lit(budget)))


def chunk_documents(docs: DataFrame, key: str, text_col: str, least: int = 80, limit: int = 400) -> DataFrame:
    """key, chunk_order from 0, text of every chunk."""
    segments = F.flatten(F.transform("pieces", lambda p: split_long(p, limit)))
    cut = docs.select(key, windows(F.col(text_col), limit).alias("pieces")).select(key, segments.alias("segments"))
    return cut.select(key, F.posexplode(merge_small(F.col("segments"), least, limit)).alias("chunk_order", "text"))


def markdown_sections(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Leaf sections of Markdown texts: key, section, level, path (array of titles) and body with the ancestors' own text first.

    A heading's parent is the last one before it of a lower level; section 0 is the text before the first heading.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(T.text(F.col(text_col)), "\r\n?", "\n"), "\n")).alias("at", "line"))
    head = r"^(#{1,6})\s+(.*\S)\s*$"
    lines = lines.withColumns({"level": F.length(F.regexp_extract("line", head, 1)), "title": F.regexp_replace(F.trim(F.regexp_extract("line", head, 2)), r"\s*#+$", "")})
    order = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(order))
    body = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "level", "line"))), lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    sections = lines.groupBy(key, "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), T.strip(body).alias("own"))
    up = Window.partitionBy(key).orderBy("section")
    before = up.rowsBetween(Window.unboundedPreceding, 0)
    # Of the sections so far, keep those that no later one of the same or a lower level closes.
    trail = F.collect_list(F.struct("section", "level", "title", "own")).over(before)
    closed = lambda x, t: F.exists(t, lambda y: (y["section"] > x["section"]) & (y["level"] <= x["level"]))
    sections = sections.withColumn("trail", F.filter(trail, lambda x: x["level"] > 0)).withColumn("line_up", F.filter("trail", lambda x: ~closed(x, F.col("trail"))))
    sections = sections.withColumn("leaf", F.coalesce(F.lead("level").over(up) <= F.col("level"), F.lit(True)) | (F.col("section") == 0))
    whole = F.array_join(F.filter(F.transform("line_up", lambda x: x["own"]), lambda x: x != ""), "\n\n")
    out = sections.filter("leaf").select(key, "section", "level", F.transform("line_up", lambda x: x["title"]).alias("path"), F.when(F.col("section") == 0, F.col("own")).otherwise(whole).alias("body"))
    return out.filter("body != ''")


def pack(pieces: Column, limit: int) -> Column:
    """How many packs pieces make when each joins the one before, by a space, while that fits; and the longest."""
    state = lambda held, packs, longest: F.struct(held.cast("long").alias("held"), packs.cast("long").alias("packs"), longest.cast("long").alias("longest"))

    def step(acc: Column, s: Column) -> Column:
        joined = acc["held"] + F.length(s) + 1
        fits = (acc["packs"] > 0) & (joined <= limit)
        held = F.when(fits, joined).otherwise(F.length(s))
        return state(held, F.when(fits, acc["packs"]).otherwise(acc["packs"] + 1), F.greatest(acc["longest"], held))

    return F.aggregate(pieces, state(F.lit(0), F.lit(0), F.lit(0)), step)


def overlapping(c: Column, size: int, overlap: int) -> Column:
    """Pieces of a size that overlap; the last one ends with the text."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))


def valid_segments(c: Column, segments: Column) -> Column:
    """Whether segments are together between 0.45 and 1.8 times as long as the text they were cut from."""
    total = F.aggregate(F.transform(segments, F.length), F.lit(0), lambda a, x: a + x)
    return F.coalesce((total / F.nullif(F.length(c), F.lit(0))).between(0.45, 1.8), F.lit(False))
