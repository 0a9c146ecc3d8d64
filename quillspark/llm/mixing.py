"""Mixing sources to target weights by systematic sampling.

Method. A source's target is its share, by weight, of a budget of words; targets stop at ``most`` times the source's own
words and the excess is shared anew, which is water-filling: with sources ordered by cap over weight, those before the
water level get their cap and the others weight times level. Each document then expects a number of copies. The largest
documents of a source, at most BIG, expect whole copies, rounded from the largest down with what is left over carried on in words, so that no
single text throws the source off its target; all others share the rest of the target evenly. The
expected copies are summed along the documents of the source, one offset drawn for the source is added, and a
document is emitted once for each integer boundary its own interval crosses, so it gets the floor or the ceiling of
its expectation (whole ones cross just as many wherever they stand, and are left out of the sum) and the counts of any stretch are within one of it. Along the source, documents are dealt by a seeded
hash into buckets and ordered by size within (alternately up and down), so that words follow as closely as counts.
Copies are whole numbers of 2**-24 in the sums: results don't depend on the order of floating-point additions.

Prefix sums are taken at two levels, buckets of about BUCKET_ROWS documents and blocks of 1024 buckets, so a source
that holds a third of all rows is never in one task.

Cases. Null text has no words and, as any document without words, takes part with 0 words taken. Null is a source of its
own, last. Repeated rows each count. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_CLASS, cut, text_or_empty

BUCKET_ROWS = 512
#: Documents of a source, at most, whose expected copies are whole.
BIG = 256
_BLOCK = 1024
_ONE = 1 << 24


def spread(id_col: str, seed: int, modulus: int = 2147483647) -> Column:
    """A seeded multiplicative hash of an integer id below ``modulus``; null counts as 0."""
    x = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(modulus))
    first = F.pmod(x * F.lit(48271) + F.lit(seed), F.lit(modulus))
    return F.pmod(F.shiftright(first, 7).bitwiseXOR(first) * F.lit(69621), F.lit(modulus))


def targets(sizes: DataFrame, weights: list[int], percent: int, most: int) -> DataFrame:
    """Targets of sources (source, source_size): one row a source, which a single task orders by code point."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("nth", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * percent / 100)
    order = everything.orderBy(F.col("cap") / F.col("w"), "nth")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    # The level is the first at which the source isn't filled; it only matters from there on.
    reached = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "nth", "level"))).over(everything)
    return rows.withColumn("at", reached["level"]).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("w"))).alias("target")
    )


def mix(
    docs: DataFrame, weights: list[int], percent: int = 150, most: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS, big: int = BIG
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), copies, taken (copies times size)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD_CLASS)).cast("long").alias("size"))
    rows = cut(rows.withColumn("h", spread("id", seed)))
    fair = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    fair = cut(fair.withColumn("rate", F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))))
    whole = cut(whole_copies(rows, fair, most, big))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    given_to = whole.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), "copies")
    matched = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z"))
    marked = cut(rows.join(given_to, matched, "left").select("id", "source", "size", "h", "copies"))
    rest = marked.filter("copies IS NULL").drop("copies")
    buckets = max(1, -(-rest.count() // bucket_rows))
    rest = rest.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    counts = cut(rest.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    of_source = F.col("source").eqNullSafe(F.col("s"))
    known = fair.withColumnRenamed("source", "s")
    given = whole.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("alike") * F.col("size") * F.col("copies")).alias("given"))
    left = counts.groupBy("source").agg(F.sum("words").alias("words"))
    left = left.join(given, of_source, "left").select("source", "words", F.coalesce("given", F.lit(0)).alias("given"))
    share = (F.col("target") - F.col("given")) / F.when(F.col("words") > 0, F.col("words"))
    step = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * _ONE), F.lit(0)), F.lit(most * _ONE)).cast("long")
    steps = left.join(known, of_source).select("source", step.alias("step"))
    # Documents before each bucket of the source: inside its block of buckets, and in the blocks before.
    blocks = counts.withColumn("block", F.expr(f"bucket div {_BLOCK}"))
    over = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inner", F.coalesce(F.sum("n").over(over), F.lit(0)))
    outer = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("source", "block").agg(F.sum("n").alias("total")).withColumn("outer", F.coalesce(F.sum("total").over(outer), F.lit(0)))
    starts = inside.join(tops, same(inside, tops, "source", "block")).select(inside["source"].alias("source"), "bucket", (F.col("inner") + F.col("outer")).alias("start"))
    starts = starts.join(steps, same(starts, steps, "source")).select(starts["source"].alias("s"), F.col("bucket").alias("b"), "start", "step")
    along = F.when(F.col("bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(along, "h", "id"))
    ranked = rest.withColumn("nth", nth)
    joined = ranked.join(starts, ranked["source"].eqNullSafe(starts["s"]) & (ranked["bucket"] == starts["b"]))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 6), 16, 10)
    offset = drawn.cast("long")
    crossed = lambda k: F.shiftright(k * F.col("step") + offset, 24)
    last = F.col("start") + F.col("nth")
    sampled = joined.select("id", "source", "size", (crossed(last) - crossed(last - 1)).cast("long").alias("copies"))
    every = sampled.union(marked.filter("copies IS NOT NULL").select("id", "source", "size", "copies"))
    return every.join(known, of_source).select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def whole_copies(rows: DataFrame, fair: DataFrame, most: int, big: int) -> DataFrame:
    """Whole copies of the largest documents of each source: source, id, size, copies, alike (rows of that id and size).

    Large is a size of which the source has at most ``big`` documents of that or more, so only counts by size come together, not
    documents. From the largest down each gets the copies nearest to what it should give and what is still owed from those before.
    """
    counts = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("size")))
    least = counts.withColumn("upto", upto).filter(F.col("upto") <= big).groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"))
    large = rows.join(least, F.col("source").eqNullSafe(F.col("s"))).filter("size >= least")
    groups = large.groupBy("source", "id", "size", "h").agg(F.count("*").alias("alike"))
    order = Window.partitionBy("source").orderBy(F.desc("size"), "h", F.col("id").asc_nulls_first())
    top = groups.withColumn("nth", F.row_number().over(order))
    top = top.join(fair.select(F.col("source").alias("s"), "rate"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    lists = top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "size", "alike", "rate"))).alias("list"))
    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<bigint>)").alias("copies"))

    def give(acc, x):
        words = (x["size"] * x["alike"]).cast("double")
        owed = acc["owed"] + x["rate"] * words
        copies = F.least(F.greatest(F.floor(owed / words + 0.5), F.lit(0)), F.lit(most)).cast("long")
        return F.struct((owed - copies * words).alias("owed"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    given = lists.withColumn("copies", F.aggregate("list", start, give)["copies"])
    each = given.select("source", F.explode(F.arrays_zip("list", "copies")).alias("x"))
    return each.select("source", F.col("x.list.id").alias("id"), F.col("x.list.size").alias("size"), F.col("x.copies").alias("copies"), F.col("x.list.alike").alias("alike"))


def draw(docs: DataFrame, weights: list[int], percent: int = 150, most: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it was taken, with all its columns. Rows that share id and source share their copies evenly."""
    taken = mix(docs, weights, percent, most, seed, id_col, text_col, source_col)
    taken = taken.groupBy(F.col("id").alias("__id"), F.col("source").alias("__source")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
    joined = docs.join(taken, docs[id_col].eqNullSafe(taken["__id"]) & docs[source_col].cast("string").eqNullSafe(taken["__source"]))
    alike = F.row_number().over(Window.partitionBy("__id", "__source").orderBy(F.xxhash64(F.col(text_col))))
    several = joined.filter("__rows > 1").withColumn("__nth", alike).withColumn("__copies", F.expr("__copies div __rows + int(__nth <= __copies % __rows)")).drop("__nth")
    every = joined.filter("__rows = 1").union(several).filter("__copies > 0")
    return every.withColumn("__nth", F.explode(F.expr("sequence(1L, __copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
