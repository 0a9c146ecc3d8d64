"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Method. Every text is normalised (each run of white space becomes one space) and reduced to a 64-bit ordering digest
with its SHA-256 and byte length, which verify it. Rows are dealt into runs by a seeded hash of their id, each sorted by digest, and runs are
merged in rounds: at each round partitions exchange the runs of FAN_IN neighbours (so four binomial rounds at once), sort them
together and compare neighbours, keeping for every verified digest the smallest id and the number of rows. As runs grow FAN_IN
times larger, each is cut into FAN_IN times more ranges of digests, so what a task merges stays the same from the leaves to the root. A digest that
holds a third of all rows arrives at any merge as at most FAN_IN entries, however many rows it has. The merged groups of more than one row then go back down the same
tree: first to the runs that hold them, then from each run to its rows, so no join key gathers a whole group.

Only ids and digests are shuffled; texts are read once and stay where they are.

Cases. Null text counts as empty, so null, '' and texts of white space of different kinds are compared after
normalisation ('' and ' ' differ). Null ids are larger than all others. If one id has the same text in several rows, one
of them stays. An empty table gives an empty result. Extra columns are ignored by ``decide`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE_CLASS, cut, power_at_least, text_or_empty

#: Runs merged into one at each round.
FAN_IN = 16
#: Rows that a leaf run has on average.
RUN_ROWS = 256

_DIGEST = ["h", "sha", "n_bytes"]


def normalised(text: str):
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS, " ")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return norm.select("id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("n_bytes"))


def _merge(rows: DataFrame) -> DataFrame:
    """Sort runs, or ranges of them, by digest and keep of equal neighbours the smallest id and the number of rows."""
    run = Window.partitionBy("run", "range", *_DIGEST).orderBy(F.col("keep_id").asc_nulls_last())
    every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Rows move by run and range alone, so a task holds whole sorted ranges.
    sent = rows.repartition("run", "range")
    ranked = sent.withColumns({"nth": F.row_number().over(run), "group_size": F.sum("group_size").over(every)})
    return ranked.filter("nth = 1").drop("nth")


def merge_runs(leaves: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """Merge leaf runs (id, digest, run, copies) round by round; the first merge and the root, by digest."""
    first = _merge(leaves.select(*_DIGEST, "run", F.lit(0).cast("long").alias("range"), F.col("id").alias("keep_id"), F.col("copies").alias("group_size")))
    level, left, bits = first, runs, 0
    while left > 1:
        left, bits = left // FAN_IN, bits + FAN_IN.bit_length() - 1
        level = _merge(level.withColumns({"run": F.expr(f"run div {FAN_IN}"), "range": F.shiftrightunsigned("h", 64 - bits)}))
    return first.drop("range"), level.drop("run", "range")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, sha (binary) of the normalised text."""
    leaves = cut(_digests(docs, id_col, text_col).groupBy("id", *_DIGEST).agg(F.count("*").alias("copies")))
    runs = power_at_least(FAN_IN, leaves.count() // run_rows)
    leaves = leaves.withColumn("run", F.pmod(F.xxhash64(F.lit("run"), "id"), F.lit(runs)))
    first, root = merge_runs(leaves, runs)
    shared = root.filter("group_size > 1")
    down = first.select(*_DIGEST, "run").join(shared, _DIGEST)
    out = leaves.join(down, [*_DIGEST, "run"], "left").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    alone = F.col("group_size").isNull()
    return out.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("copy").eqNullSafe(1) & (alone | F.col("id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        "sha",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of equal texts the row with the smallest id."""
    stays = decide(docs, id_col, text_col).filter("kept").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
    keyed = docs.withColumns({"__key": F.unhex(F.sha2(normalised(text_col), 256))})
    found = keyed.join(stays, keyed[id_col].eqNullSafe(stays["__id"]) & (keyed["__key"] == stays["__sha"]), "left_semi")
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)]
    order = Window.partitionBy(id_col, "__key").orderBy(F.xxhash64(*rest, F.lit(0)))
    return found.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").select(*docs.columns)
