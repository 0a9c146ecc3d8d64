"""Catalogues and nested documents: ancestors by parent id, JSON walks, profiles along dotted prefixes, line differences."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(leaves: DataFrame, catalog: DataFrame, node: str = "node", parent: str = "parent", deepest: int = 64) -> DataFrame:
    """The leaves and all their ancestors by the catalogue's parent ids, once each. A chain deeper than ``deepest`` is an error."""
    found = leaves.select(node).distinct()
    edge = found
    for _ in range(deepest):
        up = edge.join(catalog.select(node, parent), node).select(F.col(parent).alias(node)).filter(F.col(node).isNotNull()).distinct()
        edge = up.join(found, node, "left_anti")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)
    raise ValueError("the catalogue is too deep or has a cycle")


def walk_json(docs: DataFrame, key: str, body: str, deepest: int = 32) -> DataFrame:
    """Texts in nested JSON: key, path (dotted names), depth and the distinct texts found there, whatever the nesting."""
    level = docs.select(key, F.lit("").alias("path"), F.lit(0).alias("depth"), F.parse_json(body).alias("v"))
    spark, out = docs.sparkSession, None
    for _ in range(deepest):
        texts = level.filter("schema_of_variant(v) = 'STRING'").select(key, "path", "depth", F.expr("cast(v as string)").alias("text"))
        out = texts if out is None else out.unionByName(texts)
        nested = level.filter("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")
        if nested.isEmpty():
            break
        step = spark.sql(f"SELECT n.{key}, n.path, n.depth, e.key AS name, e.value AS v FROM {{n}} AS n, LATERAL variant_explode(n.v) AS e", n=nested)
        deeper = F.when(F.col("name").isNull(), F.col("path")).when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        level = step.select(key, deeper.alias("path"), (F.col("depth") + F.col("name").isNotNull().cast("int")).alias("depth"), "v")
    return out.groupBy(key, "path", "depth").agg(F.sort_array(F.collect_set("text")).alias("texts"))


def merged_profiles(sections: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each section (section) the profiles (scope, hints, note) of all, of each dotted prefix and of itself laid over each other.

    Hints are joined, distinct in order; of notes the last that isn't blank counts.
    """
    parts = F.split("section", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("nth"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("scope")))
    climbed = sections.select("section", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("nth"), F.lit("").alias("scope"))), steps)).alias("s")).select("section", "s.nth", "s.scope")
    joined = climbed.join(profiles, "scope")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "hints"))), lambda x: x["hints"])
    note = F.max_by("note", F.when(F.coalesce(F.trim("note"), F.lit("")) != "", F.col("nth")))
    return joined.groupBy("section").agg(F.array_distinct(F.flatten(listed)).alias("hints"), note.alias("note"))


def line_changes(rows: DataFrame, key: str, before: str, after: str, most: int = 80) -> DataFrame:
    """Ranges of lines that differ between two texts, the first ``most``: key, tag, from and to in both, and the similarity."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, a, b in zip(frame[key], frame[before], frame[after], strict=True):
                match = SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n"), autojunk=False)
                changes = [x for x in match.get_opcodes() if x[0] != "equal"][:most]
                out += [(k, *x, round(match.ratio(), 4)) for x in changes]
            yield pd.DataFrame(out, columns=[key, "tag", "a0", "a1", "b0", "b1", "similarity"])

    return rows.select(key, before, after).mapInPandas(run, f"{key} {kind}, tag string, a0 int, a1 int, b0 int, b1 int, similarity double")
