"""Two-pass external shuffle into shards, in DataFrame operations only.

Method. Pass one scatters every record by seeded hashes: the shard is the one with the largest seeded hash of the id
among all shards (so the id and the shard count alone decide, and one more shard only takes records into itself), and
within the shard a second seeded hash picks one of many buckets sized for memory. Pass two shuffles each bucket by
Fisher-Yates, drawing swap i from a hash of (seed, shard, bucket, i), and numbers its records after those of the
buckets before it. Reruns and retried tasks give the same order, whatever the number of partitions.

Law: `key`. Only ids, sizes and checksums are shuffled; ``write_shards`` alone moves texts.

Cases. Null text has size 1 and checksum 0. Null ids are a key like others; buckets also depend on size and
checksum, and of rows alike in all these on which of them it is, so no bucket is hot. Repeated rows are each placed. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, text_or_empty

#: Records of a bucket on average; at 4 KB a record a bucket is about 1 MB.
BUCKET_ROWS = 256


def owner(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of the key (rendezvous hashing), from 0."""
    hashes = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(hashes, F.array_max(hashes)) - 1).cast("int")


def fisher_yates(n: Column, *draw: Column) -> Column:
    """A permutation of 0..n-1 built inside out: place i at a drawn j <= i and move what was there to the end."""

    def swap(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*draw, i), i + 1).cast("int")
        moved = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), F.slice(done, j + 1, F.lit(1)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.expr("cast(array() as array<int>)"), swap)


def plan_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per record: id, size, text_crc32, nth (of rows alike in these), shard, bucket, slot (gapless from 0 in its shard), grown_shard."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        owner(F.col(id_col), shards, seed).alias("shard"),
        owner(F.col(id_col), shards + 1, seed).alias("grown_shard"),
    )
    # Rows alike are interchangeable: they are counted and told apart by a number.
    rows = cut(rows.groupBy("id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("alike")))
    total = rows.agg(F.coalesce(F.sum("alike"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (shards * bucket_rows)))
    rows = rows.withColumn("nth", F.explode(F.expr("sequence(1L, alike)"))).drop("alike")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "id", "size", "text_crc32", "nth"), F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    record = F.struct("id", "size", "text_crc32", "nth", "grown_shard")
    whole = rows.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(record)).alias("records"))
    order = fisher_yates(F.size("records"), F.lit(seed), F.col("shard"), F.col("bucket"))
    dealt = whole.join(starts, ["shard", "bucket"]).select("shard", "bucket", "start", "records", F.posexplode(order).alias("at", "pick"))
    return dealt.select(
        F.expr("records[pick].id").alias("id"),
        F.expr("records[pick].size").alias("size"),
        F.expr("records[pick].text_crc32").alias("text_crc32"),
        F.expr("records[pick].nth").alias("nth"),
        "shard",
        "bucket",
        (F.col("start") + F.col("at")).alias("slot"),
        F.expr("records[pick].grown_shard").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of the documents to ``path``, one folder a shard, every file a stretch of its slots in order."""
    names = ("id", "size", "text_crc32", "nth", "shard", "slot")
    plan = plan_shards(docs, shards, seed, id_col, text_col).select(*[F.col(c).alias(f"__{c}") for c in names])
    text = text_or_empty(text_col)
    keyed = docs.withColumns({"__a": (F.octet_length(text) + 1).cast("long"), "__b": F.crc32(text.cast("binary")).cast("long")})
    alike = Window.partitionBy(id_col, "__a", "__b").orderBy(F.lit(0))
    keyed = keyed.withColumn("__c", F.row_number().over(alike).cast("long"))
    same = keyed[id_col].eqNullSafe(plan["__id"]) & (keyed["__a"] == plan["__size"]) & (keyed["__b"] == plan["__text_crc32"]) & (keyed["__c"] == plan["__nth"])
    placed = keyed.join(plan, same).select(*[keyed[c] for c in docs.columns], "__shard", "__slot")
    placed.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
