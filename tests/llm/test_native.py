"""Exact dedup, sharding and mixing: brute force on a table of awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import exact_dedup, mixing, sharding
from tests.llm.fixtures import SCHEMA, documents

GAPS = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).cache()


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in documents():
        groups[GAPS.sub(" ", r[1] or "")].append(r[0])
    got = exact_dedup.decide(docs, run_rows=2).collect()
    assert Counter((r["id"], r["sha"].hex(), r["keep_id"], r["group_size"]) for r in got) == Counter(
        (i, hashlib.sha256(t.encode()).hexdigest(), min(ids), len(ids)) for t, ids in groups.items() for i in ids
    )
    kept = Counter(r["sha"].hex() for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])
    rest = exact_dedup.drop_copies(docs)
    assert rest.columns == docs.columns
    assert sorted(r["doc_id"] for r in rest.collect()) == sorted(min(ids) for ids in groups.values())


def test_exact_dedup_null_ids(spark):
    rows = spark.createDataFrame([(None, "x"), (None, "x"), (4, "y"), (None, "y"), (None, None)], "doc_id long, text string")
    got = exact_dedup.decide(rows).collect()
    assert sum(r["kept"] for r in got) == 3
    assert [r["id"] for r in got if r["kept"] and r["group_size"] == 2 and r["id"] is not None] == [4]
    assert exact_dedup.drop_copies(rows).count() == 3


def test_sharding_law_and_slots(docs):
    got = sharding.plan_shards(docs, shards=16, bucket_rows=2).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in documents())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    again = sharding.plan_shards(docs.repartition(3), shards=16, bucket_rows=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharding_shuffles_uniformly(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    got = sharding.plan_shards(rows, shards=4, seed=3).collect()
    counts = Counter(r["shard"] for r in got)
    assert all(abs(c - 5000) < 400 for c in counts.values())
    firsts = [r["id"] for r in got if r["slot"] < 250]
    assert abs(sum(firsts) / len(firsts) - 10_000) < 1000
    in_order = sum(a["id"] < b["id"] for a, b in zip(sorted(got, key=lambda r: (r["shard"], r["slot"])), sorted(got, key=lambda r: (r["shard"], r["slot"]))[1:], strict=False))
    assert abs(in_order / 20_000 - 0.5) < 0.02


def _shards(rows, shards, seed, bucket_rows):
    """Owners, buckets and Fisher-Yates by a twin in Python: (id, size, crc) to its shard, slot and grown shard, in rows' order."""
    import struct

    xxhash = pytest.importorskip("xxhash")
    wrap = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*parts):
        h = 42
        for kind, v in parts:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v), seed=h)
        return wrap(h)

    def owner(key, n):
        hashes = [chain(("i", seed), ("i", s), ("l", key)) for s in range(n)]
        return hashes.index(max(hashes))

    seen, buckets = Counter(), max(1, -(-len(rows) // (shards * bucket_rows)))
    held = defaultdict(list)
    for row in rows:
        seen[row] += 1
        at = chain(("i", seed), ("s", "bucket"), ("l", row[0]), ("l", row[1]), ("l", row[2]), ("l", seen[row])) % buckets
        held[owner(row[0], shards), at].append((*row, seen[row]))
    out, start = [], Counter()
    for shard, bucket in sorted(held):
        records = sorted(held[shard, bucket])
        order = []
        for i in range(len(records)):
            j = chain(("i", seed), ("i", shard), ("l", bucket), ("i", i)) % (i + 1)
            order.append(i)
            order[i], order[j] = order[j], order[i]
        for pick in order:
            r = records[pick]
            out.append((*r[:3], shard, start[shard], owner(r[0], shards + 1)))
            start[shard] += 1
    return out


def test_sharding_equals_its_twin(docs):
    rows = [(d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in documents()]
    got = sharding.plan_shards(docs, shards=16, bucket_rows=2).select("id", "size", "text_crc32", "shard", "slot", "grown_shard").collect()
    assert Counter(map(tuple, got)) == Counter(_shards(rows, 16, 17, 2))
    got = sharding.plan_shards(docs, shards=3, seed=5).select("id", "size", "text_crc32", "shard", "slot", "grown_shard").collect()
    assert Counter(map(tuple, got)) == Counter(_shards(rows, 3, 5, sharding.BUCKET_ROWS))


def test_sharding_many_alike(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x")] * 40 + [(7, "y")] * 30 + [(i, None) for i in range(10)], "doc_id long, text string")
    got = sharding.plan_shards(rows, shards=2, bucket_rows=4).collect()
    assert len(got) == 80 and max(Counter((r["shard"], r["bucket"]) for r in got).values()) < 25
    sharding.write_shards(rows, str(tmp_path / "out"), shards=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in rows.collect())
    for shard in (0, 1):
        assert sorted(r["__slot"] for r in back.filter(f"__shard = {shard}").collect()) == list(range(back.filter(f"__shard = {shard}").count()))


def test_write_shards(docs, tmp_path, spark):
    unique = docs.dropDuplicates(["doc_id"])
    sharding.write_shards(unique, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == unique.count() and {"text", "lang", "__shard", "__slot"} <= set(back.columns)


def _targets(sizes: dict, weights: list, budget: float, most: int) -> dict:
    """Reshare until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in above}


def test_mixing(docs):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += size(r[1])
    want = _targets(dict(sizes), [5, 2, 1], 1.5 * sum(sizes.values()), 2)
    got = mixing.mix(docs, [5, 2, 1], bucket_rows=4).collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((d[0], d[3], size(d[1])) for d in documents())
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), [5, 2, 1], bucket_rows=4).collect()))


def test_mixing_is_near_its_targets(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 97 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    got = mixing.mix(rows, [5, 2, 1]).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in got)
    drawn = mixing.draw(rows, [5, 2, 1])
    assert drawn.columns == rows.columns and drawn.count() == mixing.mix(rows, [5, 2, 1]).selectExpr("sum(copies)").first()[0]


def test_mixing_few_documents_of_very_different_sizes(spark):
    # Fifty documents a source, a few of them very long: still within two hundredths of the target.
    rows = spark.range(1000).selectExpr("id AS doc_id", "repeat('w ', cast(if(id % 25 = 3, 15000, 20 + (id * 7919) % 1500) as int)) AS text", "concat('s', id % 20) AS source")
    got = mixing.mix(rows, [5, 2, 1]).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 20 and all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in got)


def test_mixing_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 9 + [(None, "d e", "s")] * 5 + [(2, "f " * 40, "t")], "doc_id long, text string, source string")
    copies = mixing.mix(rows, [1, 1]).selectExpr("sum(copies)").first()[0]
    assert mixing.draw(rows, [1, 1]).count() == copies


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decide(empty).count() == exact_dedup.drop_copies(empty).count() == 0
    assert sharding.plan_shards(empty).count() == mixing.mix(empty, [5, 2, 1]).count() == mixing.draw(empty, [5, 2, 1]).count() == 0
