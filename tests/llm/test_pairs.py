"""Joins, repeats and searches against brute force, on small tables with hot groups."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, knn, shingles, suffixes
from quillspark.llm.components import components
from tests.llm.fixtures import SCHEMA, documents, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets_of(rows) -> dict:
    out = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def smallest_reachable(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: top(i) for i in ids}


def chains(rng: random.Random) -> list[tuple]:
    """Texts that drift step by step, so that ends are linked through the middle only, among many with a common passage."""
    passage, rows, words = prose(rng, 60), [], prose(rng, 150).split()
    for i in range(40):
        if i % 8 == 0:
            words = prose(rng, 100 + 10 * (i // 8)).split()
        words = [w if rng.random() > 0.02 else "w%d" % rng.randrange(999) for w in words]
        rows.append((5000 + i, " ".join(words)))
    rows += [(6000 + i, f"{passage} {prose(rng, rng.choice([8, 12, 20, 60]))}") for i in range(120)]
    rows += [(7000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(200)]
    return rows


def test_jaccard_components(spark):
    rows = [r[:2] for r in documents()] + chains(random.Random(8))
    sets = sets_of(rows)
    want = smallest_reachable(sets)
    got = jaccard_join.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["id"]: r["component_id"] for r in got} == want


def test_jaccard_frequent_classes(spark, monkeypatch):
    """The same when almost every token is of a frequent class and indexed in pairs."""
    monkeypatch.setattr(jaccard_join, "RARE", 2)
    rows = chains(random.Random(9)) + [(i, t) for i, t in enumerate([prose(random.Random(1), 80)] * 30)]
    got = jaccard_join.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in got} == smallest_reachable(sets_of(rows))


def test_keep_one(spark):
    docs = spark.createDataFrame([r for r in documents() if r[0] != 27], SCHEMA)
    kept = jaccard_join.keep_one(docs)
    want = smallest_reachable(sets_of([r for r in documents() if r[0] != 27]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_steps_of_positions():
    rng = np.random.default_rng(0)
    for at in ([], [0], [65535], [65534, 65535, 131070, 400_000], np.sort(rng.choice(3_000_000, 500, False))):
        at = np.array(at, np.int64)
        assert jaccard_join._positions(jaccard_join._steps(at)).tolist() == at.tolist()


def test_shingles_of_any_text():
    texts = ["", " ", "a", "A b C d", "a b c d e", "A  b\tc\nd e", "é " * 7, "x" * 300 + " " + "y" * 70]
    got = shingles.shingle_sets(texts)
    want = sets_of(list(enumerate(texts)))
    assert [len(s) for s in got] == [len(want[i]) for i in range(len(texts))]
    assert got[4].tolist() == got[5].tolist() and got[2].tolist() != got[3].tolist()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for pair in links for x in pair}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: top(i) for i in parent}


def test_repeated_passages(spark):
    rng = random.Random(12)
    hot, rare = prose(rng, 70), prose(rng, 55)
    rows = [(i, f"{prose(rng, rng.randint(0, 90))} {hot} {prose(rng, rng.randint(0, 90))}") for i in range(150)]
    rows += [(300 + i, f"{prose(rng, 40)} {rare} {prose(rng, 300)}") for i in range(2)]
    rows += [(400 + i, prose(rng, 200)) for i in range(40)]
    rows += [(500, " ".join(["same"] * 400)), (501, prose(rng, 49)), (502, None), (503, "")]
    copy = prose(rng, 90)
    rows += [(600 + i, copy) for i in range(3)] + [(700, copy + " " + prose(rng, 20)), (701, prose(rng, 49))]
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            if len(seen[tuple(w[j : j + 50])]) > 1:
                want[i].update(range(j, j + 50))
    got = defaultdict(set)
    for r in suffixes.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r["id"]].update(range(r["first_word"], r["last_word"]))
        assert r["other_id"] != r["id"] and r["last_word"] - r["first_word"] >= 50
    assert got.keys() == want.keys()
    # Words that two documents share by chance beside a passage of many aren't always found; all else is.
    assert all(got[i] <= want[i] for i in want) and sum(len(want[i] - got[i]) for i in want) <= 2 * len(want)
    for i, w in words.items():
        for passage in (hot, rare, copy):
            p = passage.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    assert got[i] >= set(range(j, j + len(p)))


def test_common_tail_shorter_than_a_passage(spark):
    # Own words of two documents, then a tail that 200 others hold too: the retained suffix often falls in the tail.
    for seed in range(8):
        rng = random.Random(seed)
        own, tail = prose(rng, 20), prose(rng, 40)
        texts = [f"{prose(rng, 60)} {own} {tail} {prose(rng, 60)}" for _ in range(2)] + [f"{prose(rng, 80)} {tail} {prose(rng, 60)}" for _ in range(200)]
        got = {r["id"]: (r["first_word"], r["last_word"], r["other_id"]) for r in suffixes.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == {0: (60, 120, 1), 1: (60, 120, 0)}, seed


def test_passage_of_one_word(spark):
    rows = [(i, f"{prose(random.Random(i), 30)} {'same ' * 300} {prose(random.Random(i + 50), 30)}") for i in range(3)]
    got = {r["id"]: (r["first_word"], r["last_word"]) for r in suffixes.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (30, 330) for i in range(3)}


def test_retained_suffixes_depend_on_content():
    rng = random.Random(3)
    passage = prose(rng, 50)
    for _ in range(30):
        a, b = (f"{prose(rng, rng.randint(1, 60))} {passage} {prose(rng, rng.randint(1, 60))}" for _ in range(2))
        grams = []
        for text in (a, b):
            hashes, starts = shingles.word_hashes([text], fold_case=False)
            grams.append(set(suffixes.retained(hashes)[1].tolist()))
        assert grams[0] & grams[1]


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = [(-round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 12), j) for j, v in good if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("shape", ["clusters", "noise", "copies"])
def test_nearest_neighbours(spark, monkeypatch, shape):
    monkeypatch.setattr(knn, "CELL_ROWS", 300)
    rng = np.random.default_rng(4)
    n = 3000
    centres = rng.standard_normal((40, 16)) * 4
    v = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, 16)) if shape == "clusters" else rng.standard_normal((n, 16))
    if shape == "copies":
        v[rng.random(n) < 0.34] = v[0]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [float("inf")] + [1.0] * 15), (5200, [None] + [1.0] * 15), (5250, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(knn.nearest(frame, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    want = brute(rows, 5)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    if shape == "copies":
        alike = [q for q in want if (v[q] == v[0]).all()]
        assert alike and all(got[q] == want[q] for q in alike)


def test_neighbours_in_small_blocks(spark, monkeypatch):
    # Cells and the queries that meet in them are split; columns clash, the first row is of another length, a query id repeats.
    for name, value in (("CELL_ROWS", 40), ("QUERY_ROWS", 3), ("CELLS_MAX", 8)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1500, 12))
    rows = [(-50, [1.0], "x", 0, 0.0)] + [(i, [float(x) for x in row], "x", i % 3, 0.5) for i, row in enumerate(v)] + [(100, [float(x) for x in v[100]], "y", 0, 0.1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, cell int, bound double").coalesce(1)
    got = defaultdict(list)
    for r in sorted(knn.nearest(frame, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    want = brute([r[:2] for r in rows[1:-1]], 5)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_components_of_a_long_chain_and_a_star(spark):
    from quillspark.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(1000 + i, 500) for i in range(300)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 500 for i in [500, *range(1000, 1300)]}


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    rows = knn.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in rows) == [(1, 1), (2, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.find(empty).count() == jaccard_join.keep_one(empty).count() == suffixes.find(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert {(r["id"], r["component_id"], r["n_shingles"]) for r in jaccard_join.find(blank).collect()} == {(i, i, 0) for i in (1, 2, 3)}
