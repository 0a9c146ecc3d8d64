"""Nearest neighbours by cosine through low-dimensional stable projections and a kd-tree.

Method. Vectors are scaled to length one, so that cosine and Euclidean order agree, and projected on DIMS random
directions of normal (2-stable) entries: for a point at distance r the squared projected distance over r squared is
chi-square with DIMS degrees of freedom. A kd-tree of the projections is fitted on a bounded sample and cuts the space
into cells; every vector is indexed in its cell. Queries go to the cells, and inside each to the leaves of a kd-tree of that cell, in
order of projected distance, and verify the points in them on the original vectors. Cells are visited in rounds, one first, then GROW times
more in each, and between rounds a query's k-th distance d so far is known: it stops when what comes next lies beyond d
times the root of the chi-square quantile RECALL, as with at least that probability a nearer neighbour would have been met.

Scale. Cells with more than CELL_ROWS vectors, such as one with a vector repeated a million times, are split by a seeded hash of the id, and every part is searched;
queries that meet in a cell are split in the same way, QUERY_ROWS at a time, so that a task holds a block of queries against a block of rows.
The boxes of the cells are at most CELLS_MAX rows, whatever the input, and are the only thing broadcast.

Cases. Vectors that are null, zero, hold null or non-finite components, or differ in length from most (of equally frequent lengths the smallest holds) are neither queries nor candidates. Rows with a null id take no part. Ties go
to the smaller id; equal vectors get equal scores. With fewer candidates than k all are returned; an empty table gives an
empty result. Repeated ids other than the query's own are candidates each; a repeated query id is one query, with the smallest of its vectors. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, ship

DIMS = 8
RECALL = 0.97
SAMPLE = 20_000
CELL_ROWS = 4096
CELLS_MAX = 4096
QUERY_ROWS = 4096
GROW = 4
LEAF_ROWS = 64


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = np.exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


def directions(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, DIMS))


def project(unit: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Projections, the same bits for the same vector wherever it stands in a batch."""
    return np.stack([(unit * plane[:, j]).sum(1) for j in range(plane.shape[1])], 1) if len(unit) else np.zeros((0, plane.shape[1]))


def split_tree(points: np.ndarray, leaf: int, most: int) -> list[tuple[int, float, int, int]]:
    """Inner nodes (axis, cut, left, right) of a kd-tree cut at medians of the widest axis; a child below 0 is leaf ~child."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0
    budget = most - 1

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves, budget
        if len(rows) > leaf and budget > 0:
            axis = int(np.ptp(points[rows], axis=0).argmax())
            values = points[rows, axis]
            cut_at = float(np.median(values))
            below = values < cut_at
            if below.any() and not below.all():
                budget -= 1
                at = len(nodes)
                nodes.append((axis, cut_at, 0, 0))
                left = grow(rows[below])
                right = grow(rows[~below])
                nodes[at] = (axis, cut_at, left, right)
                return at
        leaves += 1
        return ~(leaves - 1)

    root = grow(np.arange(len(points)))
    return nodes if root >= 0 else []


def locate(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        axis, cut_at, left, right = nodes[at]
        below = points[rows, axis] < cut_at
        for child, part in ((left, rows[below]), (right, rows[~below])):
            if child < 0:
                out[part] = ~child
            elif len(part):
                todo.append((child, part))
    return out


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    raw = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    raw = raw.reshape(len(vectors), -1)
    # Scaled by the largest component first: squares of very large or small ones leave the range of doubles.
    scaled = raw / np.abs(raw).max(1, keepdims=True) if len(raw) else raw
    return raw, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)) if len(raw) else raw


def _boxes_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        d = np.maximum(np.maximum(low[:, j] - points[:, j, None], points[:, j, None] - high[:, j]), 0)
        out += d * d
    return out


def search(units: np.ndarray, ids: np.ndarray, places: np.ndarray, q_units: np.ndarray, q_ids: np.ndarray, q_places: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> list[tuple[int, int, float]]:
    """The best k of a cell's vectors for each query: (query, id, score); ``bounds`` are squared distances known so far."""
    nodes = split_tree(places, LEAF_ROWS, 1 << 30)
    leaf = locate(nodes, places)
    order = np.argsort(leaf, kind="stable")
    units, ids, places, leaf = units[order], ids[order], places[order], leaf[order]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(leaf) > 0, [True]]))
    low = np.minimum.reduceat(places, edges[:-1], axis=0)
    high = np.maximum.reduceat(places, edges[:-1], axis=0)
    away = _boxes_distance(q_places, low, high)
    out = []
    for q in range(len(q_ids)):
        bound = bounds[q]
        near = np.argsort(away[q], kind="stable")
        rows: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        at, step, best = 0, 4, np.zeros(0)
        while at < len(near) and away[q, near[at]] <= bound * factor + 1e-9:
            some = np.concatenate([np.arange(edges[x], edges[x + 1]) for x in near[at : at + step]])
            some = some[ids[some] != q_ids[q]]
            s = units[some] @ q_units[q]
            rows.append(some)
            scores.append(s)
            best = np.sort(np.concatenate([best, s]))[::-1][:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 - 2 * best[-1]))
            at, step = at + step, step * 2
        if not rows:
            continue
        every, s = np.concatenate(rows), np.concatenate(scores)
        if len(every) > k:
            close = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9
            every = every[close]
        exact = (units[every] * q_units[q]).sum(1)  # the same bits for equal vectors
        keep = np.lexsort((ids[every], -exact))[:k]
        out += [(int(q_ids[q]), int(ids[every[i]]), float(exact[i])) for i in keep]
    return out


def usable(vector: str) -> Column:
    """Vectors that take part: no null or non-finite component, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is a query, among all other rows."""
    ship(rows.sparkSession)
    good = rows.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    width = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    good = good.filter(F.size("v") == width[0])
    plane = directions(width[0], seed)
    total = good.count()
    share = min(1.0, SAMPLE / total)
    some = good.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("v").limit(2 * SAMPLE).toPandas()
    seen = project(_units(some["v"])[1], plane) if len(some) else np.zeros((0, DIMS))
    cells = min(CELLS_MAX, max(1, total // CELL_ROWS))
    nodes = split_tree(seen, max(1, len(seen) // max(1, cells)), cells)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                p = project(_units(frame["v"])[1], plane)
                yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "asks": frame["asks"], "cell": locate(nodes, p), "p": list(p)})

    placed = cut(good.mapInPandas(place, "id long, v array<double>, asks boolean, cell long, p array<double>"))
    edge = [f(F.col("p")[j]).alias(f"{n}{j}") for j in range(DIMS) for n, f in (("l", F.min), ("h", F.max))]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *edge).toPandas()  # at most CELLS_MAX rows
    low, high = (boxes[[f"{n}{j}" for j in range(DIMS)]].to_numpy() for n in "lh")
    cells_of = boxes["cell"].to_numpy()
    factor = chi_square_quantile(recall, DIMS)

    def visit(first: int, last: int):
        """Each query once for every cell, from the first-th nearest to before the last-th, that its bound reaches."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), 256):
                    part = frame.iloc[start : start + 256]
                    reach = _boxes_distance(np.stack(part["p"]), low, high)
                    near = np.argsort(reach, axis=1, kind="stable")[:, first:last]
                    bound = part["bound"].to_numpy(float)
                    at, nth = np.nonzero(np.take_along_axis(reach, near, 1) <= bound[:, None] * factor + 1e-9)
                    yield pd.DataFrame({"cell": cells_of[near[at, nth]], "id": part["id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "p": part["p"].to_numpy()[at], "bound": bound[at]})

        return run

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["bound"].notna().to_numpy()
        out: list[tuple[int, int, float]] = []
        if asks.any() and not asks.all():
            _, unit = _units(frame["v"])
            spot, ids = np.stack(frame["p"]), frame["id"].to_numpy()
            out = search(unit[~asks], ids[~asks], spot[~asks], unit[asks], ids[asks], spot[asks], frame["bound"].to_numpy(float)[asks], k, factor)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def met(sent: DataFrame) -> DataFrame:
        """The best k that each query finds in each part of the cells it was sent to."""
        asked = sent.groupBy("cell").count().toPandas()  # at most CELLS_MAX rows
        both = boxes[["cell", "n"]].merge(asked, on="cell")
        parts = pd.DataFrame({"cell": both["cell"], "parts": -(-both["n"] // (2 * CELL_ROWS)), "blocks": -(-both["count"] // QUERY_ROWS)})
        parts = F.broadcast(rows.sparkSession.createDataFrame(parts, "cell long, parts long, blocks long"))
        dealt = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        held = placed.join(parts, "cell").withColumn("part", dealt("part", "parts")).withColumn("block", every("blocks"))
        come = sent.join(parts, "cell").withColumn("block", dealt("block", "blocks")).withColumn("part", every("parts"))
        names = ["cell", "part", "block", "id", "v", "p"]
        rest = held.select(*names, F.lit(None).cast("double").alias("bound")).union(come.select(*names, "bound"))
        return rest.groupBy("cell", "part", "block").applyInPandas(look, "query_id long, vec_id long, score double")

    asking = cut(placed.filter("asks").groupBy("id").agg(F.min(F.struct("v", "p")).alias("x")).select("id", "x.v", "x.p"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    first, last = 0, 1
    while first < len(cells_of):
        kth = found.filter(F.col("rank") == k).select("query_id", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("d"))
        bounded = asking.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "p", F.coalesce("d", F.lit(4.0)).alias("bound"))
        sent = cut(bounded.mapInPandas(visit(first, last), "cell long, id long, v array<double>, p array<double>, bound double"))
        if sent.isEmpty():
            break
        found = cut(top(found.select("query_id", "vec_id", "score").union(met(sent))))
        first, last = last, last * (1 + GROW)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
