"""Near-duplicate components by an exact n-gram Jaccard join with token-combination prefixes.

Method. A document is the set of its distinct shingles, as 64-bit hashes. Documents of equal sets form a class with its smallest id as
representative. For sizes n in [2**b, 2**(b+1)), band b, two sets of similarity t share at least l(b) of the first
n - ceil(t n) + l(b) tokens in hash order, their extended prefixes. Tokens of extended prefixes are counted over all classes, and each prefix is put in order of
frequency class, rarest first. Reading on until more tokens are covered than may differ, a set is indexed by single
tokens while they are rare, and by pairs of tokens of the same one of S(b) = l(b) - 1 subclasses where they are frequent; n tokens
of a subclass cover n - 1. Two similar sets then have an index entry in common. A passage that many documents share thus only
joins documents that share most of the rest too, and tokens that occur once are never sent.

This is done twice. A first index with prefixes extended little, by FIRST, is cheap and only tells which sets can have a link at all;
the second covers those few with prefixes extended to nearly the whole sets, by SECOND, so that documents that share less than most of their
tokens with others have no entry.

Counting uses packed blocks: tasks send sorted tokens by hash range, and get the classes of the shared ones back.
Candidates are compared with the smallest member of their entry first; what is verified becomes a component, and in a
second round only candidates of different components are compared, and of those only the ones that sketches of 1024 parities can't tell apart. So a group of thousands of near copies costs a comparison a member, not
one a pair. Verification intersects whole sets.

Cases. Null, empty and blank texts have empty sets, are linked with nothing and are their own component. Texts of fewer
words than a shingle are one shingle. Ids must be integers; rows with a null id are linked with nothing and their component is null. Repeated rows of an id count as equal documents. An empty table
gives an empty result. Extra columns are ignored by ``find`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release, ship
from quillspark.llm.components import components
from quillspark.llm.shingles import batches, mix, shingle_sets

#: Similarity, as a fraction.
OF, PER = 75, 100
#: Parts of a set by which its prefix is extended: in the first index, which only finds out who can have a link at all,
#: and in the second, of those alone, which makes candidates.
FIRST, SECOND = 0.15, 0.75
#: Classes with a token up to which it is indexed singly.
RARE = 64
#: Bits of the parity sketch that tells apart most candidates of the second round.
SKETCH = 1024
#: Tokens of a block of documents that are counted together, and of a hash range.
BLOCK_TOKENS = 1_500_000
RANGE_TOKENS = 1 << 18


def band_of(n: np.ndarray | int):
    """floor(log2 n)."""
    return np.frexp(np.asarray(n, np.float64))[1] - 1


def extension(band, extend: float):
    """l(b): tokens that two extended prefixes of band b share at least; at most t 2**b, which similar sets share."""
    return np.maximum(1, np.floor(extend * np.exp2(band))).astype(np.int64)


def spare(n):
    """n - ceil(t n): tokens that may be missing from the other set."""
    return n - -(-np.asarray(n, np.int64) * OF // PER)


def _texts(frames: Iterator[pd.DataFrame]):
    """Ids and shingle sets of a task's rows, in batches of bounded size."""
    for frame in frames:
        texts = frame["text"].tolist()
        for a, b in batches(texts):
            yield frame["id"].to_numpy()[a:b], shingle_sets(texts[a:b])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, sets in _texts(frames):
        sums = [(len(s), int(_signed(mix(s).sum(dtype=np.uint64, keepdims=True))[0]), int(_signed(mix(~s).sum(dtype=np.uint64, keepdims=True))[0])) for s in sets]
        yield pd.DataFrame({"id": ids, "n": [x[0] for x in sums], "s1": [x[1] for x in sums], "s2": [x[2] for x in sums]})


def _stored(frames: Iterator[pd.DataFrame]):
    """The same from sets that were kept."""
    for frame in frames:
        yield frame["id"].to_numpy(), [np.asarray(t, np.int64).view(np.uint64) for t in frame["tokens"]]


def _blocks(parts: int, extend: float, source):
    """Split the extended prefixes of a block of documents by hash range; a row for the block itself has part -1."""

    def flush(block: int, ids: list, ns: list, tokens: list) -> pd.DataFrame:
        every = np.concatenate(tokens)
        place = (every & np.uint64(parts - 1)).astype(np.int64)
        rest = ((every >> np.uint64(parts.bit_length() - 1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(parts + 1))
        rest = rest[order]
        rows = [(block, -1, np.array(ids, np.int64).tobytes(), np.array(ns, np.int64).tobytes())]
        rows += [(block, p, _steps(order[a:b]), rest[a:b].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pd.DataFrame(rows, columns=["block", "part", "x", "y"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        ids, ns, tokens, size = [], [], [], 0
        for keys, sets in source(frames):
            for key, s in zip(keys, sets, strict=True):
                if len(s):
                    ids.append(key)
                    ns.append(len(s))
                    tokens.append(s[: int(spare(len(s)) + extension(band_of(len(s)), extend))])
                    size += len(tokens[-1])
                if size >= BLOCK_TOKENS:
                    yield flush(block, ids, ns, tokens)
                    block, ids, ns, tokens, size = block + 1, [], [], [], 0
        if ids:
            yield flush(block, ids, ns, tokens)

    return run


def _steps(at: np.ndarray) -> bytes:
    """Ascending positions as 16-bit steps; a step beyond that is led by as many full ones as it needs."""
    steps = np.diff(at, prepend=0)
    full = steps // 65535
    if not full.any():
        return steps.astype(np.uint16).tobytes()
    out = np.full(len(steps) + int(full.sum()), 65535, np.uint16)
    out[np.cumsum(full + 1) - 1] = steps % 65535
    return out.tobytes()


def _positions(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint16).astype(np.int64)
    at = np.cumsum(steps)
    return at[steps != 65535] if (steps == 65535).any() else at


def _classes(parts: int):
    """Of one hash range: the frequency class of every token that more than one prefix holds, for each block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        sizes = [len(y) // 4 for y in frame["y"]]
        rest = np.frombuffer(b"".join(frame["y"]), np.uint32)
        at = np.concatenate([_positions(x) for x in frame["x"]])
        _, inverse, counts = np.unique(rest, return_inverse=True, return_counts=True)
        count = counts[inverse]
        level = band_of(count).astype(np.uint64)
        # The class in the top byte orders tokens; it tells rare from frequent too.
        token = (rest.astype(np.uint64) * np.uint64(parts) + np.uint64(part)) & np.uint64((1 << 56) - 1)
        token |= level << np.uint64(56)
        rows, a = [], 0
        for block, n in zip(frame["block"], sizes, strict=True):
            keep = count[a : a + n] > 1
            if keep.any():
                rows.append((block, 0, _steps(at[a : a + n][keep]), token[a : a + n][keep].tobytes()))
            a += n
        return pd.DataFrame(rows, columns=["block", "part", "x", "y"])

    return run


def _entries_of(tokens: np.ndarray, ranks: np.ndarray, n: int, extend: float, only_ask: bool) -> list[np.ndarray]:
    """Index entries of one set from its shared prefix tokens and their ranks in hash order; with ``only_ask``, of any if it has some."""
    out = []
    own, smallest = int(band_of(n)), -(-n * OF // PER)
    for band in sorted({own, int(band_of(smallest))}):
        share = int(extension(band, extend))
        mine = tokens[ranks < spare(n) + share]
        need = int(spare(n)) + 1 - int(spare(n) + share - len(mine))  # tokens of this prefix that none shares cover first
        if need <= 0:
            continue
        if only_ask:
            return [mine[:1]]
        mine = np.sort(mine)
        tag = np.uint64((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        rare = int(np.searchsorted(mine, np.uint64(int(np.log2(RARE)) << 56)))
        groups = min(share - 1, 1 << band >> 3)
        if groups < 1:
            rare = len(mine)
        single = mine[: min(rare, need)]
        out.append(mix(single ^ tag))
        left = need - len(single)
        if left > 0 and rare < len(mine):
            held: dict[int, list[int]] = {}
            pairs = []
            for token, group in zip(mine[rare:].tolist(), (mix(mine[rare:]) % np.uint64(groups)).tolist(), strict=True):
                members = held.setdefault(group, [])
                pairs += [(x, token) for x in members]
                left -= bool(members)
                members.append(token)
                if left <= 0:
                    break
            if pairs:
                p = np.array(pairs, np.uint64)
                out.append(mix(mix(p[:, 0] ^ tag) + p[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return out


def _entries(extend: float, only_ask: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Index entries (key, id, n) of the representatives of one block."""
        own, named, back = (frame["part"] == -1), (frame["part"] == -2), (frame["part"] >= 0)
        stands = np.frombuffer(b"".join(frame.loc[named, "x"]), np.int64)
        ids = np.frombuffer(frame.loc[own, "x"].iloc[0], np.int64)
        ns = np.frombuffer(frame.loc[own, "y"].iloc[0], np.int64)
        sizes = spare(ns) + extension(band_of(ns), extend)
        starts = np.cumsum(sizes) - sizes
        at = np.concatenate([np.zeros(0, np.int64), *[_positions(x) for x in frame.loc[back, "x"]]])
        tokens = np.frombuffer(b"".join(frame.loc[back, "y"]), np.uint64)
        order = np.argsort(at, kind="stable")
        at, tokens = at[order], tokens[order]
        edges = np.searchsorted(at, np.append(starts, starts[-1] + sizes[-1]))
        keys, who = [], []
        chosen = np.isin(ids, stands)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a and chosen[i]:
                for k in _entries_of(tokens[a:b], at[a:b] - starts[i], int(ns[i]), extend, only_ask):
                    keys.append(k)
                    who.append(np.full(len(k), i))
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        of = np.concatenate([np.zeros(0, np.int64), *who]).astype(np.int64)
        return pd.DataFrame({"key": _signed(every), "id": ids[of], "n": ns[of]})

    return run


def _index(rows: DataFrame, source, total: int, extend: float, reps: DataFrame, only_ask: bool) -> DataFrame:
    """Entries (key, id, n) of the representatives among rows; with ``only_ask`` one for each that has any."""
    parts = 1
    while parts * RANGE_TOKENS < total:
        parts *= 2
    layout = "block long, part int, x binary, y binary"
    sent = cut(rows.mapInPandas(_blocks(parts, extend, source), layout))
    back = sent.filter("part >= 0").groupBy("part").applyInPandas(_classes(parts), layout)
    # One member of a class, its representative, is indexed for all.
    listed = sent.filter("part = -1").mapInPandas(_members, "block long, id long").join(reps, "id", "left_semi")
    named = listed.groupBy("block").applyInPandas(_named, layout)
    found = cut(sent.filter("part = -1").union(back).union(named).groupBy("block").applyInPandas(_entries(extend, only_ask), "key long, id long, n int"))
    del sent, back, listed, named
    release(rows.sparkSession)
    return found


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of each block."""
    for frame in frames:
        for block, x in zip(frame["block"], frame["x"], strict=True):
            yield pd.DataFrame({"block": block, "id": np.frombuffer(x, np.int64)})


def _named(frame: pd.DataFrame) -> pd.DataFrame:
    """The representatives of one block as one row."""
    return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [-2], "x": [frame["id"].to_numpy(np.int64).tobytes()], "y": [b""]})


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole sets, each with the parities of its tokens in SKETCH places."""
    for ids, sets in _texts(frames):
        bits = [np.packbits(np.bincount((mix(s) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64) for s in sets]
        yield pd.DataFrame({"id": ids, "tokens": [_signed(s) for s in sets], "bits": bits})


def _apart(a: str, b: str) -> str:
    """Sets that differ in more tokens than similar ones can: two parities differ in no more places than the sets in tokens."""
    differ = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(SKETCH // 64))
    return f"{differ} > {a}.n + {b}.n - 2 * ceil({OF} * ({a}.n + {b}.n) / {PER + OF})"


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.filter(f"{PER} * i >= {OF} * (size(ta) + size(tb) - i)").select("a", "b")


def _fit(a: str, b: str) -> str:
    """Sizes that can be similar."""
    return f"least({a}, {b}) * {PER} >= greatest({a}, {b}) * {OF}"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links), class_id (smallest of an equal set)."""
    ship(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = every.filter("id IS NOT NULL")
    rows = cut(slim.mapInPandas(_summaries, "id long, n int, s1 long, s2 long"))
    classes = cut(rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    asked = _index(slim, _texts, int(total * ((PER - OF) / PER + FIRST)), FIRST, reps, True)
    # Whole sets of those that can have a link.
    sets = cut(slim.join(asked.select("id").distinct(), "id", "left_semi").mapInPandas(_sets, "id long, tokens array<long>, bits array<long>"))
    release(docs.sparkSession)
    total = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long")).first()[0]
    entries = _index(sets, _stored, total, SECOND, reps, False)
    hub = F.min(F.struct("id", "n")).over(Window.partitionBy("key"))
    near = entries.withColumn("hub", hub).filter("hub.id != id").filter(_fit("n", "hub.n")).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    near = cut(near)
    release(docs.sparkSession)
    links = cut(_verified(near, sets))
    release(docs.sparkSession)
    first = components(links)
    labelled = entries.join(first, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = Window.partitionBy("key")
    labelled = labelled.withColumns({"low": F.min("c").over(mixed), "high": F.max("c").over(mixed)}).filter("low < high").select("key", "id", "n", "c")
    labelled = cut(labelled.join(sets.select("id", "bits"), "id"))
    release(docs.sparkSession)
    a, b = labelled.alias("p"), labelled.alias("q")
    rest = a.join(b, F.expr(f"p.key = q.key AND p.id < q.id AND p.c != q.c AND {_fit('p.n', 'q.n')} AND NOT ({_apart('p', 'q')})")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    rest = rest.join(near, ["a", "b"], "left_anti")
    more = cut(_verified(rest, sets))
    groups = first if more.isEmpty() else components(links.union(more))
    named = classes.join(groups, classes["rep"] == groups["id"], "left").select("n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, ["n", "s1", "s2"], "left")
    out = out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"))
    nameless = every.filter("id IS NULL").select(F.lit(0).cast("long").alias("id"), "text").mapInPandas(_summaries, "id long, n int, s1 long, s2 long")
    null = F.lit(None).cast("long")
    return out.union(nameless.select(null, F.col("n").cast("long"), null, null))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, and those without id, with all their columns."""
    goes = find(docs, id_col, text_col).filter("id != component_id").select(F.col("id").alias("__id")).distinct()
    return docs.join(goes, docs[id_col].cast("long") == goes["__id"], "left_anti")
