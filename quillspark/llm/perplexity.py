"""Quality filter: an interpolated modified Kneser-Ney model of character n-grams trained on trusted text.

Method. Every ORDER characters in a row of all trusted texts are counted (real code points, case kept, a boundary before and after a
text); lower orders count distinct characters before. Tables of all orders stay distributed and grow with the input.
Trusted text is halved by a hash of its content and a model made of each half; every document, trusted or not, is judged by the
model of the half that its text isn't in, so bounds and documents are compared on equal terms.

Scoring is a sharded count join. Documents are dealt into blocks of about BLOCK_CHARS; a block asks each shard of the
model, a range of n-gram hashes, once for every distinct n-gram it holds, in packed form, and the answers come back to the block. So
texts are shuffled once, compressed, and n-grams that documents share are sent once a block. The bits a symbol of a
document, drawn to the trusted mean of its language by PRIOR symbols so that a short text isn't judged on a few rare letters, are held
against the quantile HIGH of the trusted documents of its language (or SPREAD deviations, see there).

Bounds. A block asks by 32 bits of hash within a shard of at most about SHARD_KEYS asked keys: an unseen n-gram is taken for a seen one about once
in ten thousand. Bits are rounded to 1/1024. A filter of FILTER_BITS bits on trusted ids, broadcast, keeps most other texts
out of the join that finds the trusted ones; that join is exact.

Cases. Null and empty texts score the trusted mean and are kept. Null language is a language of its own; languages
without trusted text use the quantile of all. With no trusted text at all every document is kept. Repeated rows and equal texts score
alike. Extra columns pass through. Texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release, ship
from quillspark.llm.shingles import batches, mix

ORDER = 5
#: Bits of a symbol: 0 is the boundary, others are code points plus one.
WIDE = 21
PRIOR = 200
#: Kept up to this quantile of the trusted documents' bits a symbol, or, as few documents don't show it, so many standard deviations
#: above their mean if that is more.
HIGH = 0.998
SPREAD = 4.0
#: Bins of a bit in which values are counted for quantiles.
BINS = 2048
#: Languages whose bounds are broadcast; beyond, they are joined.
LANGUAGES = 10_000
#: Characters of a block of documents, and keys asked of a shard.
BLOCK_CHARS = 16_000_000
SHARD_KEYS = 1_500_000
#: Distinct n-grams that a counting task holds.
HELD = 1_500_000
#: Characters made into n-grams at once.
RUN_CHARS = 400_000
FILTER_BITS = 1 << 25

_ONE = (1 << WIDE) - 1
_ABSENT = 65535
_STEP = 1024
_LOW, _HIGH = mix(np.array([41, 42], np.uint64)) | np.uint64(1)


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts with boundaries between, places of the symbols to predict, and where each text's begin among these."""
    pad, sizes = ORDER - 1, np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    nth = np.arange(1, len(texts) + 1)
    out = np.zeros(len(points) + pad * (len(texts) + 1), np.int64)
    out[np.arange(len(points)) + np.repeat(pad * nth, sizes)] = points + np.uint32(1)
    firsts = np.cumsum(sizes) - sizes + pad * nth
    asked = np.arange(len(points) + len(texts)) + np.repeat((pad - 1) * nth + 1, sizes + 1)
    return out, asked, firsts - (pad - 1) * nth - 1


def grams_of(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each place, exactly: its first symbols and its last three."""
    high = np.zeros(len(at), np.int64)
    for k in range(ORDER - 1, 2, -1):
        high = high << WIDE | symbols[at - k]
    return high, (symbols[at - 2] << 2 * WIDE) | (symbols[at - 1] << WIDE) | symbols[at]


def suffix(high, low, n: int):
    """The last n symbols of an n-gram."""
    if n > 3:
        return high & ((1 << WIDE * (n - 3)) - 1), low
    return high & 0, low & ((1 << WIDE * n) - 1)


def context(high, low):
    """All but the last symbol."""
    return high >> WIDE, ((high & _ONE) << 2 * WIDE) | (low >> WIDE)


def hashed(high: np.ndarray, low: np.ndarray, n: int, half: int) -> np.ndarray:
    return mix(low.astype(np.uint64) ^ mix(high.astype(np.uint64) + np.uint64((2 * n + half) << 48)))


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits that tell ORDER-grams apart."""
    return low.view(np.uint64) * _LOW + high.view(np.uint64) * _HIGH


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the grams each is, and the distinct ones."""
    codes, _ = pd.factorize(_key(high, low).view(np.int64))
    first = np.zeros(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, high[first], low[first]


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers compressed byte by byte: all first bytes, all second ones and so on."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _numbers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


_COUNTS = "part int, half int, high binary, low binary, c binary"


def _count(parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the ORDER-grams of a task's texts, by half and range of hashes, sorted and compressed."""
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def merge() -> None:
            for half, lists in held.items():
                if len(lists) > 1:
                    high, low, n = (np.concatenate(x) for x in zip(*lists, strict=True))
                    codes, high, low = distinct(high, low)
                    held[half] = [(high, low, np.bincount(codes, n).astype(np.int64))]

        def give() -> Iterator[pd.DataFrame]:
            merge()
            for half, lists in held.items():
                for high, low, n in lists:
                    part = (hashed(high, low, ORDER, half) % np.uint64(parts)).astype(np.int32)
                    order = np.lexsort((low, high, part))
                    edges = np.searchsorted(part[order], np.arange(parts + 1))
                    rows = [(p, half, *[_planes(x[order[a:b]]) for x in (high, low, n)]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                    yield pd.DataFrame(rows, columns=["part", "half", "high", "low", "c"])
                held[half] = []

        for frame in frames:
            for half in (0, 1):
                texts = frame["text"][frame["half"] == half].tolist()
                for a, b in batches(texts, RUN_CHARS):
                    codes, high, low = distinct(*grams_of(*symbols_of(texts[a:b])[:2]))
                    held[half].append((high, low, np.bincount(codes).astype(np.int64)))
                    size += len(high)
            if size > HELD:
                merge()
                size = sum(len(p[0]) for lists in held.values() for p in lists)
                if size > HELD:
                    yield from give()
                    size = 0
        yield from give()

    return run


def _sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    """The counts of one range of hashes, summed over tasks."""
    out = []
    for half, own in frame.groupby("half"):
        high, low, n = (np.concatenate([_numbers(x) for x in own[c]]) for c in ("high", "low", "c"))
        codes, high, low = distinct(high, low)
        out.append(pd.DataFrame({"half": np.full(len(high), half, np.int32), "high": high, "low": low, "c": np.bincount(codes, n).astype(np.int64)}))
    return pd.concat(out)


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), text), F.lit(2)).cast("int")


def trusted_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text and half of the documents whose id is among ids (__trusted)."""
    bit = F.pmod(F.xxhash64("__trusted"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__trusted), {FILTER_BITS}) & 63 as int))").alias("m"))
    words = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter("id IS NOT NULL AND text != ''")
    slim = slim.filter(maybe(F.pmod(F.xxhash64(F.col("id").cast(ids.schema["__trusted"].dataType)), F.lit(FILTER_BITS))))
    return slim.join(ids.hint("merge"), F.col("id") == F.col("__trusted")).select("text", half_of(F.col("text")).alias("half"))


def _discounts(counts: list[DataFrame]) -> dict[tuple[int, int], list[float]]:
    """By order and half, what modified Kneser-Ney takes off counts of 1, 2 and more; all orders in one pass, as each pass costs the driver its tasks."""
    every = None
    for n, counted in enumerate(counts, 1):
        own = counted.select(F.lit(n).alias("n"), "half", "c")
        every = own if every is None else every.union(own)
    out = {}
    for row in every.groupBy("n", "half").agg(*[F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():  # two rows an order
        of = [row[f"n{i}"] for i in (1, 2, 3, 4)]
        y = of[0] / max(of[0] + 2 * of[1], 1.0)
        out[row["n"], row["half"]] = [max(0.1, min(i - 0.1, i - (i + 1) * y * of[i] / max(of[i - 1], 1.0))) for i in (1, 2, 3)]
    return out


def _discounted(counts: DataFrame, off: list[list[float]]) -> DataFrame:
    """Counts (c) with what is taken off each (d), by half."""
    d = [F.when(F.col("half") == 0, off[0][i]).otherwise(off[1][i]) for i in range(3)]
    return counts.withColumn("d", F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))


def _shift(high: str, low: str) -> list[Column]:
    """The context of a gram, as columns."""
    return [F.shiftright(high, WIDE).alias("x"), F.shiftleft(F.col(high).bitwiseAND(_ONE), 2 * WIDE).bitwiseOR(F.shiftright(low, WIDE)).alias("y")]


def _drop_first(n: int) -> list[Column]:
    """The last n symbols of a gram, as columns."""
    if n > 3:
        return [F.col("high").bitwiseAND((1 << WIDE * (n - 3)) - 1).alias("high"), F.col("low")]
    return [F.lit(0).cast("long").alias("high"), F.col("low").bitwiseAND((1 << WIDE * n) - 1).alias("low")]


def train(texts: DataFrame, parts: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """The packed model of texts (text, half), a row a shard, and the bits of an unknown symbol by half."""
    rows, unknown = levels(texts, parts)
    packed = rows.mapInPandas(_model_rows(parts), "part int, key long, kind int, value int").groupBy("part").applyInPandas(_pack_model, _MODEL)
    return cut(packed), unknown


def levels(texts: DataFrame, parts: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """The model of texts (text, half): rows (half, n, high, low, kind, value), where kind 0 gives the bits of an n-gram after its
    context and kind 1 the bits of falling back from a context of n symbols; and the bits of an unknown symbol by half.
    """
    top = cut(texts.mapInPandas(_count(parts), _COUNTS).groupBy("part").applyInPandas(_sum_counts, "half int, high long, low long, c long"))
    counts = [top]
    for n in range(ORDER - 1, 0, -1):
        counts.insert(0, cut(counts[0].select("half", *_drop_first(n)).groupBy("half", "high", "low").agg(F.count("*").alias("c"))))
    bits = lambda x: (-F.log2(x)).alias("value")
    rows, below, unknown = None, None, {0: 0.0, 1: 0.0}
    off = _discounts(counts)
    for n, counted in enumerate(counts, 1):
        found = _discounted(counted, [off.get((n, half), [0.0, 0.0, 0.0]) for half in (0, 1)]).select("half", "high", "low", "c", "d", *_shift("high", "low"))
        if n == 1:
            found = found.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
        freed = cut(found.groupBy("half", "x", "y").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"), F.count("*").alias("kinds")))
        found = found.join(freed, ["half", "x", "y"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if n == 1:
            for row in freed.select("half", -F.log2(F.col("g") / (F.col("kinds") + 1))).collect():  # one row a half
                unknown[row[0]] = row[1]
            below = cut(found.select("half", "high", "low", (own + F.col("g") / (F.col("kinds") + 1)).alias("p")))
        else:
            shorter = below.select("half", F.col("high").alias("u"), F.col("low").alias("v"), F.col("p").alias("q"))
            u, v = _drop_first(n - 1)
            found = found.select("half", "high", "low", "g", own.alias("own"), u.alias("u"), v.alias("v")).join(shorter, ["half", "u", "v"])
            below = cut(found.select("half", "high", "low", (F.col("own") + F.col("g") * F.col("q")).alias("p")))
            rows = rows.union(freed.select("half", F.lit(n - 1).alias("n"), F.col("x").alias("high"), F.col("y").alias("low"), F.lit(1).alias("kind"), bits(F.col("g"))))
        own_rows = below.select("half", F.lit(n).alias("n"), "high", "low", F.lit(0).alias("kind"), bits(F.col("p")))
        rows = own_rows if rows is None else rows.union(own_rows)
        del found, freed
        release(texts.sparkSession)
    return rows, unknown


_MODEL = "part int, " + ", ".join(f"k{i} binary, v{i} binary" for i in range(3))


def _pack_model(frame: pd.DataFrame) -> pd.DataFrame:
    """Sorted keys and values of one shard of the model, by kind."""
    row: dict = {"part": frame["part"].iloc[:1]}
    for kind in range(3):
        own = frame[frame["kind"] == kind].sort_values("key")
        row[f"k{kind}"], row[f"v{kind}"] = [own["key"].to_numpy(np.uint32).tobytes()], [own["value"].to_numpy(np.uint16).tobytes()]
    return pd.DataFrame(row)


def _place(h: np.ndarray, parts: int) -> np.ndarray:
    """Shard and 32 bits of a hash, as one number that sorts by shard."""
    return ((h & np.uint64(parts - 1)) << np.uint64(32)) | ((h >> np.uint64(parts.bit_length() - 1)) & np.uint64(0xFFFFFFFF))


def asked_keys(high: np.ndarray, low: np.ndarray, half: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block needs to know of its distinct grams: sorted places of n-grams below ORDER and contexts, and of the grams."""
    lower = []
    grams = [suffix(high, low, n) for n in range(1, ORDER)]
    for n, (x, y) in enumerate(grams, 1):
        lower.append(_place(hashed(x, y, n, half), parts))
    for n, (x, y) in enumerate([*grams[1:], (high, low)], 1):
        lower.append(_place(hashed(*context(x, y), n, half), parts))
    return np.unique(np.concatenate([np.unique(x) for x in lower])), np.unique(_place(hashed(high, low, ORDER, half), parts))


def gram_bits(high: np.ndarray, low: np.ndarray, half: int, parts: int, keys: tuple, answers: tuple, unknown: float) -> np.ndarray:
    """Bits of each gram's last symbol after the others, from the answers on a block's keys."""
    (lower, top), (p_lower, g_lower, p_top) = keys, answers
    bits = np.full(len(low), unknown)
    for n in range(1, ORDER + 1):
        x, y = suffix(high, low, n) if n < ORDER else (high, low)
        at = _place(hashed(x, y, n, half), parts)
        p = p_top[np.searchsorted(top, at)] if n == ORDER else p_lower[np.searchsorted(lower, at)]
        g = g_lower[np.searchsorted(lower, _place(hashed(*context(x, y), n - 1, half), parts))] if n > 1 else np.full(len(low), _ABSENT, np.uint16)
        back = np.where(g == _ABSENT, 0, g / _STEP)
        bits = np.where(p == _ABSENT, bits + back, p / _STEP)
    return bits


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"block": frame["block"], "key": frame["key"], "z": [zlib.compress(t.encode("utf-8", "replace"), 3) for t in frame["text"]]})


def _unpack(blobs) -> list[str]:
    return [zlib.decompress(z).decode() for z in blobs]


def _runs(blobs) -> Iterator[tuple[int, int, list[str]]]:
    """Texts of a block, a bounded number of characters at a time."""
    step = 64
    for start in range(0, len(blobs), step):
        texts = _unpack(blobs[start : start + step])
        for a, b in batches(texts, RUN_CHARS):
            yield start + a, start + b, texts[a:b]


def _block_grams(blobs, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block. ``keep`` gets, for each run of texts, its first and last, where each text's symbols begin,
    which of the run's own grams every symbol ends, and which of the block's these are.
    """
    high, low = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b, texts in _runs(blobs):
        symbols, at, firsts = symbols_of(texts)
        codes, *own = distinct(*grams_of(symbols, at))
        if keep is not None:
            keep.append([a, b, firsts, codes.astype(np.int32), _key(*own)])
        held.append(tuple(own))
        size += len(own[0])
        if size > RUN_CHARS:
            _, high, low = distinct(*(np.concatenate(x) for x in zip((high, low), *held, strict=True)))
            held, size = [], 0
    _, high, low = distinct(*(np.concatenate(x) for x in zip((high, low), *held, strict=True)))
    if keep:
        keys = _key(high, low)
        order = np.argsort(keys)
        keys = keys[order]
        for run in keep:
            run[4] = order[np.searchsorted(keys, run[4])].astype(np.int32)
    return high, low


def _ask(parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """One row for each shard: the keys asked of it."""
        block = int(frame["block"].iloc[0])
        lower, top = asked_keys(*_block_grams(frame["z"]), block & 1, parts)
        edges = np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)
        a, b = np.searchsorted(lower, edges), np.searchsorted(top, edges)
        short = lambda x: x.astype(np.uint32).tobytes()
        rows = [(block, p, short(lower[a[p] : a[p + 1]]), short(top[b[p] : b[p + 1]])) for p in range(parts)]
        return pd.DataFrame([r for r in rows if r[2] or r[3]], columns=["block", "part", "x", "y"])

    return run


def _model_rows(parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shard, key and rounded value of the model's rows; kind 2 is an n-gram of the highest order."""
        for frame in frames:
            half, n = frame["half"].to_numpy(np.uint64), frame["n"].to_numpy(np.uint64)
            h = mix(frame["low"].to_numpy(np.uint64) ^ mix(frame["high"].to_numpy(np.uint64) + ((np.uint64(2) * n + half) << np.uint64(48))))
            at = _place(h, parts)
            value = np.clip(np.round(frame["value"].to_numpy(float) * _STEP), 0, _ABSENT - 1)
            kind = np.where(n == ORDER, 2, frame["kind"].to_numpy(int))
            yield pd.DataFrame({"part": (at >> np.uint64(32)).astype(np.int32), "key": (at & np.uint64(0xFFFFFFFF)).astype(np.int64), "kind": kind.astype(np.int32), "value": value.astype(np.int32)})

    return run


def _answer(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """For each block that asked this shard: bits of its lower n-grams, of falling back from them, and of its grams."""
    tables = [(np.zeros(0, np.int64), np.zeros(0, np.uint16))] * 3
    if len(model):
        row = model.iloc[0]
        tables = [(np.frombuffer(row[f"k{i}"], np.uint32).astype(np.int64), np.frombuffer(row[f"v{i}"], np.uint16)) for i in range(3)]

    def look(asked: np.ndarray, kind: int) -> np.ndarray:
        keys, values = tables[kind]
        if not len(keys):
            return np.full(len(asked), _ABSENT, np.uint16)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], _ABSENT).astype(np.uint16)

    out = []
    for block, part, x, y in zip(asks["block"], asks["part"], asks["x"], asks["y"], strict=True):
        lower, top = np.frombuffer(x, np.uint32).astype(np.int64), np.frombuffer(y, np.uint32).astype(np.int64)
        out.append((block, part, look(lower, 0).tobytes(), look(lower, 1).tobytes(), look(top, 2).tobytes()))
    return pd.DataFrame(out, columns=["block", "part", "p", "g", "t"])


def _score(parts: int, unknown: dict[int, float]):
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"key": [], "bits": [], "symbols": []})
        half = int(texts["block"].iloc[0]) & 1
        runs: list = []
        high, low = _block_grams(texts["z"], runs)
        keys = asked_keys(high, low, half, parts)
        answers = answers.sort_values("part")
        known = tuple(np.frombuffer(b"".join(answers[c]), np.uint16) for c in "pgt")
        if len(known[0]) != len(keys[0]) or len(known[2]) != len(keys[1]):
            raise ValueError("answers don't fit the block's keys")
        each = gram_bits(high, low, half, parts, keys, known, unknown[half])
        bits, symbols = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b, firsts, codes, own in runs:
            bits[a:b] = np.add.reduceat(each[own][codes], firsts)
            symbols[a:b] = np.diff(np.append(firsts, len(codes)))
        return pd.DataFrame({"key": texts["key"], "bits": bits, "symbols": symbols})

    return run


def layout(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Blocks of each half of the documents, and shards of the model."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0))).first()[0]
    parts = 1
    while parts * SHARD_KEYS * 20 < chars:  # a block asks some key for every twenty characters
        parts *= 2
    return max(1, -(-chars // (2 * BLOCK_CHARS))), parts


def score_texts(texts: DataFrame, model: DataFrame, unknown: dict[int, float], blocks: int = 1, parts: int = 1) -> DataFrame:
    """key, bits and symbols of texts (id, key, text), once for each key. Texts of one half are judged by the model of the other."""
    block = 2 * F.pmod(F.xxhash64("id", "key"), F.lit(blocks)) + 1 - half_of(F.col("text"))
    packed = texts.select(block.alias("block"), "key", "text").mapInPandas(_pack, "block long, key long, z binary")
    asks = packed.groupBy("block").applyInPandas(_ask(parts), "block long, part int, x binary, y binary")
    answers = asks.groupBy("part").cogroup(model.groupBy("part")).applyInPandas(_answer, "block long, part int, p binary, g binary, t binary")
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(parts, unknown), "key long, bits double, symbols long")
    return scored.groupBy("key").agg(F.first("bits").alias("bits"), F.first("symbols").alias("symbols"))


def upper_bounds(rows: DataFrame, keys: list[str], value: str, high: float) -> DataFrame:
    """keys and bound: the quantile ``high`` of the values, up to 1/BINS, or SPREAD deviations above their mean if that is more.

    Values are counted in bins first, so a key of very many rows comes together as its bins.
    """
    v = F.col(value)
    bins = rows.groupBy(*keys, F.floor(v * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("n").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumns({"upto": upto, "all": F.sum("n").over(every)})
    edge = F.min(F.when(F.col("upto") >= high * F.col("all"), (F.col("bin") + 1) / BINS))
    centre = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - centre * centre, F.lit(0.0)))
    return bins.groupBy(*keys).agg(F.greatest(edge, centre + SPREAD * spread).alias("bound"), F.sum("n").alias("n")).filter("n > 0")


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = HIGH) -> DataFrame:
    """The documents with __bits (drawn perplexity, bits a symbol), __high (bound of its language), __kept.

    ``trusted_ids`` has one column: ids of trusted documents.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("__trusted")).distinct()
    blocks, parts = layout(docs, text_col)
    model, unknown = train(trusted_texts(docs, ids, id_col, text_col), parts)
    release(spark)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    scores = cut(score_texts(docs.select(F.col(id_col).alias("id"), F.xxhash64(whole).alias("key"), whole.alias("text")), model, unknown, blocks, parts))
    del model
    release(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(whole).alias("key"))
    # An inner join stays above the scores; a semi-join would be pushed below them.
    known = cut(slim.join(scores, "key").join(ids, F.col("id") == F.col("__trusted")).select("lang", "bits", "symbols"))
    mean = lambda: F.sum("bits") / F.sum("symbols")
    drawn = lambda m: (F.col("bits") + PRIOR * m) / (F.col("symbols") + PRIOR)
    means = known.groupBy("lang").agg(mean().alias("m"))
    means = cut(means.select(F.col("lang").alias("__lang"), F.col("m").alias("__m")))
    few = (lambda df: F.broadcast(df)) if means.count() <= LANGUAGES else (lambda df: df)
    per = known.join(few(means), F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("d", drawn(F.col("__m")))
    per = cut(upper_bounds(per, ["__lang", "__m"], "d", high).select("__lang", "__m", F.col("bound").alias("__q"), F.lit(True).alias("__has")))
    overall = known.agg(mean().alias("m")).first()["m"] or 0.0
    all_of = upper_bounds(known.withColumn("d", drawn(F.lit(overall))), [], "d", high).first()
    bound = all_of["bound"] if all_of else None
    marked = scores.select(F.col("key").alias("__key"), F.struct("bits", "symbols").alias("__s"))
    # What is asked of the text is asked before the join, which then moves it only if the caller keeps it.
    scored = docs.withColumns({"__text": F.xxhash64(whole), "__empty": F.length(whole) == 0}).join(marked, F.col("__text") == F.col("__key"))
    joined = scored.join(few(per), F.col(f"`{lang_col}`").cast("string").eqNullSafe(F.col("__lang")), "left")
    own = F.coalesce("__has", F.lit(False))
    m = F.when(own, F.col("__m")).otherwise(F.lit(overall))
    q = F.when(own, F.col("__q")).otherwise(F.lit(bound).cast("double"))
    bits = F.when(F.col("__s.symbols") <= 1, m).otherwise((F.col("__s.bits") + PRIOR * m) / (F.col("__s.symbols") + PRIOR))
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], bits.alias("__bits"), q.alias("__high"), (F.col("__empty") | F.coalesce(bits <= q, F.lit(True))).alias("__kept"))
    return out
