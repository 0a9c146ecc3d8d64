"""Passages that repeat across documents, by sparse suffixes and the windows around them.

Method. Of every window of WINDOW successive GRAM-word grams the one with the smallest hash is retained, so the suffixes kept depend
on content alone and any LEAST words in a row hold at least one. Grams that occur in one text only are dropped. Of the
others every LEAST words in a row that hold one are hashed, so two documents that share LEAST words meet by a key that covers just
these, whatever other documents share with either. Repeated windows that overlap or touch are merged.

Texts that are equal word by word form a class and only its smallest id takes part; of the others, and it, the whole text repeats.

Windows are compared by 96 bits of hash.

Cases. Null, empty and texts of fewer than LEAST words have no passages. Repeats inside one document alone are not
reported. Ids must be integers, rows with a null id take no part; rows that repeat an id count as equal documents if their texts are. An empty table gives
an empty result. Extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release, ship
from quillspark.llm.shingles import batches, mix, word_hashes

LEAST = 50
GRAM = 10
PERIOD = 16
WINDOW = LEAST - GRAM
_WEIGHTS = mix(np.arange(2000, 2000 + GRAM, dtype=np.uint64)) | np.uint64(1)


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """The least or greatest of every ``w`` successive values, by doubling."""
    size, out = 1, x
    while size < w:
        step = min(size, w - size)
        out = best(out[:-step], out[step:])
        size += step
    return out


def retained(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window of a text."""
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams += words[j : j + n] * _WEIGHTS[j]
    grams = mix(grams)
    lows = _slide(grams, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    highs = _slide(np.concatenate([pad, lows, pad]), WINDOW, np.maximum)
    at = np.flatnonzero(highs == grams)
    # Of one word said over and over every gram is smallest: every PERIOD-th of such a run is enough, and its last.
    found = grams[at]
    follows = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (found[1:] == found[:-1])])
    begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    keep = ((np.arange(len(at)) - begin) % PERIOD == 0) | ~np.append(follows[1:], False)
    return at[keep], found[keep]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _sequences(frames: Iterator[pd.DataFrame]):
    """Rows and word hashes of texts, a text at a time."""
    for frame in frames:
        texts = frame["text"].tolist()
        for a, b in batches(texts):
            hashes, starts = word_hashes(texts[a:b], fold_case=False)
            for i in range(b - a):
                yield frame.iloc[a + i] if "places" in frame else frame["id"].iloc[a + i], hashes[starts[i] : starts[i + 1]]


def _signature(words: np.ndarray) -> tuple[int, int]:
    place = np.arange(len(words), dtype=np.uint64)
    return tuple(int(_signed(mix(words + mix(place + np.uint64(seed))).sum(dtype=np.uint64, keepdims=True))[0]) for seed in (1 << 40, 1 << 41))


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for key, words in _sequences(frames):
        if len(words) >= LEAST:
            out.append((key, len(words), *_signature(words)))
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=["id", "n", "s1", "s2"])
            out = []
    yield pd.DataFrame(out, columns=["id", "n", "s1", "s2"])


def _grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def give() -> pd.DataFrame:
        return pd.DataFrame({"gram": np.concatenate([h for _, h, _, _ in held]), "id": np.repeat([k for k, _, _, _ in held], [len(h) for _, h, _, _ in held]), "place": np.concatenate([p for _, _, p, _ in held]), "s1": np.repeat([s for _, _, _, s in held], [len(h) for _, h, _, _ in held])})

    for key, words in _sequences(frames):
        if len(words) >= LEAST:
            at, h = retained(words)
            held.append((key, _signed(h), at.astype(np.int32), _signature(words)[0]))
            size += len(at)
        if size >= 200_000:
            yield give()
            held, size = [], 0
    if held:
        yield give()


def _window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for each LEAST words in a row, by doubling."""
    size, powers = 1, {1: words}
    while 2 * size <= LEAST:
        x = powers[size]
        powers[2 * size] = mix(x[:-size] * _WEIGHTS[0] + x[size:])
        size *= 2
    n, done = len(words) - LEAST + 1, 0
    out = np.zeros(n, np.uint64)
    for size in sorted(powers, reverse=True):
        if done + size <= LEAST:
            out = mix(out * _WEIGHTS[1] + powers[size][done : done + n])
            done += size
    return _signed(out), (mix(words[:n] + out * _WEIGHTS[2] + words[LEAST - 1 :]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All LEAST words in a row that hold a retained suffix whose gram other texts share."""
    held, size = [], 0

    def give() -> pd.DataFrame:
        return pd.DataFrame({"h": np.concatenate([x[1] for x in held]), "c": np.concatenate([x[2] for x in held]), "id": np.repeat([x[0] for x in held], [len(x[1]) for x in held]), "place": np.concatenate([x[3] for x in held])})

    for row, words in _sequences(frames):
        n = len(words) - LEAST + 1
        if n < 1:
            continue
        places = np.asarray(row["places"], np.int64)
        places = places[places < len(words)]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, np.maximum(places - (LEAST - GRAM), 0), 1)
        np.add.at(step, places + 1, -1)
        at = np.flatnonzero(np.cumsum(step)[:n] > 0)
        h, c = _window_hashes(words)
        held.append((int(row["id"]), h[at], c[at], at.astype(np.int32)))
        size += len(at)
        if size >= 200_000:
            yield give()
            held, size = [], 0
    if held:
        yield give()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least LEAST words that other documents have too: id, first_word, last_word (exclusive), other_id."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id IS NOT NULL")
    rows = cut(slim.mapInPandas(_summaries, "id long, n int, s1 long, s2 long"))
    classes = rows.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.max("id").alias("top"))
    classes = cut(classes)
    grams = slim.mapInPandas(_grams, "gram long, id long, place int, s1 long")
    grams = cut(grams)
    # Written first, so that the join below has plain shuffles on both sides and its parts of a very common gram can be split as it runs.
    shared = cut(grams.groupBy("gram").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo != hi").select("gram"))
    release(docs.sparkSession)
    own = grams.join(shared, "gram", "left_semi").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    places = own.groupBy("id").agg(F.collect_set("place").alias("places"))
    windows = slim.join(places, "id").mapInPandas(_windows, "h long, c int, id long, place int")
    # Of what a window's documents are only the ends are gathered, by partial sums; so a passage of very many documents is no hot group.
    ends = windows.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi")
    held = windows.join(ends, ["h", "c"])
    repeated = held.select("id", "place", F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    # Merge windows of a document that overlap or touch.
    order = Window.partitionBy("id").orderBy("place")
    fresh = F.coalesce(F.col("place") > F.lag("place").over(order) + LEAST, F.lit(True)).cast("int")
    islands = repeated.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy("id", "island").agg(F.min("place").cast("long").alias("first_word"), (F.max("place") + LEAST).cast("long").alias("last_word"), F.min("other").alias("other_id"))
    several = classes.filter("size > 1")
    whole = rows.join(several, ["n", "s1", "s2"]).select("id", F.lit(0).cast("long").alias("first_word"), F.col("n").cast("long").alias("last_word"), F.when(F.col("id") == F.col("rep"), F.col("top")).otherwise(F.col("rep")).alias("other_id"))
    single = merged.join(several.select(F.col("rep").alias("id")), "id", "left_anti").select("id", "first_word", "last_word", "other_id")
    return single.union(whole)
