"""Word shingles as 64-bit hashes, made in numpy for batches of texts."""

from __future__ import annotations

import numpy as np

#: Characters hashed together; bounds the memory of a batch.
BATCH_CHARS = 1_000_000
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(256, dtype=np.uint64))
_PLACES = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def batches(texts: list[str], chars: int = BATCH_CHARS):
    """Runs of texts of about so many characters, as (first, last) positions."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str], fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words start (one more than texts)."""
    data = [text.encode() for text in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    if fold_case:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    gap = _SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    limits = np.cumsum([0] + [len(x) + 1 for x in data])
    starts = np.searchsorted(begins, limits)
    if not len(begins):
        return np.zeros(0, np.uint64), starts
    sizes = ends - begins
    inside = np.flatnonzero(~gap)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = _PLACES[place % 64]
    if len(place) and place.max() >= 64:  # very long words: weights go on beyond the table
        weight = np.where(place < 64, weight, mix(place.astype(np.uint64) + np.uint64(5000)) | np.uint64(1))
    sums = np.add.reduceat(_LETTERS[raw[inside]] * weight, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64)), starts


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words, the whole sequence is one."""
    hashes, starts = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short])) ^ np.uint64(0x5555555555555555))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
