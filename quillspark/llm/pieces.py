"""Offset-preserving SentencePiece encoding and decoding.

Method. The text is normalised by walking the model's compiled character map, a double-array trie: at each place the
longest key that is a prefix of the rest is replaced by its value, else one character is copied, and for every
normalised byte the source byte is recorded. White space is then escaped, and a dummy prefix added, as the model asks.
Merges never join a piece across the start of a space run unless the vocabulary has such a piece, which is looked up
when the model is loaded; so the normalised text is cut into words that are encoded once and remembered (in a cache of
bounded size). A piece's normalised bytes are projected through the alignment to a span of original bytes.

The merges and byte fallback themselves are the sentencepiece library's, called on already normalised words with its
own normaliser switched off; tests hold ids, text and spans against the library on whole texts.

Cases. Null text counts as empty: no ids, no spans, empty decoded text. Texts are never cut; a long text is processed
as one row. Repeated rows are encoded again. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ship

_SPACE = "▁"
#: Words remembered by a worker; beyond this the memory is emptied and filled anew.
CACHE_WORDS = 200_000
#: Texts encoded together.
BATCH = 200


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int, bytes]]:
    """Fields of a protocol-buffer message: number, wire type, value, and the whole field as it stands."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        start = at
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value: bytes | int = varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value = data[at : at + size]
            at += size
        yield number, kind, value, data[start:at]


def _message(number: int, body: bytes) -> bytes:
    size, out = len(body), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    out.append(size)
    return bytes(out) + body


class CharacterMap:
    """The compiled map: a double-array trie of keys and a block of zero-terminated values."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :] if blob else b""
        #: Bytes that start a key; text without them is copied as it is.
        self.starts = np.zeros(256, bool)
        for b in range(256) if self.units else ():
            self.starts[b] = self._step(self._root(), b) is not None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        return at if unit & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and value of the longest key that starts at ``at``."""
        node, found = self._root(), None
        for end in range(at, len(data)):
            hit = self._step(node, data[end])
            if hit is None:
                break
            unit = self.units[hit]
            node = hit ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (end + 1 - at, self.values[value : self.values.index(b"\0", value)])
        return found


class Model:
    """A SentencePiece model split into its normaliser and its segmenter."""

    def __init__(self, path: str):
        import sentencepiece

        data = open(path, "rb").read()
        pieces: list[tuple[str, int]] = []
        rest, charsmap, flags = [], b"", {3: 1, 4: 1, 5: 1}
        self.suffix = False
        for number, _, value, whole in _fields(data):
            if number == 1:
                kept = {n: v for n, _, v, _ in _fields(value)}
                pieces.append((kept.get(1, b"").decode(), kept.get(3, 1)))
            if number == 2:
                self.suffix = any(n == 24 and v for n, _, v, _ in _fields(value))
            if number == 3:
                for n, _, v, _ in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n in flags:
                        flags[n] = v
            else:
                rest.append(whole)
        self.prefix, self.strip, self.escape = (bool(flags[n]) for n in (3, 4, 5))
        self.map = CharacterMap(charsmap)
        off = _message(3, bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + off)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        #: Normalised bytes of each piece; 1 for byte pieces; unknown ones (0) are measured from the text.
        self.sizes = np.array([1 if kind == 6 else 0 if kind == 2 else len(text.encode()) for text, kind in pieces], np.int64)
        self.by_word = not self.suffix and not any(re.search(f"[^{_SPACE}]{_SPACE}", text) for text, kind in pieces if kind in (1, 4))
        self.words: dict[str, tuple[str, bytes]] = {}
        #: What each piece decodes to, in one block of bytes.
        shown = [bytes([int(text[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else text.replace(_SPACE, " ").encode() for text, kind in pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_sizes) - self.shown_sizes

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the original byte it comes from."""
        data = text.encode()
        source = np.frombuffer(data, np.uint8)
        if self.map.units and self.map.starts[source].any():
            out, align = bytearray(), []
            at = 0
            while at < len(data):
                hit = self.map.longest(data, at) if self.map.starts[data[at]] else None
                size = hit[0] if hit else max(1, 4 - max(0, 4 - (1 + (data[at] >= 192) + (data[at] >= 224) + (data[at] >= 240))))
                value = hit[1] if hit else data[at : at + size]
                out += value
                align += [at] * len(value) if hit else range(at, at + size)
                at += size
            norm, where = np.frombuffer(bytes(out), np.uint8), np.array([*align, len(data)], np.int64)
        else:
            norm, where = source, np.arange(len(data) + 1, dtype=np.int64)
        space = norm == 32
        if self.strip and len(norm):
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            last = np.flatnonzero(~space)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            end = where[last[-1] + 1] if len(last) else 0
            norm, where = norm[keep], np.append(where[:-1][keep], end)
            space = norm == 32
        if self.prefix and len(norm):
            norm, where = np.append(np.uint8(32), norm), np.append(where[:1], where)
            space = norm == 32
        plain = norm.tobytes().decode()
        if not self.escape:
            return plain, where
        return plain.replace(" ", _SPACE), np.append(np.repeat(where[:-1], 1 + 2 * space.astype(np.int64)), where[-1])

    def _learn(self, words: set[str]) -> None:
        """Encode words (without the space mark that each begins with): ids joined by commas, and as int32."""
        fresh = list(words)
        for word, ids in zip(fresh, self.raw.encode([_SPACE + w for w in fresh], num_threads=1), strict=True):
            self.words[word] = (",".join(map(str, ids)), struct.pack(f"{len(ids)}i", *ids))

    def _cut(self, norm: str) -> list[str]:
        """The words of a normalised text that starts with a space mark, each without its first mark."""
        if _SPACE * 2 in norm or norm[-1] == _SPACE:
            return [w[1:] for w in re.findall(f"{_SPACE}+[^{_SPACE}]*", norm)]
        return norm.split(_SPACE)[1:]

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: its ids joined by commas, its ids, and the first and last original byte of each piece."""
        normal = [self.normalise(text) for text in texts]
        if self.by_word and all(norm[:1] in ("", _SPACE) for norm, _ in normal):
            cuts = [self._cut(norm) if norm else [] for norm, _ in normal]
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            if fresh := set().union(*cuts) - self.words.keys():
                self._learn(fresh)
            known = [[self.words[w] for w in words] for words in cuts]
        else:
            known = [[(",".join(map(str, ids)), struct.pack(f"{len(ids)}i", *ids))] if ids else [] for ids in self.raw.encode([norm for norm, _ in normal], num_threads=1)]
        out = []
        for (norm, where), words in zip(normal, known, strict=True):
            ids = np.frombuffer(b"".join([w[1] for w in words]), np.int32)
            sizes = self.sizes[ids]
            if len(ids) and not sizes.all():  # unknown pieces: ask the library for their surfaces
                sizes = np.array([p.end - p.begin for p in self.raw.encode(norm, return_type="proto").pieces], np.int64)
            ends = np.cumsum(sizes)
            out.append((",".join([w[0] for w in words]), ids, where[ends - sizes], where[ends]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes put together, space marks as spaces, without the dummy prefix."""
        sizes = self.shown_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.shown_at[ids] - (ends - sizes), sizes)
        text = self.shown[at].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def load(path: str) -> Model:
    """The model of a path that every executor has; loaded once by each worker."""
    return Model(path)


#: Columns of each form of result.
FORMS = {
    "spans": "ids array<int>, begins array<int>, ends array<int>, decoded string",
    "ids": "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string",
    "digest": "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, aligned boolean",
}


def _rows(frames: Iterator[pd.DataFrame], path: str, form: str) -> Iterator[pd.DataFrame]:
    model = load(path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    names = ["id", *(x.split()[0] for x in FORMS[form].split(", "))]
    for frame in frames:
        for start in range(0, len(frame), BATCH):
            part = frame.iloc[start : start + BATCH]
            out: list[tuple] = []
            texts = part["text"].tolist()
            for key, text, (joined, ids, begins, ends) in zip(part["id"], texts, model.encode(texts), strict=True):
                decoded = model.decode(ids)
                if form == "spans":
                    out.append((key, ids, begins.astype(np.int32), ends.astype(np.int32), decoded))
                elif form == "ids":
                    out.append((key, len(ids), ids, sha(joined), sha(decoded)))
                else:
                    size = len(text.encode())
                    aligned = len(ids) == 0 or bool(begins[0] == 0 and ends[-1] == size and (begins[1:] <= ends[:-1]).all())
                    out.append((key, len(ids), sha(joined), sha(decoded), size, aligned))
            yield pd.DataFrame(out, columns=names)


def _apply(docs: DataFrame, model_path: str, id_col: str, text_col: str, form: str) -> DataFrame:
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInPandas(lambda frames: _rows(frames, model_path, form), f"id {slim.schema['id'].dataType.simpleString()}, {FORMS[form]}")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, begins, ends (original UTF-8 bytes of each piece) and decoded text of every document."""
    return _apply(docs, model_path, id_col, text_col, "spans")


def encode_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids, ids_sha256 and decoded_sha256 of every document."""
    return _apply(docs, model_path, id_col, text_col, "ids")


def encode_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding as digests: n_tokens, ids_sha256, decoded_sha256, n_bytes, aligned (the spans cover all bytes in order)."""
    return _apply(docs, model_path, id_col, text_col, "digest")
