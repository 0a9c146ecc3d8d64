"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Method. Four patterns find e-mail addresses, IP addresses, card and phone numbers with their checks; these base spans
always stay. A conditional random field reads the words of each line as features of their shape (collapsed character
classes, digit counts, first and last marks, cue words and the shapes beside them) and adds spans that the patterns
miss, such as numbers written without their plus sign or addresses with a spelled-out at. It is trained by gradient ascent on the
log-likelihood of a small labelled table, and decodes by Viterbi in numpy, all sequences of a batch together.

Words without digit or @ whose neighbours have none either are always labelled O: training ends with a check that no
transition outweighs their emission, so a line decomposes into the stretches around other words, and only those are
decoded, exactly as the whole line would be. If the check fails, whole lines are decoded.

Bounds. Emissions are made and decoded for at most CELLS words at once: short stretches together, a longer one in pieces that carry the
best score of each label on, keeping a byte a label and word for the way back. The shape of a word is that of its first 24 runs.

Cases. Null text counts as empty: no spans. Offsets are code points of the whole text; lines and texts of any length are
read whole. Added spans never overlap base ones. Repeated rows give the same spans; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ship
from quillspark.llm.shingles import batches

#: Words whose emissions are held at once.
CELLS = 50_000

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TOKEN = re.compile(r"\S+")
_HOT = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
_ASCII_DIGITS = re.compile(r"[0-9]")

# Words that announce a kind.
CUES = {
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "card": "card", "visa": "card", "credit": "card", "account": "card",
    "email": "email", "mail": "email", "contact": "email",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
}


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ in both directions (linear in the text)."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        back = _LOCAL_BACK.match(text[free:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1)
        if back and domain:
            out.append((at - back, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and then start; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 10 else not x.lstrip("0")[3:] and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_ASCII_DIGITS.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_ASCII_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@lru_cache(10_000)
def _shape(word: str) -> str:
    """Character classes with runs collapsed; runs of digits keep their length up to five."""
    out, i = [], 0
    while i < len(word) and len(out) < 24:
        c = word[i]
        kind = "0" if c in "0123456789" else "a" if c.isalpha() else c if c in "@.-()+_/[]:" else "?"
        j = i
        while j < len(word) and ("0" if word[j] in "0123456789" else "a" if word[j].isalpha() else word[j] if word[j] in "@.-()+_/[]:" else "?") == kind:
            j += 1
        out.append(f"0{min(j - i, 5)}" if kind == "0" else kind)
        i = j
    return "".join(out)


def _digits(word: str) -> str:
    n = len(_ASCII_DIGITS.findall(word))
    for edge in (0, 3, 4, 6, 9, 10, 15, 19):
        if n <= edge:
            return f"<={edge}"
    return ">19"


def _cue(word: str) -> str:
    return CUES.get(word.strip(":,.;()[]").lower(), "")


class _Words(Sequence):
    """The words of a line by their places, cut out when asked for."""

    def __init__(self, line: str):
        places = array("q")
        for m in _TOKEN.finditer(line):
            places.extend(m.span())
        self.line, self.places = line, places

    def __len__(self) -> int:
        return len(self.places) // 2

    def __getitem__(self, i: int) -> str:
        return self.line[self.places[2 * i] : self.places[2 * i + 1]]


def word_features(words: Sequence[str], i: int) -> list[str]:
    """Features of one word, from its own shape and that of its neighbours."""
    w = words[i]
    shape = _shape(w)
    out = [f"s={shape}", f"d={_digits(w)}", f"f={shape[:1]}", f"l={shape[-1:]}", f"at={'@' in w}", f"dots={min(w.count('.'), 4)}"]
    for k in (-2, -1, 1, 2):
        near = words[i + k] if 0 <= i + k < len(words) else None
        out.append(f"{k}d={_digits(near) if near is not None else 'edge'}")
        if k in (-1, 1):
            out.append(f"{k}s={_shape(near) if near is not None and _HOT.search(near) else 'plain'}")
        if k < 0 and near is not None and _cue(near):
            out.append(f"cue={_cue(near)}")
    return out


def _luhn_number(rng: random.Random, n: int = 16) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def example_table(rows: int = 300, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table made by rule: texts with spans (kind, start, end) written in many ways."""
    rng = random.Random(seed)
    plain = lambda: "".join(rng.choice(["the", "on", "re", "ver", "la", "chen", "tion", "ou", "es", "de", "ment", "and"]) for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def item(kind: str) -> str:
        if kind == "email":
            user, host = plain() + rng.choice(["", num(2), "." + plain()]), f"{plain()}{rng.choice(['', num(1)])}.{plain()}"
            return rng.choice([f"{user}@{host}", f"{user}[at]{host}", f"{user}(at){host}", f"{user} @ {host}", f"{user}@{host}.com"])
        if kind == "ip":
            parts = [str(rng.randint(0, 255)) for _ in range(4)]
            return rng.choice([".".join(parts), ".".join(parts) + ":" + num(4), "[.]".join(parts)])
        if kind == "card":
            n = _luhn_number(rng)
            groups = [n[i : i + 4] for i in range(0, 16, 4)]
            return rng.choice([n, " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups)])
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b} {c}"])

    def distractor() -> str:
        return rng.choice([num(1), num(2), num(4), f"{num(1)}.{num(2)}", f"{num(2)}%", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"${num(3)}", f"{plain()}{num(2)}", f"({num(4)})", f"{num(2)}:{num(2)}", f"#{num(5)}", num(6), f"{num(8)}{'abcdef'}{num(6)}", f"sk_{num(12)}", num(9), num(24)])

    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(2, 6)):
            text += " ".join(plain() for _ in range(rng.randint(1, 5))) + " "
            if rng.random() < 0.45:
                kind = rng.choice(KINDS)
                if rng.random() < 0.3:
                    text += rng.choice([w for w, k in CUES.items() if k == kind]) + rng.choice([" ", ": "])
                value = item(kind)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + rng.choice([" ", " ", ", ", ". ", "%%% ", "### "])
            else:
                text += distractor() + rng.choice([" ", ", ", ". "])
        out.append((text, spans))
    return out


def _way_back(back: np.ndarray, last: int) -> np.ndarray:
    """The best labels from what came before each, and the last one."""
    path = np.zeros(len(back), int)
    path[-1] = last
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


class Field:
    """A linear-chain conditional random field: emission weights by feature, transitions, start weights."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.emit = np.zeros((1, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.decomposes = False

    def _ids(self, features: list[str]) -> list[int]:
        return [i for f in features if (i := self.index.get(f)) is not None]

    def scores(self, words: Sequence[str], at: range | None = None) -> np.ndarray:
        return np.array([self.emit[self._ids(word_features(words, i))].sum(0) for i in (at or range(len(words)))]).reshape(-1, len(LABELS))

    def train(self, table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 80, ridge: float = 0.02) -> Field:
        """Gradient ascent (with momentum and scaled steps) on the log-likelihood of the table."""
        sequences = []
        for text, spans in table:
            tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
            words = [text[a:b] for a, b in tokens]
            gold = np.zeros(len(tokens), int)
            for kind, a, b in spans:
                inside = [i for i, (x, y) in enumerate(tokens) if x < b and y > a]
                for nth, i in enumerate(inside):
                    gold[i] = LABELS.index(("B-" if nth == 0 else "I-") + kind)
            sequences.append(([word_features(words, i) for i in range(len(words))], gold))
        for features, _ in sequences:
            for word in features:
                for f in word:
                    self.index.setdefault(f, len(self.index))
        n, size, longest = len(sequences), len(LABELS), max(len(g) for _, g in sequences)
        rows, cols, lengths = [], [], np.array([len(g) for _, g in sequences])
        gold = np.zeros((n, longest), int)
        for s, (features, g) in enumerate(sequences):
            gold[s, : len(g)] = g
            for i, word in enumerate(features):
                cols += self._ids(word)
                rows += [s * longest + i] * len(word)
        rows, cols = np.array(rows), np.array(cols)
        live = np.arange(longest)[None] < lengths[:, None]
        self.emit = np.zeros((len(self.index), size))
        # What the table itself holds, against which expectations are measured.
        truth = np.zeros((n * longest, size))
        truth[np.arange(n * longest), gold.ravel()] = live.ravel()
        pairs = np.zeros((size, size))
        both = live[:, 1:]
        np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        mean = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        square = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            e = np.zeros((n * longest, size))
            np.add.at(e, rows, self.emit[cols])
            e = e.reshape(n, longest, size)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, longest):
                step_in = alpha[:, t - 1, :, None] + self.move[None]
                top = step_in.max(1)
                nxt = top + np.log(np.exp(step_in - top[:, None]).sum(1)) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
            top = alpha[:, -1].max(1)
            z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
            expect = np.zeros((size, size))
            for t in range(longest - 2, -1, -1):
                ahead = self.move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None]
                joint = np.exp(np.minimum(alpha[:, t, :, None] + ahead - z[:, None, None], 0)) * live[:, t + 1, None, None]
                expect += joint.sum(0)
                top = ahead.max(2)
                beta[:, t] = np.where(live[:, t + 1, None], top + np.log(np.exp(ahead - top[..., None]).sum(2)), 0)
            post = (np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[..., None]).reshape(-1, size)
            grad = np.zeros_like(self.emit)
            np.add.at(grad, cols, (truth - post)[rows])
            grads = [grad - ridge * n * self.emit / 50, pairs - expect - ridge * n * self.move / 50]
            for k, (w, g) in enumerate(zip((self.emit, self.move), grads, strict=True)):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w += 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        lone = self.scores(["on", "on", "on", "on", "on"], range(2, 3))[0]
        stay = lone[0] + self.move[:, 0].min() + self.move[0].min()
        leave = max(lone[y] + self.move[:, y].max() + self.move[y].max() for y in range(1, size))
        self.decomposes = bool(stay > leave)
        return self

    def viterbi(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of many sequences, stepped together; the longest ones last."""
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        lengths = np.array([len(emissions[i]) for i in order])
        if not len(lengths):
            return []
        every = np.zeros((len(order), lengths[0], len(LABELS)))
        for row, i in enumerate(order):
            every[row, : lengths[row]] = emissions[i]
        back = np.zeros(every.shape, np.int8)
        best = every[:, 0].copy()
        for t in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -t, "left"))
            options = best[:live, :, None] + self.move[None]
            back[:live, t] = options.argmax(1)
            best[:live] = options.max(1) + every[:live, t]
        out: list[np.ndarray] = [np.zeros(0, int)] * len(order)
        for row, i in enumerate(order):
            out[i] = _way_back(back[row, : lengths[row]], int(best[row].argmax()))
        return out

    def _decode_long(self, words: Sequence[str], at: range) -> np.ndarray:
        """Best labels of one stretch of any length, its emissions made piece by piece."""
        back = np.zeros((len(at), len(LABELS)), np.int8)
        best = None
        for start in range(0, len(at), CELLS):
            for t, e in enumerate(self.scores(words, at[start : start + CELLS]), start):
                if best is None:
                    best = e
                else:
                    options = best[:, None] + self.move
                    back[t] = options.argmax(0)
                    best = options.max(0) + e
        return _way_back(back, int(best.argmax()))

    def decode(self, jobs: list[tuple[Sequence[str], range]]) -> list[np.ndarray]:
        """Best labels of stretches of lines, padded together by length while they fit in CELLS words."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(jobs)
        order = sorted(range(len(jobs)), key=lambda i: len(jobs[i][1]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(jobs[order[end]][1]) <= CELLS:
                end += 1
            some = order[start:end]
            if len(jobs[some[-1]][1]) > CELLS:
                paths = [self._decode_long(*jobs[i]) for i in some]
            else:
                paths = self.viterbi([self.scores(*jobs[i]) for i in some])
            for i, path in zip(some, paths, strict=True):
                out[i] = path
            start = end
        return out

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field labels in each text, with marks around them trimmed."""
        jobs, places = [], []
        for nth, text in enumerate(texts):
            if not _HOT.search(text):
                continue
            start = 0
            for line in text.split("\n"):
                if _HOT.search(line):
                    words = _Words(line)
                    hot = np.fromiter((bool(_HOT.search(w)) for w in words), bool, len(words))
                    cue = np.fromiter((bool(_cue(w)) for w in words), bool, len(words))
                    near = hot.copy() if self.decomposes else np.ones(len(words), bool)
                    for k in (1, 2):
                        near[k:] |= hot[:-k]
                        near[:-k] |= hot[k:]
                        near[k:] |= cue[:-k]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if hot[a:b].any():
                            jobs.append((words, range(a, b)))
                            places.append((nth, start, a, text))
                start += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for (nth, start, first, text), (words, _), path in zip(places, jobs, self.decode(jobs), strict=True):
            tokens = words.places
            i = 0
            while i < len(path):
                if path[i] == 0:
                    i += 1
                    continue
                kind, j = LABELS[path[i]][2:], i + 1
                while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                    j += 1
                a, b = start + tokens[2 * (first + i)], start + tokens[2 * (first + j - 1) + 1]
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                while a < b and not (text[a].isalnum() or text[a] in "(+"):
                    a += 1
                if plausible(kind, text[a:b]):
                    out[nth].append((kind, a, b))
                i = j
        return out


def plausible(kind: str, value: str) -> bool:
    """What an added span must hold, whatever its spelling."""
    digits = len(_ASCII_DIGITS.findall(value))
    if kind == "email":
        return bool(re.search(r"@|[(\[{]at[)\]}]", value, re.I)) and "." in value
    if kind == "ip":
        return 4 <= digits <= 16 and len(re.findall("[0-9]+", value)) >= 4
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(_ASCII_DIGITS.findall(value)))
    return 8 <= digits <= 15 and not re.search("[A-Za-z]", value)


def merge(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added ones that overlap none, by kind as listed and then start."""
    if added:
        taken = sorted((a, b) for _, a, b in base)
        starts, ends = np.array([a for a, _ in taken], int), np.maximum.accumulate(np.array([b for _, b in taken], int)) if taken else np.zeros(0, int)
        for kind, a, b in added:
            before = int(np.searchsorted(starts, b)) - 1
            if before < 0 or ends[before] <= a:
                base = [*base, (kind, a, b)]
    return sorted(base, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, digest of the base spans, all spans as text (kind:start:end), the number added and of all."""
    ship(docs.sparkSession)
    field = field or Field().train(example_table())
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, end in batches(frame["text"].tolist()):
                part = frame.iloc[start:end]
                texts = part["text"].tolist()
                base = [base_spans(t) for t in texts]
                every = [merge(b, a) for b, a in zip(base, field.find(texts), strict=True)]
                counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
                sha = [hashlib.sha256(_show(sorted(b, key=lambda s: (KINDS.index(s[0]), s[1]))).encode()).hexdigest() for b in base]
                yield pd.DataFrame({"id": part["id"].to_numpy(), **counts, "base_sha256": sha, "spans": [_show(e) for e in every], "n_added": [len(e) - len(b) for e, b in zip(every, base, strict=True)], "n_spans": [len(e) for e in every]})

    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
