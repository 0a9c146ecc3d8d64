"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

Method. Terms are learned from labelled documents: word beginnings that are far more frequent in toxic ones, each either
a whole word or a stem that words of many endings share. The trie of all terms is intersected with the Levenshtein
automaton of distance one (insertion, deletion, substitution, neighbouring letters swapped) and made deterministic as texts
take its transitions, so one table says for every word whether it is a term, starts with a stem, or misspells either. Whole batches of words walk the table
together in numpy; words of no interest leave it after a letter or two. Digits count as letters, and so do
marks between letters (id1ot, mo*on).

A context window around every match counts quotation marks on both sides; matches inside an open quotation that closes
are counted apart from the others. A logistic regression over the counts and their density gives the score. As labels
hold few misspellings, the fit also sees each toxic sample with its exact matches turned into misspelled ones.

Bounds. The fit uses at most about SAMPLE labelled documents, picked by a seeded hash, of which copies and near copies (equal smallest
shingle) count once; all terms significant in them are used. The table is begun anew beyond STATES states. Scoring reads every whole text.

Cases. A document labelled both ways counts as toxic. Null and empty texts score as a text without matches. Without labels of both kinds every score is the share of
toxic labels, or 0.5 without labels. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, ship
from quillspark.llm.shingles import batches, shingle_sets

SAMPLE = 20_000
#: States kept between batches of texts.
STATES = 100_000
#: Training documents that must hold a term, and the length from which a term can be misspelled.
LEAST_DOCS = 3
SHORTEST_MISSPELLED = 4
#: Lengths of word beginnings that can become terms.
SHORTEST, LONGEST = 3, 10
#: Characters to each side of a match in which quotation marks are counted.
WINDOW = 200

# Quotation marks, and marks that may stand for a letter inside a word.
_QUOTES = "\"“”„«»"
_MASKS = "*@$!#"
_WORD = re.compile(r"[^\W\d_]+")

#: Kinds of match, the lower the better: term, stem, long misspelled, short misspelled, stem misspelled.
EXACT, STEM, FUZZY, FUZZY_SHORT, FUZZY_STEM = range(1, 6)
KINDS = 5
LONG_TERM = 7
#: Half the log-likelihood ratio that a term needs is this more than the logarithm of how many are asked about: chance alone
#: reaches that in few of a hundred trainings.
SURE = 3.0


class Automaton:
    """The deterministic product of a trie of terms and the Levenshtein automaton of distance one, made where texts go.

    Whole terms and stems have a trie each. A state is a set of (node, errors, letter still to come after a swap); state 0 is
    empty, state 1 the start. Transitions are found when a word first takes them.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        """``terms``: (text, whole); a term that isn't whole is a stem."""
        letters = sorted({c for text, _ in terms for c in text})
        self.letters = ["", *letters]
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        self.other = len(letters) + 1
        self.width = self.other + 1
        #: Of each node: its children by symbol, its depth, whether a term ends there, whether it belongs to whole terms.
        self.children: list[dict[int, int]] = [{}, {}]
        self.depth, self.ends, self.whole = [0, 0], [False, False], [True, False]
        for text, whole in terms:
            node = 0 if whole else 1
            for c in text:
                step = self.children[node]
                if self.symbol[c] not in step:
                    step[self.symbol[c]] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.ends.append(False)
                    self.whole.append(whole)
                node = step[self.symbol[c]]
            self.ends[node] = True
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first two."""
        start = frozenset({(0, 0, 0), (1, 0, 0)})
        self.sets: list[frozenset] = [frozenset(), start]
        self.numbers = {s: i for i, s in enumerate(self.sets)}
        self.table = np.full(64 * self.width, -1, np.int32)
        self.table[: self.width] = 0
        self.accepts = np.zeros(64, np.int8)

    def _next(self, state: frozenset, s: int) -> frozenset:
        """The state after one more letter."""
        out: set[tuple[int, int, int]] = set()
        for node, errors, swap in state:
            if swap:
                if swap == s:
                    out.add((node, 1, 0))
                continue
            if self.ends[node] and not self.whole[node]:
                out.add((node, errors, 0))  # past a stem anything may follow
            step = self.children[node]
            if s in step:
                out.add((step[s], errors, 0))
            if errors:
                continue
            if node != 1:
                out.add((node, 1, 0))  # inserted
            for letter, child in step.items():
                out.add((child, 1, 0))  # substituted
                after = self.children[child].get(s)
                if after is not None:
                    out.add((after, 1, 0))  # one deleted before
                    out.add((after, 0, letter))  # or swapped with the next
        # Fewer errors at the same place make the others needless.
        return frozenset(x for x in out if not (x[1] == 1 and (x[0], 0, 0) in out))

    def _kind(self, state: frozenset) -> int:
        kinds = []
        for node, errors, swap in state:
            if swap:
                continue
            if self.ends[node] and not errors:
                kinds.append(EXACT if self.whole[node] else STEM)
            elif self.ends[node] and self.depth[node] >= SHORTEST_MISSPELLED:
                kinds.append((FUZZY if self.depth[node] >= LONG_TERM else FUZZY_SHORT) if self.whole[node] else FUZZY_STEM)
            if not errors and self.whole[node] and self.depth[node] + 1 >= SHORTEST_MISSPELLED and any(self.ends[c] for c in self.children[node].values()):
                kinds.append(FUZZY if self.depth[node] + 1 >= LONG_TERM else FUZZY_SHORT)  # the last letter is missing
        return min(kinds, default=0)

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one letter each; those not taken before are worked out."""
        at = states * self.width + symbols
        out = self.table[at]
        if (out < 0).any():
            for place in np.unique(at[out < 0]).tolist():
                found = self._next(self.sets[place // self.width], place % self.width)
                if found not in self.numbers:
                    n = self.numbers[found] = len(self.sets)
                    self.sets.append(found)
                    if n == len(self.accepts):
                        self.accepts = np.concatenate([self.accepts, np.zeros(n, np.int8)])
                        self.table = np.concatenate([self.table, np.full(n * self.width, -1, np.int32)])
                    self.accepts[n] = self._kind(found)
                self.table[place] = self.numbers[found]
            out = self.table[at]
        return out

    def prepare(self) -> None:
        """The table from code points to symbols; made on the worker, not sent."""
        table = np.zeros(65536, np.int32)
        for c in range(65536):
            if chr(c).isalnum():
                table[c] = self.other
        for c, s in self.symbol.items():
            if ord(c) < 65536:
                table[ord(c)] = s
        self.points = table
        self.quote = np.zeros(65536, bool)
        self.quote[[ord(c) for c in _QUOTES]] = True
        self.mask = np.zeros(65536, bool)
        self.mask[[ord(c) for c in _MASKS]] = True

    def matches(self, texts: list[str]) -> np.ndarray:
        """Per text: counts of each kind outside quotations, then inside, then the number of words."""
        if not hasattr(self, "points"):
            self.prepare()
        if len(self.sets) > STATES:
            self.forget()
        joined = "\n".join(texts).lower()
        sizes = np.array([len(x.lower()) + 1 for x in texts])
        firsts = np.cumsum(sizes) - sizes
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 65535)
        symbols = np.zeros(len(points) + 2, np.int32)
        symbols[1:-1] = self.points[points]
        inner = np.flatnonzero(self.mask[points])
        inner = inner[(symbols[inner] > 0) & (symbols[inner + 2] > 0)]
        symbols[inner + 1] = self.other
        begins = np.flatnonzero((symbols[1:] > 0) & (symbols[:-1] == 0))  # in points
        ends = np.flatnonzero((symbols[1:] == 0) & (symbols[:-1] > 0))
        states = np.ones(len(begins), np.int64)
        live = np.arange(len(begins))
        step = 0
        final = np.zeros(len(begins), np.int32)
        while len(live):
            states = self._step(states, symbols[begins[live] + 1 + step])
            step += 1
            alive = states > 0
            live, states = live[alive], states[alive]
            ended = ends[live] == begins[live] + step
            final[live[ended]] = states[ended]
            live, states = live[~ended], states[~ended]
        kinds = self.accepts[final]
        hit = np.flatnonzero(kinds)
        of = np.searchsorted(firsts, begins, "right") - 1
        out = np.zeros((len(texts), 2 * KINDS + 1))
        out[:, -1] = np.bincount(of, minlength=len(texts))
        if len(hit):
            quotes = np.concatenate([[0], np.cumsum(self.quote[points])])
            place, doc = begins[hit], of[hit]
            before = quotes[place] - quotes[np.maximum(firsts[doc], place - WINDOW)]
            after = quotes[np.minimum(firsts[doc] + sizes[doc] - 1, place + WINDOW)] - quotes[place]
            quoted = (before % 2 == 1) & (after > 0)
            np.add.at(out, (doc, kinds[hit] - 1 + KINDS * quoted), 1)
        return out


def features(counts: np.ndarray) -> np.ndarray:
    """Inputs of the regression from counts of matches: a constant, then for each kind its presence, count and density."""
    n, words = counts[:, :-1], counts[:, -1:]
    return np.hstack([np.ones((len(n), 1)), n > 0, np.minimum(n, 2) == 2, np.log1p(n), np.log1p(100 * n / np.maximum(words, 20))])


def fit(counts: np.ndarray, toxic: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Weights of the logistic regression, by Newton's method with a ridge."""
    misspelled = counts[(toxic == 1) & (counts[:, 0] > 0)].copy()
    misspelled[:, FUZZY - 1] += misspelled[:, 0]
    misspelled[:, 0] = 0
    x = features(np.vstack([counts, misspelled]))
    y = np.concatenate([toxic, np.ones(len(misspelled))])
    w = np.concatenate([np.ones(len(toxic)), np.full(len(misspelled), 0.3)])
    ridge = np.full(x.shape[1], strength)
    ridge[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn_terms(sample: DataFrame, text_col: str, toxic_col: str) -> list[tuple[str, bool]]:
    """Terms from labelled documents: beginnings of words by the likelihood ratio of their document counts."""
    rows = sample.select(F.col(toxic_col).cast("long").alias("t"), F.lower(F.col(text_col)).alias("text"))
    totals = rows.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = totals["n1"], totals["n"] - totals["n1"]
    if not n1 or not n0:
        return []

    def heads(only: frozenset | None, toxic: int):
        """Document counts of word beginnings in a task's texts, as whole words and as parts."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole, part = Counter(), Counter()
            for frame in frames:
                for text in frame["text"]:
                    words = set(_WORD.findall(text))
                    whole.update(w for w in words if SHORTEST <= len(w) <= LONGEST and (only is None or w in only))
                    cut = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
                    part.update(cut if only is None else cut & only)
            every = sorted(whole.keys() | part.keys())
            yield pd.DataFrame({"w": np.array(every, object), "whole": [whole[w] for w in every], "part": [part[w] for w in every]})

        own = rows.filter(F.col("t") == toxic).select("text").mapInPandas(run, "w string, whole long, part long")
        return own.groupBy("w").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))

    # Only toxic documents propose; the others, far more, are asked about what was proposed.
    toxic = heads(None, 1).select("w", F.greatest("whole", "part").alias("a"), "whole", "part").filter(F.col("a") >= LEAST_DOCS)
    proposed = toxic.toPandas()
    toxic = sample.sparkSession.createDataFrame(proposed, toxic.schema)
    clean = heads(frozenset(proposed["w"]), 0).select("w", F.greatest("whole", "part").alias("b"))
    found = toxic.join(clean, "w", "left").fillna(0, ["b"]).filter((F.col("a") + 0.5) / n1 > 4 * (F.col("b") + 0.5) / n0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n1 + n0)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0)
    sure = float(np.log(max(1, len(proposed))) + SURE)
    best = found.withColumn("g", g).filter(F.col("g") >= sure).orderBy(F.round("g", 6).desc(), F.length("w").desc(), "w").toPandas()
    out: list[tuple[str, bool]] = []
    heads_taken: set[str] = set()
    taken: set[str] = set()
    for w, whole, part in zip(best["w"], best["whole"], best["part"], strict=True):
        if w not in heads_taken and not any(w[:k] in taken for k in range(SHORTEST, len(w) + 1)):
            out.append((w, bool(whole >= part)))
            taken.add(w)
            heads_taken.update(w[:k] for k in range(SHORTEST, len(w) + 1))
    return out


class Scorer:
    """A fitted model: the automaton and the weights."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.automaton = Automaton(terms)
        self.beta = np.zeros(1)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.automaton.matches(texts[a:b]) for a, b in batches(texts)]
        counts = np.vstack(parts) if parts else np.zeros((0, 2 * KINDS + 1))
        return 1 / (1 + np.exp(-np.clip(features(counts) @ self.beta, -30, 30))), counts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Fit on labelled documents; ``labels`` (id_col, toxic_col) must hold the training rows only."""
    known = labels.filter(F.col(toxic_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(toxic_col).cast("int").alias("__t"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(known), F.col(id_col) == F.col("__id"))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["__text"].tolist()
            for a, b in batches(texts):
                signs = [int(x[0].astype(np.int64)) if len(x) else 0 for x in shingle_sets(texts[a:b])]
                yield pd.DataFrame({"__t": frame["__t"].iloc[a:b], "sign": signs, "__text": texts[a:b]})

    signed = rows.select("__t", "__text").mapInPandas(sign, "__t int, sign long, __text string")
    rows = cut(signed.groupBy("__t", "sign").agg(F.min("__text").alias("__text")))
    scorer = Scorer(learn_terms(rows, "__text", "__t"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, n = scorer.score(frame["__text"].tolist())
            yield pd.DataFrame({"t": frame["__t"].to_numpy(), "n": list(n)})

    scorer.beta = np.zeros(features(np.zeros((1, 2 * KINDS + 1))).shape[1])
    seen = rows.select("__t", "__text").mapInPandas(count, "t int, n array<double>").toPandas()
    if seen["t"].nunique() == 2:
        scorer.beta = fit(np.stack(seen["n"]), seen["t"].to_numpy(float))
    elif len(seen):
        scorer.beta[0] = 30.0 if seen["t"][0] else -30.0
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, and the matches behind it: n_exact, n_stem, n_misspelled, n_quoted."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s, n = scorer.score(frame["text"].tolist())
            n = n.astype(int)
            yield pd.DataFrame({"id": frame["id"], "score": s, "n_exact": n[:, 0], "n_stem": n[:, 1], "n_misspelled": n[:, 2:5].sum(1), "n_quoted": n[:, 5:10].sum(1)})

    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, score double, n_exact long, n_stem long, n_misspelled long, n_quoted long")


def fold(id_col: Column) -> Column:
    """The fold, 0 to 4, of a document: CRC-32 of its id as text; fold 0 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def run(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels outside fold 0 and score every document."""
    ship(docs.sparkSession)
    scorer = train(docs, labels.filter(fold(F.col(id_col)) != 0), id_col, text_col)
    return score(docs, scorer, id_col, text_col)
