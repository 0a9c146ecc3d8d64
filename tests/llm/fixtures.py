"""Small tables with every awkward case: nulls, empty and long texts, copies, near copies, clashing columns."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ta", "re", "mo", "li", "su", "ne", "po", "ka") for b in ("n", "ster", "ld", "mi", "rt", "vo", "x", "que")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, id, n, key, h): the last four clash with names that operators use inside."""
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 60)
    words = base.split()
    near = [" ".join(w if i % 29 != k else "changed" for i, w in enumerate(words)) for k in (3, 11)]
    texts = [base, *near, base.replace(" ", "  ", 5), base.replace(" ", "\t", 1), None, "", " ", "\n\t", "one", "one", "One", "two words", "a b c d e", "a b c d e f"]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 40)}" for _ in range(3)]
    texts += [prose(rng, n) for n in (1, 4, 5, 49, 50, 51, 120)]
    texts += [prose(rng, 20_000), "é 日本語 ▁x 🎉  y" * 3, "x" * 5000]
    texts += [base] * 12
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, ["en", "de", None][i % 3], ["a", "b", "é", None][i % 4], "clash", i, None, 0))
    rows.append((rows[9][0], "one", "en", "a", "clash", 1, None, 0))  # a repeated row
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, id string, n int, key string, h int"
