"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never keywords, case ignored.
KEYWORD_STOPS = (
    "should", "shall", "with", "from", "that", "this", "into", "using", "used",
    "content", "document", "section", "chapter", "method", "result", "standard",
)
# Token patterns of keywords, of query terms (two variants) and of intent terms.
KEYWORD_PATTERN = r"[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_/-]{2,}"
TERM_PATTERN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"
STORE_TERM_PATTERN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]{2,}"
INTENT_PATTERN = r"[A-Za-z][A-Za-z0-9\-]{1,24}|[\x{4e00}-\x{9fff}]{2,12}"
# Marks removed before two texts are matched, and marks that end a query token.
MATCH_MARKS = r"[\s\x{3000}；;，,。、“”\"'（）()【】\[\]：:、\\/_-]+"
TOKEN_MARKS = r"[\s,，。；;:：/|()（）\[\]【】]+"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def norm_ws(c: Column) -> Column:
    """Full-width spaces and line ends unified, runs of blanks as one, at most one empty line in a row."""
    out = F.replace(F.replace(text(c), F.lit("　"), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    """Pieces ended by a sentence mark and white space or by empty lines, without blank ones."""
    pieces = F.split(text(c), r"(?<=[。！？；.!?;])\s+|\n{2,}")
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def truncate(c: Column, n: int, mark: str = "...(truncated)") -> Column:
    value = text(c)
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit(mark))).otherwise(value)


def summary(c: Column, limit: int = 120) -> Column:
    """One line; cut to the limit with an ellipsis."""
    line = one_line(c)
    cut = F.regexp_replace(F.substring(line, 1, limit - 3), r"(?U)\s+$", "")
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(cut, F.lit("...")))


def doc_summary(title: Column, c: Column, most: int = 4) -> Column:
    """Title and the first sentences, as a summary of 400 characters."""
    body = F.array_join(F.slice(F.filter(F.transform(sentences(c), one_line), lambda x: x != ""), 1, most), " ")
    return summary(strip(F.concat_ws(" ", strip(title), body)), 400)


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def query_terms(c: Column, pattern: str = TERM_PATTERN) -> Column:
    return all_matches(F.lower(text(c)), pattern)


def query_tokens(c: Column, most: int = 8) -> Column:
    """Tokens of two characters or more between punctuation, first occurrences, at most ``most``."""
    parts = F.split(strip(c), TOKEN_MARKS)
    return F.slice(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2)), 1, most)


def match_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), MATCH_MARKS, "")


def char_overlap(question: Column, candidate: Column) -> Column:
    """1 or 0.85 when one normalised text holds the other, else the share of the question's distinct characters found."""
    q, c = match_norm(question), match_norm(candidate)
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda y: y != ""))
    share = F.size(F.array_intersect(letters(q), letters(c))) / F.size(letters(q))
    holds = F.when(c.contains(q) | q.contains(c), F.when(F.least(F.length(q), F.length(c)) >= 6, 1.0).otherwise(0.85)).otherwise(0.0)
    return F.when((q == "") | (c == ""), 0.0).otherwise(F.greatest(holds, share))


def safe_name(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text(c), r"[^0-9A-Za-z._-]+", "_"), 1, most)


def order_suffix(c: Column) -> Column:
    """The integer at the end of an id, else a billion."""
    return F.coalesce(F.regexp_extract(text(c), r"(\d+)$", 1).try_cast("long"), F.lit(1_000_000_000))


def excerpt(c: Column, keywords: list[str], around: int) -> Column:
    """The text around the first of the keywords, in the order given, that occurs; else empty."""
    value = text(c)
    low = F.lower(value)
    out = F.lit("")
    for k in reversed(keywords):
        at = F.instr(low, k.lower())
        start = F.greatest(at - 1 - around, F.lit(0))
        piece = value.substr(start + 1, at - 1 + len(k) + around - start)
        out = F.when(at > 0, strip(piece)).otherwise(out)
    return out


def slices(c: Column, width: int) -> Column:
    """Pieces of fixed width, stripped, without blank ones."""
    value = strip(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)), F.lit(width))
    return F.filter(F.transform(starts, lambda s: strip(F.substring(value, s, F.lit(width)))), lambda x: x != "")


def distinct_lines(c: Column) -> Column:
    """Lines as one-line texts, without blank and repeated ones, in first order."""
    return F.array_distinct(F.filter(F.transform(F.split(text(c), r"\r?\n"), one_line), lambda x: x != ""))


def fragments(c: Column) -> Column:
    """Parts between semicolons and line ends, of two characters or more, first occurrences."""
    parts = F.transform(F.split(text(c), r"[；;\n]+"), lambda x: F.regexp_replace(one_line(x), r"^[\s，,。.、:：\-]+|[\s，,。.、:：\-]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def contained_share(terms: list[str], c: Column) -> Column:
    """Share of the terms that the lower-cased text holds; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(text(c))
    return reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms]) / len(terms)


def text_quality(c: Column) -> Column:
    """Counts of visible, abnormal and alphanumeric characters once dot leaders are dropped, and whether usable."""
    shown = F.regexp_replace(F.regexp_replace(text(c), r"[.．·…]{3,}", ""), r"(?U)\s", "")
    n = F.length(shown)
    bad = F.regexp_count(shown, F.lit(r"[\x{fffd}\p{Cc}\p{Co}]"))
    good = F.regexp_count(shown, F.lit(r"[\p{L}\p{N}]"))
    usable = (n > 0) & (bad / n < 0.03) & (good / n >= 0.35)
    return F.struct(n.alias("characters"), bad.alias("abnormal"), good.alias("effective"), F.coalesce(usable, F.lit(False)).alias("usable"))


def is_english(items: Column) -> Column:
    """Whether more than four in five texts start with an ASCII letter or mark."""
    hits = F.size(F.filter(items, lambda x: strip(x).rlike(r"^[ `a-zA-Z.,':;/\"?<>!\(\)-]")))
    return F.when(F.size(items) > 0, hits / F.size(items) > 0.8).otherwise(False)


def highlight(c: Column, words: list[str]) -> Column:
    """Sentences that hold one of the words, with the words marked."""
    pattern = "(?i)(" + "|".join(words) + ")"
    hit = F.filter(sentences(c), lambda x: x.rlike(pattern))
    return F.array_join(F.transform(hit, lambda x: F.regexp_replace(x, pattern, "<em>$1</em>")), "...")
