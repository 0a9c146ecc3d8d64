"""Scores of hybrid retrieval and the evidence gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.numbers import score_norm

# Words of a source type that make its material a rule or a fact, and those of experience and pharmacopoeias.
RULE_WORDS = ("ich", "guideline", "rule", "regulation", "法规", "指导原则", "法律", "标准", "要求")
FACT_WORDS = ("submission", "source_doc", "section", "raw_text", "material", "申报", "原文", "章节")
EXPERIENCE_WORDS = ("history", "meta_reflection", "经验")
PHARMACOPOEIA_WORDS = ("药典", "pharmacopeia")


def _any(c: Column, words) -> Column:
    return c.rlike("|".join(words))


def lexical_blend(text: Column, summary: Column, keywords: Column) -> Column:
    return F.least(F.lit(1.0), 0.55 * text + 0.20 * summary + 0.25 * keywords)


def fuse(vector: Column, keyword: Column, lexical: Column, alpha: float = 0.7) -> Column:
    """alpha of the vector score, the rest of the better lexical one. A minimum score is accepted by callers and not applied."""
    return alpha * vector + (1 - alpha) * F.greatest(keyword, lexical)


def routes(vector: Column, keyword: Column) -> Column:
    """Which of the two searches found a hit."""
    return F.array_compact(F.array(F.when(vector, "vector"), F.when(keyword, "keyword")))


def role(source_type: Column) -> Column:
    """Experience, rule, fact or reference, tested in this order."""
    s = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    return F.when(_any(s, EXPERIENCE_WORDS), "experience").when(_any(s, PHARMACOPOEIA_WORDS) | _any(s, RULE_WORDS), "rule").when(_any(s, FACT_WORDS), "fact").otherwise("reference_info")


def evidence_score(score: Column, target: Column, intent: Column, of: Column) -> Column:
    """Normalised score with bonuses for target and intent matches and for rules and facts, at most 1, to 3 places (half up)."""
    bonus = F.least(target, F.lit(2)) * 0.12 + F.least(intent, F.lit(2)) * 0.08 + F.when(of.isin("rule", "fact"), 0.05).otherwise(0.0)
    return F.round(F.least(score_norm(score) + bonus, F.lit(1.0)), 3)


def gate(duplicate: Column, negative: Column, mismatch: Column, score: Column) -> Column:
    """Why a piece of evidence is rejected, tested in this order, or approved."""
    return F.when(duplicate, "duplicate").when(negative, "historical_negative").when(mismatch, "entity_mismatch").when(score < 0.5, "low_signal").otherwise("approved")
