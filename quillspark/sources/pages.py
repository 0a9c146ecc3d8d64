"""Fields of raw web pages by pattern, without a parser in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r"<a href=\"([^\"]*)\""), F.lit(1))


def list_rows(html: Column) -> Column:
    """Texts of list items, tags removed."""
    items = F.regexp_extract_all(html, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    return F.transform(items, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def last_token(url: Column) -> Column:
    """The last path token of an address, without its query."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/?$", 1)
