"""Folding of relations, sequence elements, splits, knowledge-graph names and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s 　]+|[\s 　]+$"


def trimmed(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, _EDGE, ""))


def relation(c: Column | str) -> Column:
    """Trim, lower-case, drop a leading ``ns:``; null stays null."""
    return F.regexp_replace(trimmed(c), r"^ns:", "")


def element(c: Column | str) -> Column:
    """``relation::direction`` with both parts folded; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(relation(F.regexp_replace(c, r"(?s)::((?!::).)*$", "")), F.lit("::"), trimmed(F.when(F.contains(c, F.lit("::")), F.substring_index(c, "::", -1)).when(c.isNotNull(), "")))


def hop_element(h: Column) -> Column:
    return F.concat(relation(h["relation"]), F.lit("::"), trimmed(h["direction"]))


def side(c: Column | str) -> Column:
    """train, dev or test, whichever the folded split begins with; else null."""
    t = trimmed(c)
    return F.when(t.startswith("train"), "train").when(t.startswith("dev"), "dev").when(t.startswith("test"), "test")


def source(c: Column | str) -> Column:
    """Source name in lower case with underscores between words."""
    return F.regexp_replace(trimmed(c), r"[\s\-]+", "_")
