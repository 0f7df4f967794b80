"""Text functions as Spark columns (built-in expressions; Python only where none exists).

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Substrings of relations that describe records rather than the world.
METADATA_PATTERNS = (
    "base.kwebbase", "common.topic.notable_types", "common.topic.notable_for", "common.topic.subject_of", "common.image", "freebase.valuenotation",
    "wikidata property", "external id", "identifier", "described by source", "imported from", "url",
)
# Relations that read the same both ways, and types that say nothing.
SYMMETRIC_PARTS = (
    "adjacent to", "different from", "diplomatic relation", "partner", "said to be the same as", "shares border with", "sibling", "spouse", "twinned administrative body",
)
SYMMETRIC_WHOLE = ("relative",)
GENERIC_TYPES = ("", "entity", "thing", "unknown")
UNINFORMATIVE_TYPES = ("", "answer", "answer entity", "entity", "intermediate entity", "thing", "unknown")
UNLABELED = r"^[a-z]\.[0-9a-z_]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), 0)


def normalize_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def normalized_words(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(_c(c)), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def stable_bucket(c: Column | str, n: int = 10_000, digits: int = 12) -> Column:
    """Bucket from the first hexadecimal digits of SHA-256 (reproducible outside Spark)."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(c), 256), 1, digits), 16, 10).cast("long"), F.lit(n))


def relation_words(c: Column | str, backward: Column | None = None) -> Column:
    """Human words of a relation id: the last of three or more dotted parts, separators as spaces."""
    parts = F.split(F.regexp_replace(_c(c), r"^ns:", ""), r"\.")
    words = normalize_space(F.translate(F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.array_join(parts, " ")), "_/", "  "))
    return words if backward is None else F.when(backward, F.concat(F.lit("inverse of "), words)).otherwise(words)


def full_relation_words(c: Column | str) -> Column:
    """All parts of a relation id, parts set apart by slashes."""
    bare = F.regexp_replace(_c(c), r"^ns:", "")
    return normalize_space(F.regexp_replace(F.translate(F.regexp_replace(bare, r"\.", " / "), "_", " "), "/", " / "))


def relation_text(c: Column | str) -> Column:
    """The last two parts of a dotted id, in words."""
    parts = F.split(_c(c), r"\.")
    return F.translate(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), " "), "_", " ")


def type_hint(c: Column | str) -> Column:
    """The type that a dotted id states of its subject; empty text where there is none."""
    parts = F.split(F.regexp_replace(_c(c), r"^ns:", ""), r"\.")
    return F.when(F.size(parts) < 2, "").otherwise(F.lower(F.translate(F.element_at(parts, -2), "_", " ")))


def relation_schema(c: Column | str) -> Column:
    """Domain, type and property of an id split at slashes, or else dots; complete with three parts."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), r"^ns:", ""), r"^/+|/+$", "")
    slash = F.contains(bare, F.lit("/"))
    parts = F.filter(F.split(bare, F.when(slash, "/").otherwise(r"\.")), lambda x: x != "")
    full = F.size(parts) >= 3
    tail = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
    rest = F.when(slash, F.array_join(tail, "/")).otherwise(F.array_join(tail, "."))
    return F.struct(F.when(full, F.get(parts, F.lit(0))).alias("domain"), F.when(full, F.get(parts, F.lit(1))).alias("type"), F.when(full, rest).alias("property"), full.alias("complete"))


def is_symmetric(relation: Column, subject_role: Column, object_role: Column) -> Column:
    """Does a relation read the same both ways, by its words or by equal glossary roles?"""
    words = lambda c: F.array_join(tokens(F.translate(F.coalesce(c, F.lit("")), "_", " ")), " ")
    r = words(relation)
    by_name = r.isin(*SYMMETRIC_WHOLE)
    for part in SYMMETRIC_PARTS:
        by_name = by_name | F.contains(r, F.lit(part))
    return by_name | ((words(subject_role) != "") & (words(subject_role) == words(object_role)))


def metadata_patterns(c: Column | str) -> Column:
    """Which metadata patterns a relation has (empty: none)."""
    return F.filter(F.array(*map(F.lit, METADATA_PATTERNS)), lambda p: F.contains(F.lower(_c(c)), p))


def is_semantic(c: Column | str) -> Column:
    return F.size(metadata_patterns(c)) == 0


def repair_mojibake(c: Column | str) -> Column:
    """Text whose UTF-8 was read as Latin-1, put right; anything else unchanged."""
    c = _c(c)
    suspect = c.rlike("[ÃÂâ]") & c.rlike(r"^[\x{00}-\x{FF}]*$")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(F.encode(F.when(suspect, c), "ISO-8859-1").cast("string")), c)).otherwise(c)


def comparable(c: Column | str) -> Column:
    """Typed form of a literal: kind 0 time, 1 number, 2 text (lower case), with one field each.

    Quotes and a ``^^type`` are dropped; a bare year is a number. Kinds order time, number, text.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"\^\^.*$", ""), r'^"|"$', ""))
    iso = bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    ts = F.when(iso, F.try_to_timestamp(F.when(iso, bare)))
    number = F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    kind = F.when(ts.isNotNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return F.when(
        _c(c).isNotNull(),
        F.struct(kind.alias("kind"), ts.alias("ts"), F.when(ts.isNull(), number).alias("num"), F.when(ts.isNull() & number.isNull(), F.lower(bare)).alias("str")),
    )


def matches(value: Column, operator: str, argument: Column) -> Column:
    """Typed comparison; of different kinds only NotEqual holds; null values match nothing."""
    a, b = comparable(value), comparable(argument)
    same = a["kind"] == b["kind"]
    order = lambda x: F.struct(x["ts"], x["num"], x["str"])
    x, y = order(a), order(b)
    op = {
        "Equal": same & (x == y),
        "NotEqual": ~same | (x != y),
        "LessThan": same & (x < y),
        "GreaterThan": same & (x > y),
        "LessOrEqual": same & (x <= y),
        "GreaterOrEqual": same & (x >= y),
    }.get(operator)
    if op is None:
        raise ValueError(f"unknown operator {operator}")
    return F.coalesce(value.isNotNull() & argument.isNotNull() & op, F.lit(False))


def unlabeled_count(answers: Column | str) -> Column:
    return F.size(F.filter(_c(answers), lambda a: F.trim(a).rlike(UNLABELED)))


def answerable(answers: Column | str) -> Column:
    """Has an answer, and not only ids without a label."""
    n = F.coalesce(F.size(_c(answers)), F.lit(0))
    return (n > 0) & (F.coalesce(unlabeled_count(answers), F.lit(0)) < n)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value computed once; inside lambdas a plain expression would be computed anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _some_often(items: Column, limit: int) -> Column:
    """Does some item occur ``limit`` times or more? In sorted order equal items stand ``limit - 1`` apart."""

    def check(c: Column) -> Column:
        n = F.greatest(F.size(c) - (limit - 1), F.lit(0))
        return F.exists(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(limit), n), lambda x, y: x == y), lambda x: x)

    return let(F.array_sort(items), check)


def _grams(words: Column, width: int) -> Column:
    """Runs of ``width`` words as texts, by shifting the list against itself."""
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    out = F.slice(words, F.lit(1), n)
    for k in range(1, width):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), n), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def ngram_repeats(words: Column, width: int, limit: int = 5) -> Column:
    """Does some run of ``width`` words occur ``limit`` times or more? False for short texts."""
    return _some_often(_grams(words, width), limit)


# Words that may repeat.
STOP_WORDS = ("a", "an", "the", "is", "of", "in", "to", "what", "which", "who")


def word_repeats(words: Column, limit: int = 7) -> Column:
    return _some_often(F.filter(words, lambda x: ~x.isin(*STOP_WORDS)), limit)


def repetition_reason(c: Column | str) -> Column:
    """First failing repetition rule of a question, or null; under six words nothing fails.

    A run of four or five words that comes back brings its first three words back as often, so
    those rules never come first and need no look.
    """

    def rules(w: Column) -> Column:
        return F.when(F.size(w) < 6, F.lit(None).cast("string")).when(ngram_repeats(w, 3), "repeated_3_gram").when(word_repeats(w), "excessive_repeated_content_word")

    return let(tokens(c), rules)


def set_cosine(a: Column, b: Column) -> Column:
    """Words shared over the root of the product of the set sizes (at least 1)."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.sqrt((F.size(x) * F.size(y)).cast("double")), F.lit(1.0))


def coverage(a: Column, b: Column) -> Column:
    """Share of ``b``'s distinct words that ``a`` has; 0 for no words."""
    y = F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(a), y)), F.size(y)), F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 over word multisets; an empty side gives 1 if both are empty, else 0."""
    one = F.array_distinct(F.array_intersect(a, b))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    shared = F.aggregate(one, F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by rows of the usual table, inside the expression."""
    zeros = F.transform(b, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        # state: the new row so far; place j of prev is prev[j-1] diagonal, prev[j] above
        return F.aggregate(
            F.sequence(F.lit(0), F.size(b) - 1),
            F.array().cast("array<int>"),
            lambda new, j: F.concat(
                new,
                F.array(
                    F.when(F.get(b, j) == x, F.coalesce(F.get(prev, j - 1), F.lit(0)) + 1).otherwise(F.greatest(F.get(prev, j), F.coalesce(F.get(new, j - 1), F.lit(0))))
                ),
            ),
        )

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(a, zeros, row), -1))


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence; empty sides as in :func:`token_f1`."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * lcs_length(a, b) / (F.size(a) + F.size(b)))


@F.pandas_udf(T.DoubleType())
def rouge_l_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for long word arrays, in Arrow batches, by bit-parallel rows."""

    def one(x: list, y: list) -> float | None:
        if x is None or y is None:
            return None
        if len(x) == 0 or len(y) == 0:
            return float(len(x) == len(y))
        at: dict[str, int] = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for w in y:
            u = v & at.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return 2.0 * (len(x) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def delexicalize_exact(question: Column, anchor: Column) -> Column:
    """The anchor at word bounds, whatever its case, becomes ``[ENTITY]``."""
    escaped = F.regexp_replace(anchor, r"([\\.\[\]{}()*+\-?^$|#&~\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iu)(?<!\w)"), escaped, F.lit(r"(?!\w)"))
    return F.when(F.length(F.trim(anchor)) > 0, F.regexp_replace(question, pattern, F.lit("[ENTITY]"))).otherwise(question)


def delexicalize_text(question: str | None, anchor: str | None, least: float = 0.72) -> str | None:
    """Exact replacement, else the most similar run of words (first best, at least ``least``)."""
    if question is None or not anchor or not anchor.strip():
        return question
    exact = re.sub(rf"(?<!\w){re.escape(anchor)}(?!\w)", "[ENTITY]", question, flags=re.I)
    if exact != question:
        return exact
    spots = [m.span() for m in re.finditer(r"\S+", question)]
    size = len(anchor.split())
    best, span = least, None
    for n in range(max(1, size - 1), size + 2):
        for i in range(len(spots) - n + 1):
            lo, hi = spots[i][0], spots[i + n - 1][1]
            part = question[lo:hi].strip("?.,!;:'\"")
            ratio = difflib.SequenceMatcher(None, part.casefold(), anchor.casefold()).ratio()
            if ratio > best or (ratio == best and span is None):
                off = question[lo:hi].find(part)
                best, span = ratio, (lo + off, lo + off + len(part))
    return question if span is None else question[: span[0]] + "[ENTITY]" + question[span[1] :]


@F.pandas_udf(T.StringType())
def delexicalize(question: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([delexicalize_text(q, a) for q, a in zip(question, anchor, strict=True)])


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(_c(c)) / 4)


def directed(relation: Column | str, direction: Column | str) -> Column:
    return F.concat_ws("::", _c(relation), _c(direction))


def undirected(key: Column | str) -> Column:
    """Relation and direction of a key, split at the last ``::``; null when there is no direction."""
    key = _c(key)
    direction = F.substring_index(key, "::", -1)
    ok = direction.isin("forward", "backward") & F.contains(key, F.lit("::"))
    return F.when(ok, F.struct(F.regexp_replace(key, "::(forward|backward)$", "").alias("relation"), direction.alias("direction")))
