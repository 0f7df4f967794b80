"""Answer sets: keys and the three scoring conventions, which are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _set(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def answer_key(a: Column) -> Column:
    """Trimmed, lower-cased, non-blank, distinct, sorted."""
    folded = F.transform(F.filter(_set(a), lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda x: x != "")))


def _overlap(p: Column, g: Column) -> Column:
    return F.size(F.array_intersect(p, g))


def _f1(p: Column, g: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * _overlap(p, g), F.size(p) + F.size(g)), F.lit(0.0))


def contract_scores(predicted: Column, gold: Column) -> Column:
    """Raw sets; both empty counts as exact with F1 of 1."""
    p, g = F.array_distinct(_set(predicted)), F.array_distinct(_set(gold))
    both = (F.size(p) == 0) & (F.size(g) == 0)
    exact = (F.size(p) == F.size(g)) & (_overlap(p, g) == F.size(p))
    return F.struct(exact.alias("exact"), F.when(both, 1.0).otherwise(_f1(p, g)).alias("f1"))


def folded_scores(predicted: Column, gold: Column) -> Column:
    """Folded keys; nothing is exact without gold answers."""
    p, g = answer_key(predicted), answer_key(gold)
    share = lambda of: F.coalesce(F.try_divide(_overlap(p, g).cast("double"), F.size(of)), F.lit(0.0))
    return F.struct(
        share(p).alias("precision"),
        share(g).alias("recall"),
        _f1(p, g).alias("f1"),
        ((F.size(g) > 0) & (F.array_join(p, "\u0001") == F.array_join(g, "\u0001"))).cast("double").alias("exact_match"),
        (_overlap(p, g) > 0).cast("double").alias("has_answer"),
    )


def raw_scores(predicted: Column, gold: Column) -> Column:
    """Raw sets without folding; exact also when both are empty, F1 then 0."""
    p, g = F.array_distinct(_set(predicted)), F.array_distinct(_set(gold))
    exact = (F.size(p) == F.size(g)) & (_overlap(p, g) == F.size(p))
    return F.struct(exact.cast("double").alias("em"), _f1(p, g).alias("f1"))


def multiset_counts(a: Column) -> Column:
    """Counts per element, as a map from element to count."""
    d = F.array_distinct(_set(a))
    return F.map_from_arrays(d, F.transform(d, lambda x: F.size(F.filter(_set(a), lambda y: y.eqNullSafe(x)))))


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(_set(a)) == F.array_sort(_set(b))


def strict_submultiset(a: Column, b: Column) -> Column:
    """Every count of ``a`` is at most that of ``b``, and they differ."""
    n = lambda xs, x: F.size(F.filter(_set(xs), lambda y: y.eqNullSafe(x)))
    return F.forall(F.array_distinct(_set(a)), lambda x: n(a, x) <= n(b, x)) & ~multiset_equal(a, b)


def missing(reference: Column, found: Column) -> Column:
    return F.array_sort(F.array_except(_set(reference), _set(found)))
