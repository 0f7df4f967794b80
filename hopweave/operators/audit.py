"""Failure audit of predicted programs against reference programs."""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as A


def fragments(relations: Column, has_filter: Column, has_order: Column) -> Column:
    """Relations of a program plus a token each for filters and order."""
    extra = lambda on, name: F.when(F.coalesce(on, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.coalesce(relations, F.array().cast("array<string>")), extra(has_filter, "operator:filter"), extra(has_order, "operator:order"))


def classify(status: Column, exact: Column, reference: Column, selected: Column, proposed: Column, reference_in_beam: Column, has_answers: Column, same_program: Column) -> Column:
    """First fitting category of a prediction; nulls count as false or empty."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~status.eqNullSafe("exact"), "evidence_absent")
        .when(no(exact), "correct_answer")
        .when(F.size(A.missing(reference, proposed)) > 0, "fragment_never_proposed")
        .when(no(reference_in_beam), "ranked_below")
        .when(no(has_answers) & A.strict_submultiset(selected, reference), "silent_incompleteness")
        .when(no(same_program), "execution_normalization")
        .otherwise("fragment_pruned")
    )


def canonical(select: str | None, atoms: list[tuple[str, str, str]] | None, most: int = 7) -> str | None:
    """Text of a program that is the same for any naming of its variables; null beyond ``most`` variables.

    A null is equal to nothing here.
    """
    if not select or not atoms:
        return None
    names = sorted({x for h, _, t in atoms for x in (h, t) if x.startswith("?")} | ({select} if select.startswith("?") else set()))
    if len(names) > most:
        return None
    best = None
    for order in permutations(range(len(names))):
        to = {v: f"?{k}" for v, k in zip(names, order, strict=True)}
        term = lambda x: to.get(x, f"const:{x}")  # noqa: B023, E731
        form = (term(select), tuple(sorted((term(h), r, term(t)) for h, r, t in atoms)))
        best = form if best is None or form < best else best
    return repr(best)


@F.pandas_udf(T.StringType())
def canonical_program(select: pd.Series, atoms: pd.Series) -> pd.Series:
    """``atoms`` are texts ``head relation tail``."""
    return pd.Series([canonical(s, [tuple(a.split(" ")) for a in x] if x is not None else None) for s, x in zip(select, atoms, strict=True)])
