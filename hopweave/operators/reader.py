"""Scoring of answers written as ``ans:`` lines, and paired comparison of presentation arms."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text

# Words of questions whose answers may be contained either way round.
EITHER_WAY = ("when", "what year", "which year", "where", "sport", "what countr", "language", "nba finals", "world series")
# Lines that state there is no answer.
NO_ANSWER = ("ans: not available", "ans: no information available")
_PUNCTUATION = str.maketrans("", "", string.punctuation)


def needs_follow_up(prediction: Column) -> Column:
    p = F.lower(prediction)
    return ~F.contains(p, F.lit("ans:")) | F.contains(p, F.lit(NO_ANSWER[0])) | F.contains(p, F.lit(NO_ANSWER[1]))


def emitted(prediction: Column) -> Column:
    """Answer lines in order, each once; lines that deny an answer are left out."""
    lines = F.filter(F.split(prediction, "\n"), lambda x: F.contains(x, F.lit("ans:")) & ~F.contains(F.lower(x), F.lit("none")) & ~F.contains(F.lower(x), F.lit(NO_ANSWER[0])) & ~F.contains(F.lower(x), F.lit(NO_ANSWER[1])))
    return F.array_distinct(lines)


def _normal(x: str) -> str:
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", x.lower().translate(_PUNCTUATION)).split())


def score_one(question: str, gold: list[str], lines: list[str]) -> tuple[float, float, float]:
    """``hit, f1, no_answer`` of emitted lines against gold answers.

    Longer answers and lines match first, each line once; years are cut from dates for "when"
    and "what year" questions; an empty gold answer is contained in anything.
    """
    asked = question.lower()
    loose = any(k in asked for k in EITHER_WAY)
    dated = any(k in asked for k in ("when", "what year"))

    def wanted(answer: str) -> str:
        year = re.match(r"(\d+)-", answer) if dated else None
        return _normal(year.group(1) if year else answer)

    # each line as the normal forms of its whole and of what follows its last mark
    forms = [(_normal(x), _normal(x.split("ans:")[-1])) for x in lines]
    fits = lambda form, goal, whole: goal in form[0] or (loose and (form[1] in goal or (whole and form[0] in goal)))
    goals = [wanted(a) for a in sorted(dict.fromkeys(gold), key=len, reverse=True)]
    used: set[int] = set()
    for goal in goals:
        used.update([i for i in sorted(range(len(lines)), key=lambda k: -len(lines[k])) if i not in used and fits(forms[i], goal, True)][:1])
    f1 = 2 * len(used) / (len(lines) + len(goals)) if lines and goals else 0.0
    first = bool(lines) and any(fits(forms[0], goal, False) for goal in goals)
    return float(first), f1, float(not lines)


def score_predictions(rows: DataFrame) -> DataFrame:
    """Adds ``hit, f1, no_answer`` to ``rows(question, ground_truth array<string>, prediction)``; nulls count as empty."""

    @F.pandas_udf("hit double, f1 double, no_answer double")
    def score(question: pd.Series, gold: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = [score_one(q or "", [a for a in (g if g is not None else []) if a is not None], list(x) if x is not None else []) for q, g, x in zip(question, gold, lines, strict=True)]
        return pd.DataFrame(out, columns=["hit", "f1", "no_answer"])

    return rows.withColumn("_s", score("question", "ground_truth", emitted(F.col("prediction")))).select(*[f"`{c}`" for c in rows.columns], "_s.*")


def first_answer_rank(lines: Column, answers: Column) -> Column:
    """1-based place of the first evidence line one of whose ends is a gold answer, or null."""
    from . import organize

    gold = F.transform(F.filter(answers, lambda a: F.trim(a) != ""), text.normalize_answer)
    hit = F.transform(lines, lambda x: text.let(organize.parse_triple(x), lambda t: F.coalesce(F.array_contains(gold, text.normalize_answer(t["head"])) | F.array_contains(gold, text.normalize_answer(t["tail"])), F.lit(False))))
    at = F.array_position(hit, F.lit(True))
    return F.when(at > 0, at)


def arm_differences(scores: DataFrame, left: str, right: str, samples: int = 1000, seed: int = 17) -> DataFrame:
    """Paired mean difference of two arms per slice, with an interval by index truncation.

    ``scores(id, slice, arm, value)``; an id counts in a slice where both arms have it.
    """
    wide = scores.groupBy("slice", "id").pivot("arm", [left, right]).agg(F.max("value"))
    d = wide.where(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull()).select("slice", "id", (F.col(f"`{left}`") - F.col(f"`{right}`")).alias("d"))
    means = stats.resampled_sums(d, "id", "d", ["slice"], samples, seed).select("slice", F.try_divide("total", "weight").alias("m"))
    ends = means.groupBy("slice").agg(F.array_sort(F.collect_list("m")).alias("m"))  # `samples` values a slice
    cut = ends.select("slice", F.get("m", F.lit(int(0.025 * samples))).alias("low"), F.get("m", F.lit(min(samples - 1, int(0.975 * samples)))).alias("high"))
    return d.groupBy("slice").agg(F.count("*").alias("n"), F.avg("d").alias("delta")).join(cut, "slice")


def interaction(scores: DataFrame, arms: tuple[str, str], models: tuple[str, str]) -> DataFrame:
    """Difference of differences of two models and two arms per slice: ``scores(id, slice, model, arm, value)``."""
    key = F.concat_ws("|", "model", "arm")
    names = [f"{m}|{a}" for m in models for a in arms]
    wide = scores.withColumn("k", key).groupBy("slice", "id").pivot("k", names).agg(F.max("value")).dropna(subset=names)
    v = lambda m, a: F.col(f"`{m}|{a}`")
    d = (v(models[0], arms[0]) - v(models[0], arms[1])) - (v(models[1], arms[0]) - v(models[1], arms[1]))
    return wide.groupBy("slice").agg(F.count("*").alias("n"), F.avg(d).alias("interaction"))


def with_slices(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """One row per slice that a row belongs to (slices overlap); ``all`` always."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in slices.items()]))
    return rows.withColumn("slice", F.explode(names))


def last_per_id(rows: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """The last row of each id in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
