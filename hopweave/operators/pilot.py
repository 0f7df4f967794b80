"""Balanced pilot samples by evidence depth, and evaluation of arms and models over slices in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ranking

DEPTHS = {"shallow_1_10": (1, 10), "deep_51_100": (51, 100)}


def select_pilot(rows: DataFrame, per_slice: int, buckets: dict[str, tuple[int, int]] = DEPTHS, seed: str = "17") -> DataFrame:
    """Equally many rows of each bucket of ``evidence_rank``, at most ``per_slice``, picked by hash: adds ``pilot_bucket``.

    ``rows(id, evidence_rank, ...)``; the smallest bucket bounds all (one count per bucket comes
    to the driver). An empty bucket is an error.
    """
    rank = F.col("evidence_rank")
    bucket = reduce(lambda a, b: a.when(rank.between(*b[1]), b[0]), list(buckets.items())[1:], F.when(rank.between(*next(iter(buckets.values()))), next(iter(buckets))))
    b = rows.withColumn("pilot_bucket", bucket).where("pilot_bucket is not null")
    sizes = {r["pilot_bucket"]: r["count"] for r in b.groupBy("pilot_bucket").count().collect()}
    n = min([per_slice, *(sizes.get(k, 0) for k in buckets)])
    if n < 1:
        raise ValueError("a depth bucket has no rows")
    return ranking.top_k(b, ["pilot_bucket"], [ranking.hash_order(seed, "id"), F.col("id")], n, "_n").drop("_n")


def arm_inputs(prompts: DataFrame, arms: list[str]) -> DataFrame:
    """``id, arm, lines``: the same evidence in every arm, ``original`` being as given (losslessness is checked by the organizer)."""
    from . import organize

    given = prompts.select("id", F.lit("original").alias("arm"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    return reduce(lambda a, b: a.unionByName(b), [organize.organize(prompts, x).select("id", F.lit(x).alias("arm"), "lines") for x in arms], given)


def require_complete(scores: DataFrame) -> None:
    """Raises unless every model and arm of ``scores(id, model, arm, metric, value)`` covers the same ids."""
    per = scores.groupBy("id").agg(F.countDistinct("model", "arm").alias("n"))
    cells = scores.select("model", "arm").distinct().count()
    bad = per.where(F.col("n") != cells).limit(3).collect()
    if bad:
        raise ValueError(f"arms without the ids {[r['id'] for r in bad]}")


def arm_means(scores: DataFrame, slices: DataFrame) -> DataFrame:
    """``slice, model, arm, metric, n, mean`` from scores and ``slices(id, slice)`` (slices may overlap)."""
    return scores.join(slices, "id").groupBy("slice", "model", "arm", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def effects(scores: DataFrame, slices: DataFrame, comparisons: list[tuple[str, str]], samples: int = 1000, seed: int = 17) -> DataFrame:
    """Paired differences of arms with intervals: ``slice, model, metric, comparison, n, delta, low, high``.

    All comparisons, slices, models and metrics are groups of one resampling pass.
    """
    names = sorted({a for c in comparisons for a in c})
    wide = scores.groupBy("id", "model", "metric").pivot("arm", names).agg(F.max("value"))
    each = F.array(*[F.struct(F.lit(f"{a}_minus_{b}").alias("comparison"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")) for a, b in comparisons])
    d = wide.select("id", "model", "metric", F.explode(each).alias("x")).select("id", "model", "metric", "x.comparison", "x.d").where("d is not null").join(slices, "id")
    return _interval(d, ["slice", "model", "metric", "comparison"], "d", "delta", samples, seed)


def interactions(scores: DataFrame, slices: DataFrame, comparisons: list[tuple[str, str]], models: tuple[str, str], samples: int = 1000, seed: int = 17) -> DataFrame:
    """Effect of a comparison on the first model less that on the second, paired by id."""
    names = sorted({a for c in comparisons for a in c})
    wide = scores.withColumn("cell", F.concat_ws("|", "model", "arm")).groupBy("id", "metric").pivot("cell", [f"{m}|{a}" for m in models for a in names]).agg(F.max("value"))
    v = lambda m, a: F.col(f"`{m}|{a}`")
    each = F.array(*[F.struct(F.lit(f"{a}_minus_{b}").alias("comparison"), ((v(models[0], a) - v(models[0], b)) - (v(models[1], a) - v(models[1], b))).alias("d")) for a, b in comparisons])
    d = wide.select("id", "metric", F.explode(each).alias("x")).select("id", "metric", "x.comparison", "x.d").where("d is not null").join(slices, "id")
    return _interval(d, ["slice", "metric", "comparison"], "d", "interaction", samples, seed)


def _interval(d: DataFrame, keys: list[str], value: str, out: str, samples: int, seed: int) -> DataFrame:
    got = stats.bootstrap_interval(d, "id", value, keys, samples, seed)
    return got.withColumnRenamed("mean", out)
