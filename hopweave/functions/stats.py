"""Paired statistics over runs: intervals, exact tests, corrections, rank correlation, AUC."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, median and lower percentiles (linear), shares at thresholds."""
    v = F.col(value).cast("double")
    at = lambda x: F.avg((v >= x).cast("double"))
    return df.where(v.isNotNull()).groupBy(*(keys or [])).agg(
        F.count("*").alias("examples"),
        F.avg(v).alias("mean"),
        F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.1).alias("p10"),
        F.percentile(v, 0.25).alias("p25"),
        *[at(x).alias(f"at_least_{int(x * 10)}0") for x in (0.6, 0.7, 0.8, 0.9)],
    )


def contingency(pairs: DataFrame, left: str, right: str, keys: list[str] | None = None) -> DataFrame:
    """Both, left only, right only and neither of paired correctness."""
    a, b = F.col(left), F.col(right)
    return pairs.groupBy(*(keys or [])).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))


def mcnemar_p(left_only: Column, right_only: Column) -> Column:
    """Two-sided exact binomial of the discordant pairs; 1 without any.

    Terms are summed from their logarithms, so large counts neither overflow nor vanish.
    """
    n, k = left_only + right_only, F.least(left_only, right_only)
    state = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    base = -n * F.log(F.lit(2.0))

    def add(s: Column, i: Column) -> Column:
        log = F.when(i == 0, base).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), state, add)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def holm(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Step-down adjusted p-values (running maximum, at most 1). The tests of one family fit one task."""
    ranked = Window.orderBy(p, *order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(ranked) + 1))
    return tests.withColumn("_s", step).withColumn("adjusted", F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def spearman(df: DataFrame, left_rank: str, right_rank: str, keys: list[str]) -> DataFrame:
    """Correlation of given ranks per group; 0 where a side does not vary.

    Not ``corr``: in ANSI mode that divides by zero, and ends the query, where one side does not vary.
    """
    x, y = (F.when(F.col(left_rank).isNotNull() & F.col(right_rank).isNotNull(), F.col(c)) for c in (left_rank, right_rank))
    c = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return df.groupBy(*keys).agg(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c).alias("spearman"))


def auc(df: DataFrame, score: str, positive: str, keys: list[str] | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties half, from counts per distinct score.

    Equal to counting all pairs, but linear: positives and negatives are added up per score
    first, then negatives below are a running sum over distinct scores of one group.
    """
    k = keys or []
    c = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*k, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    w = Window.partitionBy(*k).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2)
    g = c.withColumn("won", won).groupBy(*k).agg(F.sum("won").alias("won"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return g.select(*k, "positives", "negatives", F.try_divide("won", F.col("positives") * F.col("negatives").cast("double")).alias("auc"))


PRIME = 2_147_483_647
# inverse of the Poisson(1) distribution up to 6 (all but 1e-5 of it)
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(6))


def resampled_sums(df: DataFrame, row_id: str, value: str, keys: list[str], samples: int, seed: int) -> DataFrame:
    """``*keys, rep, total, weight``: sums of values and counts of Poisson resamples of the rows.

    A row's count in each replicate comes from a linear hash of 28 bits of its id's digest, so
    any engine can draw the same. Replicates are columns of a matrix in an Arrow batch: no row
    is multiplied, and a task sends one row per group and replicate.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    point = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 7), 16, 10).cast("long").alias("_x")
    given = df.where(F.col(value).isNotNull() & F.col(row_id).isNotNull()).select(*keys, point, F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*[given.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rep = np.arange(1, samples + 1, dtype=np.int64)
        a, b = (rep * 1_664_525 + 1_013_904_223 + seed) % PRIME, (rep * 22_695_477 + 1) % PRIME
        bars = np.array(POISSON)
        sums: dict[tuple, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, (total, weight) in sums.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * samples, f.type) for x, f in zip(k, arrow, strict=False)), pa.array(rep.astype(np.int32)), pa.array(total), pa.array(weight)], schema=arrow)
            sums.clear()

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[: len(keys)]]
            x, v = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            groups: dict[tuple, list[int]] = {}
            for i in range(batch.num_rows):
                groups.setdefault(tuple(c[i] for c in cols), []).append(i)
            for k, at in groups.items():
                total, weight = sums.setdefault(k, [np.zeros(samples), np.zeros(samples, np.int64)])
                for lo in range(0, len(at), 1000):
                    part = at[lo : lo + 1000]
                    unit = ((x[part, None] * a + b) % PRIME + 0.5) / PRIME
                    c = np.searchsorted(bars, unit, side="left")
                    total += v[part] @ c
                    weight += c.sum(0)
            if len(sums) > 1000:
                yield from flush()
        yield from flush()

    sums = given.mapInArrow(run, schema)
    return sums.groupBy(*keys, "rep").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap_interval(df: DataFrame, row_id: str, value: str, keys: list[str] | None = None, samples: int = 1000, seed: int = 17) -> DataFrame:
    """Mean with a 95 % interval from Poisson resampling of rows, in one pass; per group ``samples`` sums travel."""
    k = keys or []
    # read twice below, so written once; joining both halves to one unstaged plan also lost rows in testing
    df = materialize(df.select(*k, row_id, value), "resampled")
    means = resampled_sums(df, row_id, value, k, samples, seed).select(*k, F.try_divide("total", "weight").alias("m"))
    ends = means.groupBy(*k).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    base = df.where(F.col(value).isNotNull()).groupBy(*k).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return base.join(ends, k) if k else base.crossJoin(ends)  # one row each


def listwise_loss(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """``logsumexp`` of all scores less that of the positives, per group with a positive."""
    m = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).withColumn("_m", F.max(score).over(Window.partitionBy(*keys)))
    e = F.exp(F.col(score) - F.col("_m"))
    g = m.groupBy(*keys).agg(F.sum(e).alias("all"), F.sum(F.when(F.col(positive), e)).alias("pos")).where("pos is not null")
    return g.select(*keys, (F.log("all") - F.log("pos")).alias("loss"))


def compare_runs(picks: DataFrame, runs: list[str], question: str = "question_id") -> DataFrame:
    """All unordered pairs of runs from ``picks(run, question, correct)``: table, exact p and its Holm value.

    A run lacking a question counts as wrong there only if the other has it.
    """
    wide = picks.groupBy(question).pivot("run", runs).agg(F.max("correct"))
    parts = []
    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            parts.append(contingency(wide.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()), f"`{a}`", f"`{b}`").select(F.lit(a).alias("left_run"), F.lit(b).alias("right_run"), "*"))
    table = parts[0]
    for x in parts[1:]:
        table = table.unionByName(x)
    return holm(table.withColumn("p", mcnemar_p(F.col("left_only"), F.col("right_only"))), "p", ["left_run", "right_run"])
