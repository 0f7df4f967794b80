"""Ranking and selection over candidate groups: ties, top-k, argmax, sampling, quotas.

A group is given by key columns; the position column breaks ties, so results never depend
on partitioning. Scores that are null rank below all others. Groups are windows hashed by
key: one task holds one group, so groups are questions' candidate pools, never whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

TOLERANCE = 1e-12


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their rank."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def argmax(df: DataFrame, keys: list[str], score: Column, position: str, answers: str | None = None) -> DataFrame:
    """One row per group: the best score, first position on ties, with margin and fallback flag.

    With ``answers``, candidates without an answerable endpoint are passed over unless the
    group has no other (``fallback``). The margin is the lead over the runner-up in the pool
    used, 0 for a single candidate.
    """
    w = Window.partitionBy(*keys)
    usable = text.answerable(F.col(answers)) if answers else F.lit(True)
    pool = df.withColumn("_s", score.cast("double")).withColumn("_ok", usable).withColumn("fallback", ~F.max("_ok").over(w)).where(F.col("_ok") | F.col("fallback"))
    order = w.orderBy(F.col("_s").desc_nulls_last(), F.col(position))
    ranked = pool.withColumn("_n", F.row_number().over(order)).withColumn("margin", F.coalesce(F.col("_s") - F.lead("_s").over(order), F.lit(0.0)))
    return ranked.where("_n = 1").drop("_n", "_ok", "_s")


def fractional_ranks(df: DataFrame, keys: list[str], score: str, out: str = "rank") -> DataFrame:
    """Descending ranks; scores no more than ``TOLERANCE`` below the next higher one share its run's mean rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last())
    above = F.lag(score).over(w)
    starts = F.when(above.isNotNull() & F.col(score).isNotNull() & (above - F.col(score) <= TOLERANCE), 0).when(F.row_number().over(w) > 1, F.when(above.isNull() & F.col(score).isNull(), 0).otherwise(1)).otherwise(1)
    run = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = df.withColumn("_start", starts).withColumn("_run", run).withColumn("_row", F.row_number().over(w))
    mine = Window.partitionBy(*keys, "_run")
    return r.withColumn(out, ((F.min("_row").over(mine) + F.max("_row").over(mine)) / 2).cast("double")).drop("_start", "_run", "_row")


def group_ranking(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Per group the tie-aware measures of the best positive; groups without a positive are left out.

    ``credit`` share of positives in the top tie, ``strict`` the whole top tie is positive,
    ``tied`` the top has a tie, ``rr`` 1 over the expected rank of the first positive among
    its ties, ``pairs`` and ``won`` negatives and those below the best positive.
    """
    pos, s = F.col(positive), F.col(score)
    w = Window.partitionBy(*keys)
    m = df.where(s.isNotNull() & pos.isNotNull()).withColumn("_p", F.max(F.when(pos, s)).over(w)).withColumn("_t", F.max(s).over(w)).where("_p is not null")
    near = lambda x: F.abs(s - F.col(x)) <= TOLERANCE
    g = m.groupBy(*keys).agg(
        F.count_if(s > F.col("_p")).alias("higher"),
        F.count_if(near("_p")).alias("level"),
        F.count_if(near("_p") & pos).alias("level_positive"),
        F.count_if(near("_t")).alias("top"),
        F.count_if(near("_t") & pos).alias("top_positive"),
        F.count_if(~pos).alias("pairs"),
        F.count_if(~pos & (F.col("_p") > s)).alias("won"),
    )
    expected = F.col("higher") + (F.col("level") + 1) / (F.col("level_positive") + 1)
    return g.select(
        *keys,
        (F.col("top_positive") / F.col("top")).alias("credit"),
        (F.col("top_positive") == F.col("top")).cast("double").alias("strict"),
        (F.col("top") > 1).cast("double").alias("tied"),
        (1.0 / expected).alias("rr"),
        "pairs",
        "won",
    )


def ranking_metrics(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """One row of means over groups; zeros where there is no group."""
    g = group_ranking(df, keys, score, positive)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return g.agg(
        F.count("*").alias("examples"),
        mean("credit").alias("recall_at_1"),
        mean("strict").alias("strict_recall_at_1"),
        mean("tied").alias("top_tie_rate"),
        mean("rr").alias("mrr"),
        F.coalesce(F.try_divide(F.sum("won").cast("double"), F.sum("pairs")), F.lit(0.0)).alias("pairwise_accuracy"),
    )


def pairwise_by(df: DataFrame, keys: list[str], score: str, positive: str, kind: str) -> DataFrame:
    """Share of negatives below the best positive, by kind of negative."""
    pos, s = F.col(positive), F.col(score)
    m = df.where(s.isNotNull() & pos.isNotNull()).withColumn("_p", F.max(F.when(pos, s)).over(Window.partitionBy(*keys))).where(F.col("_p").isNotNull() & ~pos)
    return m.groupBy(kind).agg(F.count("*").alias("pairs"), F.avg((F.col("_p") > s).cast("double")).alias("accuracy"))


def first_positive_rank(df: DataFrame, keys: list[str], order: list[Column], positive: str) -> DataFrame:
    """1-based rank of the first positive of each group, null where there is none."""
    r = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return r.groupBy(*keys).agg(F.min(F.when(F.col(positive), F.col("_n"))).alias("first_rank"))


def recall_at(ranks: DataFrame, cuts: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """Share of groups ranked within each cut, over all groups and over those with a positive."""
    have = F.count("first_rank")
    cols = []
    for k in cuts:
        hit = F.count_if(F.col("first_rank") <= k)
        cols.append(F.struct(F.lit(k).alias("k"), F.coalesce(F.try_divide(hit.cast("double"), F.count("*")), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(hit.cast("double"), have), F.lit(0.0)).alias("recall_available")))
    return ranks.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def hash_order(seed: str, *ids: str) -> Column:
    """Order that looks random but is the same everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]), 256)


def sample_candidates(df: DataFrame, keys: list[str], score: str, positive: str, position: str, hard: int = 12, other: int = 4, positives: int = 4, seed: str = "17") -> DataFrame:
    """Best positives, hardest negatives and some others of each group; groups without a positive go."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    pos = F.coalesce(F.col(positive), F.lit(False))
    m = df.withColumn("_pos", pos).withColumn("_any", F.max("_pos").over(Window.partitionBy(*keys))).where("_any")
    m = m.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_pos").orderBy(s.desc(), F.col(position))))
    m = m.withColumn("_hard", ~F.col("_pos") & (F.col("_n") <= hard))
    m = m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_pos", "_hard").orderBy(hash_order(seed, *keys, position))))
    take = F.when(F.col("_pos"), F.col("_n") <= positives).otherwise(F.col("_hard") | (F.col("_r") <= other))
    role = F.when(F.col("_pos"), "positive").when(F.col("_hard"), "hard").otherwise("random")
    return m.where(take).withColumn("role", role).drop("_pos", "_any", "_n", "_hard", "_r")


def round_robin(df: DataFrame, bucket: list[str], order: list[Column], quota: int) -> DataFrame:
    """``quota`` rows taken in turn from the buckets, one per bucket and round.

    The place of a row is its round, then its bucket's order. Every round gives a row, so a
    bucket's first ``quota`` rows suffice: they are cut before the shuffle, however hot the
    bucket, and at most ``quota`` rounds are summed up.
    """
    r = df.withColumn("round", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).where(F.col("round") <= quota)
    rounds = r.groupBy("round").count()
    before = rounds.select("round", (F.sum("count").over(Window.orderBy("round")) - F.col("count")).alias("before"))
    kept = r.join(before, "round").where(F.col("before") < quota)
    w = Window.partitionBy("round").orderBy(*bucket)
    return kept.withColumn("place", F.col("before") + F.row_number().over(w)).where(F.col("place") <= quota).drop("before")


def split_quotas(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Shares of ``target`` in proportion to the sizes, rounded, then repaired to add up.

    One at a time goes to the split with most rows left over, or is taken from the largest quota;
    of equals the first in the order given.
    """
    total = sum(sizes.values())
    target = min(target, total)
    quota = {s: min(n, round(target * n / total)) if total else 0 for s, n in sizes.items()}
    while sum(quota.values()) < target:
        quota[max(sizes, key=lambda s: sizes[s] - quota[s])] += 1
    while sum(quota.values()) > target:
        quota[max(quota, key=lambda s: quota[s])] -= 1
    return quota


def stratified_selection(df: DataFrame, split: str, splits: list[str], bucket: list[str], order: list[Column], target: int) -> DataFrame:
    """``target`` rows over the splits in proportion to their sizes, in turn from the buckets of each split."""
    found = {r[split]: r["count"] for r in df.where(F.col(split).isin(splits)).groupBy(split).count().collect()}
    quota = split_quotas({s: found.get(s, 0) for s in splits}, target)
    parts = [round_robin(df.where(F.col(split) == s), bucket, order, n) for s, n in quota.items() if n]
    if not parts:
        return round_robin(df.limit(0), bucket, order, 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: str = "17") -> DataFrame:
    """Exactly ``n`` distinct key rows (or all), the first in hash order, without a global sort.

    Hashes fall into 4096 ranges; the ranges' counts (4096 rows) tell which are taken whole,
    and only the range on the cut is ranked.
    """
    k = df.select(*keys).distinct().withColumn("_h", hash_order(seed, *keys)).withColumn("_r", F.substring("_h", 1, 3))
    counts = sorted((r["_r"], r["count"]) for r in k.groupBy("_r").count().collect())
    whole, cut, left = [], None, n
    for r, c in counts:
        if c <= left:
            whole.append(r)
            left -= c
        else:
            cut = r
            break
    last = whole[-1] if whole else ""
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *keys))
    taken = k.where(F.col("_r") <= last) if whole else k.where(F.lit(False))
    if cut is not None and left:
        taken = taken.unionByName(k.where(F.col("_r") == cut).withColumn("_n", rank).where(F.col("_n") <= left).drop("_n"))
    return taken.select(*keys)


def category_first(df: DataFrame, keys: list[str], category: str, position: str, limit: int) -> DataFrame:
    """First row of each new category, then the rest in order, up to ``limit`` a group."""
    first = F.row_number().over(Window.partitionBy(*keys, category).orderBy(position)) == 1
    return top_k(df.withColumn("_f", first), keys, [F.col("_f").desc(), F.col(position)], limit, "place").drop("_f")
