"""Assembly of training examples: synthetic paths under quotas, accepted and rejected rows, direction pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import corpus, ranking


def synthesize(paths: DataFrame, quota: int, depths: tuple[int, ...] = (1, 2, 3), seed: str = "17") -> DataFrame:
    """Up to ``quota`` paths of each graph and depth, picked by hash, each once: adds ``depth, split``.

    ``paths(kg, anchor, sequence, end)``; equal rows are one path. All paths of one sequence go
    to one split, a tenth of the sequences to dev. The pick ranks by hash inside (kg, depth);
    only a group's first ``quota`` rows of each task are shuffled.
    """
    p = paths.where("anchor is not null and size(sequence) > 0").select("kg", "anchor", "sequence", "end").distinct()
    p = p.withColumn("depth", F.size("sequence")).where(F.col("depth").isin(*depths)).withColumn("_s", F.array_join("sequence", "|"))
    p = ranking.top_k(p, ["kg", "depth"], [ranking.hash_order(seed, "kg", "anchor", "_s", "end"), F.col("anchor"), F.col("_s"), F.col("end")], quota, "_n")
    split = F.when(text.stable_bucket(F.concat(F.lit("synthetic-dev:"), "_s"), 10) == 0, "dev").otherwise("train")
    return p.withColumn("split", split).drop("_n", "_s")


def assemble(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples fit for training, with the negatives that survive, and the rejected ones with their reason.

    A negative survives with hops, another sequence than the positive path and all alternate
    ones, and once for each sequence (the first stands). Reasons, in this order: ``no_id``,
    ``no_question``, ``no_path`` (no hops, or a null hop), ``no_negative``.
    """
    whole = lambda p: (F.size(p["hops"]) > 0) & ~F.exists(p["hops"], lambda h: h.isNull() | h["relation"].isNull() | h["direction"].isNull())
    seq = lambda p: F.array_join(corpus.relation_sequence(p["hops"]), "|")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform(F.filter("alternate_positive_paths", lambda p: F.coalesce(whole(p), F.lit(False))), seq), none)
    known = F.concat(F.array(seq(F.col("positive_path"))), own)
    sound = F.filter("negative_paths", lambda p: F.coalesce(whole(p), F.lit(False)) & ~F.array_contains(F.col("_known"), seq(p)))
    named = F.transform("_sound", seq)
    first = F.filter("_sound", lambda p, i: F.array_position(F.col("_named"), F.get("_named", i)) == i + 1)
    x = examples.withColumn("_known", known).withColumn("_sound", sound).withColumn("_named", named).withColumn("_left", first)
    reason = (
        F.when(F.col("example_id").isNull(), "no_id")
        .when(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question")
        .when(~F.coalesce(whole(F.col("positive_path")), F.lit(False)), "no_path")
        .when(F.coalesce(F.size("_left"), F.lit(0)) == 0, "no_negative")
    )
    x = x.withColumn("reason", reason)
    kept = x.where("reason is null").withColumn("negative_paths", F.col("_left")).select(*examples.columns)
    return kept, x.where("reason is not null").select("example_id", "reason")


def direction_examples(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One example for each pair of records of one relation read both ways.

    ``pairs(kg, relation, forward_id, backward_id, split)`` (see ``corpus.direction_pairs``),
    ``rows(id, question, path)``. The backward path is the negative of the forward one:
    ``example_id, question, positive_path, negative_path, negative_question, split, kg, sequence``.
    """
    side = lambda name: rows.select(F.col("id").alias(f"{name}_id"), F.col("question").alias(f"{name}_question"), F.col("path").alias(f"{name}_path"))
    j = pairs.join(side("forward"), "forward_id").join(side("backward"), "backward_id")
    digest = F.substring(F.sha2(F.concat_ws("::", "kg", "relation"), 256), 1, 16)
    return j.select(
        F.concat_ws(":", F.lit("direction-pair"), "kg", digest).alias("example_id"), F.col("forward_question").alias("question"), F.col("forward_path").alias("positive_path"),
        F.col("backward_path").alias("negative_path"), F.col("backward_question").alias("negative_question"), "split", "kg", F.array(F.concat("relation", F.lit("::forward"))).alias("sequence"),
        F.col("forward_id"), F.col("backward_id"),
    )


def both_directions(examples: DataFrame) -> DataFrame:
    """Direction examples and, for each, the one asked the other way round (its id ends in ``:backward``)."""
    turned = examples.select(
        F.concat("example_id", F.lit(":backward")).alias("example_id"), F.col("negative_question").alias("question"), F.col("negative_path").alias("positive_path"), F.col("positive_path").alias("negative_path"),
        F.col("question").alias("negative_question"), "split", "kg", F.transform("sequence", lambda s: F.regexp_replace(s, "::forward$", "::backward")).alias("sequence"), F.col("backward_id").alias("forward_id"), F.col("forward_id").alias("backward_id"),
    )
    return examples.unionByName(turned)


def merged(base: DataFrame, extra: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """``base`` with the rows of ``extra`` that have no ``reason`` against them, and the others with theirs."""
    x = extra.withColumn("_reason", reason)
    return base.unionByName(x.where("_reason is null").drop("_reason"), allowMissingColumns=True), x.where("_reason is not null").withColumnRenamed("_reason", "reason")
