"""Candidate paths of questions: executable patterns, best retrieved families, gold availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize
from . import graph, ranking


def path_words(sequence: Column) -> Column:
    """Distinct words of the relations of a sequence of ``relation::direction``."""
    words = F.transform(sequence, lambda k: text.tokens(text.relation_words(F.regexp_replace(k, "::(forward|backward)$", ""))))
    return F.array_distinct(F.flatten(words))


def lexical_path_score(question: Column, sequence: Column) -> Column:
    """Share of a path's words that the question has; 0 for a path without words."""
    own, asked = path_words(sequence), F.array_distinct(text.tokens(F.coalesce(question, F.lit(""))))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, asked)), F.size(own)), F.lit(0.0))


def executable_patterns(edge: DataFrame, anchors: DataFrame, gold: DataFrame, questions: DataFrame, cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Relation sequences that run in a question's graph, up to the length of its longest gold sequence.

    ``anchors(question_id, node)``, ``gold(question_id, sequence)``, ``questions(question_id,
    question)``. The ``cap`` best by words shared with the question (then shorter, then later
    in order) are kept: ``question_id, sequence, score, rank, is_gold`` of the questions that
    keep a gold sequence, the others being distractors; and one row ``questions,
    gold_in_graph, gold_after_cap, average_candidates``. Type edges are no steps; a question
    without gold, anchor or graph has no patterns and does not count.
    """
    gold = materialize(gold.select("question_id", "sequence").where("size(sequence) > 0").distinct(), "gold")
    limits = gold.groupBy("question_id").agg(F.max(F.size("sequence")).alias("limit"))
    longest = limits.agg(F.max("limit")).first()[0] or 0
    step = edge.where(F.col("relation") != graph.TYPE_RELATION).select("question_id", "src", text.directed("relation", "direction").alias("key"), "dst")
    inside = edge.select("question_id").distinct()
    level = anchors.select("question_id", F.col("node").alias("src")).distinct().join(limits, "question_id").join(inside, "question_id", "left_semi").select("question_id", "limit", "src", F.array("src").alias("nodes"), F.array().cast("array<string>").alias("sequence"))
    found = level.select("question_id", "sequence")
    for k in range(longest):
        level = level.where(F.col("limit") > k).join(step, ["question_id", "src"]).where(~F.array_contains("nodes", F.col("dst"))).select("question_id", "limit", F.col("dst").alias("src"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("sequence", F.col("key")).alias("sequence"))
        if k % 3 == 2:
            level = materialize(level, "patterns")
        found = found.unionByName(level.select("question_id", "sequence"))
    asked = materialize(found.distinct(), "found")
    sequences = asked.where("size(sequence) > 0").join(gold.withColumn("is_gold", F.lit(True)), ["question_id", "sequence"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    scored = sequences.join(questions.select("question_id", "question"), "question_id", "left").select("question_id", "sequence", "is_gold", lexical_path_score(F.col("question"), F.col("sequence")).alias("score"))
    order = [F.desc("score"), F.size("sequence"), F.array_join("sequence", "|").desc()]
    kept = materialize(ranking.top_k(scored, ["question_id"], order, cap, "rank"), "kept")
    with_gold = kept.where("is_gold").select("question_id").distinct()
    per = asked.groupBy("question_id").agg(F.count_if(F.size("sequence") > 0).alias("n"))
    hit = sequences.where("is_gold").select("question_id").distinct().withColumn("hit", F.lit(True))
    counts = per.join(hit, "question_id", "left").join(with_gold.withColumn("held", F.lit(True)), "question_id", "left")
    summary = counts.agg(F.count("*").alias("questions"), F.count_if("hit").alias("gold_in_graph"), F.count_if("held").alias("gold_after_cap"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_candidates"))
    return kept.join(with_gold, "question_id", "left_semi").select("question_id", "sequence", "score", "rank", "is_gold"), summary


def best_families(scored: DataFrame, cap: int = 200) -> DataFrame:
    """Each (question, anchor, sequence) with answers once, at its best score, the ``cap`` best of a question.

    ``scored(question_id, anchor, sequence, score, answers)``; adds ``rank``. Ties go by anchor, then sequence.
    """
    ran = scored.where((F.size("sequence") > 0) & (F.size("answers") > 0))
    path = F.array_join("sequence", "|")
    best = ranking.keep_first(ran.withColumn("_p", path), ["question_id", "anchor", "_p"], [F.col("score").desc_nulls_last(), F.array_join(F.array_sort("answers"), "|")])
    return ranking.top_k(best, ["question_id"], [F.col("score").desc_nulls_last(), F.col("anchor"), F.col("_p")], cap).drop("_p")


def gold_available(edge: DataFrame, topics: DataFrame, gold: DataFrame) -> DataFrame:
    """``question_id, available``: does some gold sequence reach anything from some topic of its question?"""
    pairs = topics.select("question_id", F.col("node").alias("anchor")).distinct().join(gold.select("question_id", "sequence").where("size(sequence) > 0").distinct(), "question_id")
    paths, longest = graph.stage_paths(pairs.withColumn("path_id", F.concat_ws("|", "anchor", F.array_join("sequence", "|"))))
    ends = graph.frontiers(edge, paths, longest).where("step > 0").select("question_id", "path_id", "step").distinct()
    reached = ends.join(paths.select("question_id", "path_id", F.size("sequence").alias("step")), ["question_id", "path_id", "step"]).select("question_id").distinct().withColumn("available", F.lit(True))
    return gold.select("question_id").distinct().join(reached, "question_id", "left").select("question_id", F.coalesce("available", F.lit(False)).alias("available"))
