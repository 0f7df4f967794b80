"""Budgeted beam search for query programs, level by level as joins over all questions at once.

A program is a walk from a topic with conditions on the way: its last variable is the answer,
so the set of that variable's values is all a next step needs. A level joins the values of
the programs in the beam with their questions' edges, which gives every extension with its
values in one pass; relevance and score are columns, the budget and the beam are ranks inside
a question. No question is a Python group, and a question holds at most its budget of states.

Ties go to the program that stood first: a beam's stop before its extensions, extensions by
relevance, then by their steps. A null question has no words; null topics or triples leave
nothing to search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize

Scorer = Callable[[str, list[str]], list[float]]


def lexical_score(words: Column, own: Column) -> Column:
    """Words that question and program text share, over the geometric mean of their numbers (at least 1)."""
    return F.size(F.array_intersect(words, own)) / F.greatest(F.sqrt((F.size(words) * F.size(own)).cast("double")), F.lit(1.0))


def _scored(states: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Adds ``score``; a scorer gets each question's texts of an Arrow batch at once.

    The words of a program's text are kept with it, so only a new step's words are looked up.
    """
    if scorer is None:
        rest = F.array(F.lit("answer"), F.lit("variable"), F.expr("substring(select, 2)"))
        own = F.array_distinct(F.concat("line_words", rest, F.when(F.col("finished"), F.array(F.lit("finish"))).otherwise(F.array().cast("array<string>"))))
        return states.withColumn("score", lexical_score(F.col("words"), own))
    end = F.concat(F.lit("\nanswer variable: "), F.col("select"), F.when(F.col("finished"), "\n[FINISH]").otherwise(""))
    states = states.withColumn("described", F.concat(F.array_join("lines", "\n"), end))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            out = pd.Series(0.0, index=q.index)
            for question, at in q.fillna("").groupby(q.fillna("")).groups.items():
                out[at] = scorer(question, p[at].tolist())
            yield out

    return states.withColumn("score", score("question", "described")).drop("described")


def _relation_text(relation: Column) -> Column:
    return F.translate(F.regexp_extract(relation, r"([^.]*\.)?[^.]*$", 0), "._", "  ")


def _relevance() -> Column:
    return F.size(F.array_intersect("words", "relation_words")) / F.greatest(F.size("relation_words"), F.lit(1))


def _step(forward: Column, node: Column, other: Column) -> Column:
    """The atom of a step from ``node`` over ``relation`` to ``other``."""
    return F.struct(F.col("relation").alias("r"), F.when(forward, node).otherwise(other).alias("h"), F.when(forward, other).otherwise(node).alias("t"))


def _line(forward: Column, node: Column, other: Column) -> Column:
    by = F.concat(F.lit(" --["), "relation_text", F.lit("]--> "))
    return F.when(forward, F.concat(node, by, other)).otherwise(F.concat(other, by, node))


def _ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, most: int | Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


_STATE = ["question_id", "question", "words", "atoms", "select", "nodes", "lines", "line_words", "relation_words"]


def search_programs(graphs: DataFrame, scorer: Scorer | None = None, beam: int = 10, max_hops: int = 4, cap: int = 500, per_state: int = 50) -> DataFrame:
    """Best program of every question of ``graphs(question_id, question, topic_entities, triples)``.

    Every level scores the stop at each program of the beam and its extensions, within ``cap``
    scored programs a question; a question ends when a stop ranks first, its budget is used or
    ``max_hops`` levels are done. Programs without values, or with a step from a node to
    itself, are no candidates. Gives ``question_id, atoms, select, answers, score, scored,
    rounds, finished``.
    """
    asked = materialize(graphs.select("question_id", "question", F.array_distinct(text.tokens(F.coalesce("question", F.lit("")))).alias("words"), F.array_distinct(F.filter(F.coalesce("topic_entities", F.array().cast("array<string>")), lambda t: F.coalesce(t != "", F.lit(False)))).alias("topics"), "triples"), "asked")
    t = asked.select("question_id", F.explode("triples").alias("x")).select("question_id", "x.*").where("head is not null and relation is not null and tail is not null").distinct()
    both = F.array(F.struct(F.col("head").alias("node"), F.lit(True).alias("forward"), F.col("tail").alias("other")), F.struct(F.col("tail").alias("node"), F.lit(False).alias("forward"), F.col("head").alias("other")))
    # texts and words of relations are made once for each relation, not for each program
    named = t.select("relation").distinct().withColumn("relation_text", _relation_text(F.col("relation"))).withColumn("own_words", F.array_distinct(text.tokens("relation_text")))
    step = materialize(t.join(named, "relation").select("question_id", "relation", "relation_text", "own_words", F.explode(both).alias("e")).select("question_id", "e.node", "relation", "e.forward", "e.other", F.col("relation_text"), F.col("own_words")), "steps")
    topics = asked.select("question_id", F.posexplode("topics").alias("place", "topic")).select("question_id", "topic", (F.col("place") + 1).cast("string").alias("number")).select("*", F.concat(F.lit("ANCHOR_"), "number").alias("anchor"))
    forward, variable = F.col("forward"), F.lit("?x")
    own_words = F.col("own_words")
    topic_words = lambda: F.array(F.lit("anchor"), F.col("number"))

    begun = topics.withColumnRenamed("topic", "node").join(step, ["question_id", "node"]).groupBy("question_id", "node", "anchor", "number", "relation", "relation_text", "forward").agg(F.collect_set("other").alias("nodes"), F.max(F.col("other") == F.col("node")).alias("loop"), F.first("own_words").alias("own_words")).where("not loop")
    first = begun.join(asked.select("question_id", "question", "words"), "question_id").select(
        "question_id", "question", "words", F.array(_step(forward, F.col("node"), variable)).alias("atoms"), variable.alias("select"), "nodes",
        F.array(_line(forward, F.col("anchor"), variable)).alias("lines"), F.array_distinct(F.concat(own_words, topic_words(), F.array(F.lit("x")))).alias("line_words"), own_words.alias("relation_words"),
    )
    first = _ranked(first.withColumn("relevance", _relevance()), ["question_id"], [F.desc("relevance"), F.col("atoms")], "place", cap)
    scored = _scored(first.withColumn("finished", F.lit(False)), scorer).withColumn("scored", F.count("*").over(Window.partitionBy("question_id")).cast("int"))
    front = materialize(_ranked(scored, ["question_id"], [F.desc("score"), F.col("place")], "rank", beam).select(*_STATE, "rank", "score", "scored", F.lit(1).alias("rounds")), "beam")
    done: list[DataFrame] = []
    for level in range(2, max_hops + 1):
        done.append(front.where((F.col("scored") >= cap) & (F.col("rank") == 1)).withColumn("finished", F.lit(False)))
        going = front.where(F.col("scored") < cap)
        # laid out by question once: the groups, ranks and counts below all lie inside a question
        met = going.select("question_id", "rank", F.explode("nodes").alias("node")).join(step, ["question_id", "node"]).repartition("question_id")
        grown = met.groupBy("question_id", "rank", "relation", "relation_text", "forward").agg(F.collect_set("other").alias("new_nodes"), F.max(F.col("other") == F.col("node")).alias("loop"), F.first("own_words").alias("own_words"))
        tied = met.join(topics.withColumnRenamed("topic", "other"), ["question_id", "other"]).groupBy("question_id", "rank", "relation", "relation_text", "forward", "other", "anchor", "number").agg(F.collect_set("node").alias("new_nodes"), F.max(F.col("other") == F.col("node")).alias("loop"), F.max(F.col("other") != F.col("node")).alias("open"), F.first("own_words").alias("own_words")).where("open").drop("open")
        null = F.lit(None).cast("string")
        options = grown.withColumn("other", null).withColumn("anchor", null).withColumn("number", null).unionByName(tied)
        is_tie = F.col("other").isNotNull()
        named = F.concat(F.lit("?v"), (F.size("atoms") + 1).cast("string"))
        # programs of one parent differ in their last step only, so that is what the order needs
        ext = going.select("question_id", "rank", "words", "atoms", "select", "relation_words").join(options, ["question_id", "rank"]).withColumn("atom", _step(forward, F.col("select"), F.coalesce("other", named)))
        ext = ext.where(~is_tie | ~F.array_contains("atoms", F.col("atom"))).withColumn("relation_words", F.array_distinct(F.concat("relation_words", own_words)))
        ext = ext.select("question_id", "rank", "relation", "forward", "relation_text", "other", "anchor", "number", "atom", "loop", "new_nodes", "own_words", _relevance().alias("relevance"))
        ext = _ranked(ext, ["question_id", "rank"], [F.desc("relevance"), F.col("atom"), is_tie.desc()], "place", per_state).where("not loop").drop("relevance", "loop")
        ext = going.drop("nodes", "score").join(ext, ["question_id", "rank"]).select(
            "question_id", "question", "words", "rank", "scored", "rounds", "place",
            F.array_append("atoms", F.col("atom")).alias("atoms"), F.when(is_tie, F.col("select")).otherwise(named).alias("select"), F.col("new_nodes").alias("nodes"),
            F.array_append("lines", _line(forward, F.col("select"), F.coalesce("anchor", named))).alias("lines"),
            F.array_distinct(F.concat("line_words", own_words, F.array(F.expr("substring(select, 2)")), F.when(is_tie, topic_words()).otherwise(F.array(F.expr("concat('v', size(atoms) + 1)"))))).alias("line_words"), F.array_distinct(F.concat("relation_words", own_words)).alias("relation_words"),
        )
        keep = [*_STATE, "rank", "scored", "rounds", "place"]
        both_kinds = going.withColumn("place", F.lit(0)).select(*keep, F.lit(True).alias("finished")).unionByName(ext.select(*keep, F.lit(False).alias("finished")))
        tried = _ranked(both_kinds, ["question_id"], [F.col("rank"), F.col("place")], "order", F.lit(cap) - F.col("scored"))
        tried = _scored(tried, scorer).withColumn("scored", (F.col("scored") + F.count("*").over(Window.partitionBy("question_id"))).cast("int")).withColumn("rounds", F.lit(level))
        best_first = Window.partitionBy("question_id").orderBy(F.desc("score"), F.col("order"))
        top = F.first("finished").over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tried = tried.withColumn("stops", top).where("stops or not finished").withColumn("rank", F.row_number().over(best_first)).where((F.col("rank") == 1) | (~F.col("stops") & (F.col("rank") <= beam)))
        tried = materialize(tried.select(*_STATE, "rank", "score", "scored", "rounds", "stops"), "beam")
        done.append(tried.where("stops").withColumn("finished", F.lit(True)).drop("stops"))
        front = tried.where("not stops").drop("stops")
    done.append(front.where("rank = 1").withColumn("finished", F.lit(False)))
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    none = F.array().cast("array<string>")
    return asked.select("question_id").join(best.drop("question", "words"), "question_id", "left").select(
        "question_id",
        F.transform("atoms", lambda a: F.concat_ws(" ", a["h"], a["r"], a["t"])).alias("atoms"),
        "select",
        F.coalesce(F.array_sort("nodes"), none).alias("answers"),
        "score",
        F.coalesce("scored", F.lit(0)).alias("scored"),
        F.coalesce("rounds", F.lit(0)).alias("rounds"),
        F.coalesce("finished", F.lit(False)).alias("finished"),
    )
