"""Registered queries of cross-split overlaps (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import fold, overlap


def _records(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "examples").select(F.col("example_id").alias("id"), "split", "kg", "question")
    b = table(spark, d, "question_graphs").select(F.col("question_id").alias("id"), "split", "kg", "question")
    return a.unionByName(b).select("id", fold.side("split").alias("side"), fold.trimmed("kg").alias("kg"), "question")


def _vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words of relation names and of types, from the paths and triples of the data."""
    hops = table(spark, d, "examples").select(F.explode("positive_path.hops").alias("h"))
    last = lambda c: F.split(F.substring_index(fold.relation(c), ".", -1), r"[^\p{L}]+")
    relations = hops.select(F.explode(last("h.relation")).alias("word")).union(table(spark, d, "question_graphs").select(F.explode("triples").alias("t")).select(F.explode(last("t.relation")).alias("word")))
    types = hops.select(F.explode(F.array("h.source_type", "h.target_type")).alias("t")).select(F.explode(F.split(fold.trimmed("t"), r"[^\p{L}]+")).alias("word"))
    clean = lambda x: x.where("length(word) > 1 and word not in ('entity')").distinct()
    return clean(relations), clean(types)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.expanded(*overlap.overlaps(_records(spark, d), *_vocabulary(spark, d)))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).where("id_a <> id_b").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps counted for each evaluation split and knowledge graph, from text pairs and their copies.

    ``pairs`` counts pairs of a training and an evaluation record with their texts, without writing them out.
    """
    records = _records(spark, d)
    pairs, members = overlap.overlaps(records, *_vocabulary(spark, d))
    of = records.where("side <> 'train'").select("id", "side", "kg").distinct()
    evals = members.where("not train").join(of, "id")
    grouped = evals.groupBy(F.col("key").alias("eval_key"), "side", "kg").agg(F.count("*").alias("n_eval"))
    trains = members.where("train").groupBy(F.col("key").alias("train_key")).agg(F.count("*").alias("n_train"))
    met = pairs.join(grouped, "eval_key").join(trains, "train_key")
    n = met.groupBy("side", "kg").agg(F.sum(F.col("n_eval") * F.col("n_train")).alias("pairs"))
    who = pairs.select("eval_key").distinct().join(evals.withColumnRenamed("key", "eval_key"), "eval_key").groupBy("side", "kg").agg(F.countDistinct("id").alias("eval_records"))
    whom = met.select("train_key", "side", "kg").distinct().join(members.where("train").withColumnRenamed("key", "train_key"), "train_key").groupBy("side", "kg").agg(F.countDistinct("id").alias("train_records"))
    on = lambda x: F.col("n.side").eqNullSafe(F.col(f"{x}.side")) & F.col("n.kg").eqNullSafe(F.col(f"{x}.kg"))
    return n.alias("n").join(who.alias("w"), on("w")).join(whom.alias("t"), on("t")).select("n.side", "n.kg", "pairs", "eval_records", "train_records")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts)}
SQL: dict[str, str] = {}
