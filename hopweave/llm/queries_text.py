"""Registered queries over texts: defects (p4), leaks (p6), mixing (p7) and splitting (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import defects, fold, leaks, mixing, splitting, tokens


def _responses(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "path_naturalizations").where(F.coalesce(fold.trimmed("status"), F.lit("")) != "opaque")
    a = items.select(F.lit("path_naturalizations").alias("table_name"), F.col("row_id").alias("row_key"), F.col("canonical_question").alias("prompt"), F.col("question").alias("response"))
    b = table(spark, d, "candidates").select(F.lit("candidates").alias("table_name"), F.col("candidate_id").alias("row_key"), F.col("path_text").alias("prompt"), F.col("generated_question").alias("response"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(_responses(spark, d)).select("table_name", "row_key", "defect")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(_responses(spark, d)).groupBy("table_name", "defect").agg(F.count("*").alias("responses"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that carry them and the longest stretch."""
    return _leaked(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("n_words").alias("longest"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", fold.source("source").alias("source"), "text")
    targets = table(spark, d, "source_targets").select(fold.source("source").alias("source"), "target_share", "max_repeats")
    return mixing.mix(tokens.count_tokens(docs), targets)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), with_text=False).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_pieces)}
SQL: dict[str, str] = {}
