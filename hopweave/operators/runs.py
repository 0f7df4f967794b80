"""Runs of selection experiments: loading with guards, pool fingerprints, comparisons of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranking


def pool_fingerprints(pools: DataFrame, question: str = "question_id", position: str = "position", sequence: str = "sequence") -> DataFrame:
    """``question, n, fingerprint``: SHA-256 of a question's candidates in order of position, then sequence."""
    entry = F.struct(F.col(position).cast("long").alias("p"), F.array_join(F.coalesce(sequence, F.array().cast("array<string>")), "|").alias("s"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(":", e["p"].cast("string"), e["s"]))
    return pools.groupBy(question).agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def require_same(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raises unless both sides have the same rows of ``keys``; names a few that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    odd = a.join(b, on, "left_anti").limit(3).collect() + b.join(a, on, "left_anti").limit(3).collect()
    if odd:
        raise ValueError(f"the runs differ in their {what}, e.g. {[tuple(r) for r in odd]}")


@dataclass
class Run:
    """A run: its kind, ``picks(question_id, position, sequence, exact, f1)`` and ``pools(question_id, position, sequence, score)``."""

    name: str
    kind: str
    picks: DataFrame
    pools: DataFrame
    metrics: dict


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_PICKS = "question_id string, candidate_index int, relation_sequence array<string>, exact_match double, f1 double"
_SCORES = "question_id string, candidates array<struct<candidate_index: int, relation_sequence: array<string>, score: double>>"
_PREDICTIONS = "example_id string, candidates array<struct<path: struct<hops: array<struct<relation: string, direction: string>>>, is_positive: boolean, cross_encoder_score: double>>"


def load_run(spark: SparkSession, folder: str) -> Run:
    """Reads a run's folder: ``metrics.json`` with ``picks.jsonl`` and ``scores.jsonl``, or with ``predictions.jsonl``.

    Picks of predictions are the best scores (the first of equals), exact and F1 being whether
    the pick is a positive. A folder without the files is an error.
    """
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    if not _there(spark, f"{folder}/metrics.json"):
        raise FileNotFoundError(f"{folder} has no metrics.json")
    import json

    metrics = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/metrics.json", wholetext=True).collect()))
    if _there(spark, f"{folder}/picks.jsonl") and _there(spark, f"{folder}/scores.jsonl"):
        p = spark.read.schema(_PICKS).json(f"{folder}/picks.jsonl")
        picks = p.select("question_id", F.col("candidate_index").alias("position"), F.col("relation_sequence").alias("sequence"), F.col("exact_match").alias("exact"), "f1")
        pools = spark.read.schema(_SCORES).json(f"{folder}/scores.jsonl").select("question_id", F.explode("candidates").alias("c")).select("question_id", F.col("c.candidate_index").alias("position"), F.col("c.relation_sequence").alias("sequence"), "c.score")
        return Run(name, "answer_selection", picks, pools, metrics)
    if not _there(spark, f"{folder}/predictions.jsonl"):
        raise FileNotFoundError(f"{folder} has neither picks.jsonl with scores.jsonl nor predictions.jsonl")
    c = spark.read.schema(_PREDICTIONS).json(f"{folder}/predictions.jsonl").select(F.col("example_id").alias("question_id"), F.posexplode("candidates").alias("position", "c"))
    seq = F.coalesce(F.transform("c.path.hops", lambda h: F.concat_ws("::", h["relation"], h["direction"])), F.array().cast("array<string>"))
    pools = c.select("question_id", "position", seq.alias("sequence"), F.col("c.cross_encoder_score").alias("score"), F.coalesce("c.is_positive", F.lit(False)).cast("double").alias("exact"))
    picks = ranking.keep_first(pools, ["question_id"], [F.col("score").desc_nulls_last(), F.col("position")]).select("question_id", "position", "sequence", "exact", F.col("exact").alias("f1"))
    return Run(name, "candidate_ranking", picks, pools.drop("exact"), metrics)


def comparable(runs: list[Run]) -> None:
    """Raises unless the runs are of one kind, over the same questions and the same candidate pools."""
    if len(runs) < 2:
        raise ValueError("two runs or more are needed")
    if len({r.kind for r in runs}) > 1:
        raise ValueError("runs of different kinds cannot be compared")
    first = pool_fingerprints(runs[0].pools)
    for r in runs[1:]:
        require_same(runs[0].picks, r.picks, ["question_id"], "questions")
        require_same(first, pool_fingerprints(r.pools), ["question_id", "fingerprint"], "candidate pools")


def answer_equivalent(labelled: DataFrame) -> DataFrame:
    """Candidates that reach the gold answers by a path nobody annotated (see ``corpus.label_candidates``)."""
    return labelled.where(F.col("denotation") & ~F.col("annotated"))


def pair_means(pairs: DataFrame, kind: str, values: list[str | Column]) -> DataFrame:
    """Pairs and mean values by kind; nulls are left out of a mean, which is null where nothing is left."""
    return pairs.groupBy(kind).agg(F.count("*").alias("pairs"), *[F.avg(x).alias(f"mean_{x}") for x in values])
