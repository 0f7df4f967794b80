"""Mixing sources to target weights by distributed prefix sums.

Every document gets a hash-random key; within each source the documents are range-sorted by
that key, so a source holding most of the rows still spreads over all partitions. Running
token sums inside each partition plus the totals of the partitions before it (one row per
partition and target source) give each document's place in its source. A source takes whole
epochs while its budget allows, up to its repeat cap; the last epoch is cut where the
remaining budget ends. The document on the cut is taken when at least half of it lies within
the budget, so a source misses its budget by half a document at most; the report says by
how much. Documents are rows: rows of one id are several documents.

Budget: target share times the tokens of all documents given. Documents of sources without
a target, or with a null source, are in no mixture but count in the total. A source without
documents has an actual size of 0. Null and empty texts have no tokens and are never taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

MAX_SOURCES = 10_000


def prefix_sums(sized: DataFrame, parts: int, seed: int = 29) -> DataFrame:
    """Adds ``before``: the tokens of the documents before this one in its source's random order."""
    import numpy as np
    import pyarrow as pa

    kept = sized.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("rnd"))
    schema = T.StructType([*kept.schema.fields, T.StructField("local", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, int] = {}
        for b in batches:
            names, n = b.column(1).to_pylist(), b.column(2).to_numpy()
            local = np.empty(len(names), np.int64)
            start = 0
            for i in range(1, len(names) + 1):  # runs of one source, as the partition is sorted
                if i == len(names) or names[i] != names[start]:
                    sums = np.cumsum(n[start:i]) + last.get(names[start], 0)
                    local[start:i] = sums - n[start:i]
                    last[names[start]] = int(sums[-1])
                    start = i
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(local)], names=schema.fieldNames())

    ordered = kept.repartitionByRange(parts, "source", "rnd", "doc_id").sortWithinPartitions("source", "rnd", "doc_id")
    local = materialize(ordered.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "prefix")
    totals = local.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
    offset = totals.select("source", "part", (F.sum("tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("tokens")).alias("offset"))
    return local.join(F.broadcast(offset), ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("local") + F.col("offset")).alias("before"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """Mixture and report from ``sized(doc_id, source, n_tokens)`` and ``targets(source, target_share, max_repeats)``.

    Returns ``(doc_id, source, n_tokens, copies)`` of the documents taken and
    ``(source, target_share, actual_share, share_of_mixture, target_tokens, actual_tokens, gap_tokens,
    source_tokens, documents, epochs, max_repeats)`` with a row for every target.
    """
    spark = sized.sparkSession
    plan = targets.limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; merge small ones first")
    sized = materialize(sized.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")), "sized")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = {r["source"]: r for r in plan if r["source"] is not None}
    budgets = spark.createDataFrame([(s, float(r["target_share"] or 0) * total, int(r["max_repeats"] or 0)) for s, r in wanted.items()], "source string, budget double, cap int")
    mine = sized.join(F.broadcast(budgets), "source", "left_semi").where("n_tokens > 0")
    placed = prefix_sums(mine, int(spark.conf.get("spark.sql.shuffle.partitions")), seed)
    sizes = mine.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    plans = budgets.join(sizes, "source").withColumn("full", F.least(F.floor(F.col("budget") / F.col("source_tokens")), F.col("cap")).cast("int"))
    rest = F.col("budget") - F.col("full") * F.col("source_tokens")
    inside = (F.col("full") < F.col("cap")) & (2 * (rest - F.col("before")) >= F.col("n_tokens"))
    copies = (F.col("full") + inside.cast("int")).alias("copies")
    taken = materialize(placed.join(F.broadcast(plans), "source").select("doc_id", "source", "n_tokens", copies).where("copies > 0"), "mixture")
    actual = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("epochs"))
    report = budgets.join(sizes, "source", "left").join(actual, "source", "left").na.fill(0)
    mixture = F.sum("actual_tokens").over(Window.partitionBy())
    shares = spark.createDataFrame([(s, float(r["target_share"] or 0)) for s, r in wanted.items()], "source string, target_share double")
    return taken, report.join(shares, "source").select(
        "source",
        "target_share",
        F.try_divide("actual_tokens", F.lit(float(total))).alias("actual_share"),
        F.try_divide("actual_tokens", mixture).alias("share_of_mixture"),
        F.col("budget").alias("target_tokens"),
        "actual_tokens",
        (F.col("budget") - F.col("actual_tokens")).alias("gap_tokens"),
        "source_tokens",
        "documents",
        "epochs",
        F.col("cap").alias("max_repeats"),
    )
