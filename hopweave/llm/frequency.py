"""Frequency of every distinct term: dictionary encoding and blockwise count arrays.

Input: one row per record with one array of terms per field. Records are told apart by
their id; a row that repeats id and terms counts once, and rows of one id with other terms
are one record whose occurrences add up. Null record ids, null arrays and null terms hold
nothing; the empty text is a term. An empty input gives no rows. Extra columns are ignored.

Steps: (1) count terms of each record, linear in its terms (partial counts leave a task as
one row per record and term); (2) add up per block of records, so that a hot
term leaves a block as one row; (3) build a global integer dictionary by a range sort of
the distinct terms, ids being the range's offset plus the place in it; (4) encode the block
counts (a term has at most one row per block, so the join has no hot key) into arrays per
block and identifier range; (5) sum the arrays of each range. No step's memory grows with
the number of records: an array covers one identifier range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCKS = 64
RANGE = 4096


def dictionary(terms: DataFrame) -> DataFrame:
    """``field_name, term, term_id``: dense ids from 0 in the order of (field_name, term)."""
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(terms.distinct().repartitionByRange(parts, "field_name", "term").withColumn("part", F.spark_partition_id()), "dictionary")
    sizes = placed.groupBy("part").count()  # one row per partition
    from pyspark.sql import Window

    offsets = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("field_name", "term")) - 1
    return placed.select("field_name", "term", "part", place.alias("place")).join(F.broadcast(offsets), "part").select("field_name", "term", (F.col("offset") + F.col("place")).alias("term_id"))


def term_counts(records: DataFrame, record_id: str, fields: dict[str, Column], blocks: int = BLOCKS, id_range: int = RANGE) -> tuple[DataFrame, int]:
    """``field_name, term, term_id, occurrences, records`` and the number of distinct records."""
    names = list(fields)

    def paired(name: str) -> Column:
        terms = F.coalesce(F.col(f"`{name}`"), F.array().cast("array<string>"))
        return F.transform(terms, lambda t: F.struct(F.lit(name).alias("field_name"), t.alias("term")))

    listed = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("record_id"), *[fields[n].alias(n) for n in names])
    kept = materialize(listed.select("record_id", F.filter(F.concat(*map(paired, names)), lambda x: x["term"].isNotNull()).alias("x")).distinct(), "terms")
    total = kept.select("record_id").distinct().count()
    per_record = kept.select("record_id", F.explode("x").alias("t")).groupBy("record_id", "t.field_name", "t.term").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("record_id"), F.lit(blocks)).cast("int").alias("block")
    block_counts = materialize(per_record.groupBy(block, "field_name", "term").agg(F.sum("n").cast("long").alias("occurrences"), F.count("*").alias("records")), "block-counts")
    ids = materialize(dictionary(block_counts.select("field_name", "term")), "dictionary-ids")
    coded = block_counts.join(ids, ["field_name", "term"]).select("block", "term_id", "occurrences", "records")
    span = F.col("term_id").cast("long")
    arrays = coded.groupBy("block", F.floor(span / id_range).alias("span")).agg(
        F.collect_list((span % id_range).cast("int")).alias("at"), F.collect_list("occurrences").alias("occurrences"), F.collect_list("records").alias("records")
    )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        occ, rec = np.zeros(id_range, np.int64), np.zeros(id_range, np.int64)
        for at, o, r in zip(group["at"], group["occurrences"], group["records"], strict=True):
            occ[at] += o  # a block names an id once
            rec[at] += r
        at = np.flatnonzero(rec)
        return pd.DataFrame({"term_id": int(group["span"].iloc[0]) * id_range + at, "occurrences": occ[at], "records": rec[at]})

    summed = arrays.groupBy("span").applyInPandas(add, "term_id long, occurrences long, records long")
    return ids.join(summed, "term_id").select("field_name", "term", "term_id", "occurrences", "records"), total


def marked(counts: DataFrame, total: int, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: rare, common or null. Rare wins where both hold (tiny collections)."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_share * total), "common"))
