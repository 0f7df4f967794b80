"""Exact nearest neighbours by cosine of a stated query set against all rows, in blocks.

Rows are cut into parts and queries into blocks of bounded size; every pair of a part and a
block is one matrix product that keeps the best ``k`` of each query. Nothing is broadcast and
no pair of rows is emitted beyond ``k`` per query and part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 50_000
BLOCK_QUERIES = 2_000


def cosine_topk(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, id, cosine, rank`` of the ``k`` nearest rows of each query, itself left out.

    Both sides have ``id, vector array<float>``. Vectors that are null, have a null, no length
    or another dimension than the first of their part and block match nothing. Cosines are
    rounded to ``digits``; ties go to the smaller id.
    """
    sound = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    r, q = rows.where(sound).select("id", "vector"), queries.where(sound).select(F.col("id").alias("query_id"), "vector")
    n_rows, n_queries = r.count(), q.count()
    kind = rows.schema["id"].dataType.simpleString()
    out = f"query_id {kind}, id {kind}, cosine double"
    if not n_rows or not n_queries:
        found = rows.sparkSession.createDataFrame([], out)
    else:
        parts, blocks = -(-n_rows // part_rows), -(-n_queries // block_queries)
        parts = max(parts, min(-(-n_rows // 1_000), 2 * rows.sparkSession.sparkContext.defaultParallelism))
        number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = r.withColumn("part", number("id", parts)).withColumn("block", every(blocks))
        theirs = q.withColumn("block", number("query_id", blocks)).withColumn("part", every(parts))

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": [], "id": [], "cosine": []})
            if a.empty or b.empty:
                return none
            width = len(b["vector"].iloc[0])
            a, b = (x[[len(v) == width for v in x["vector"]]].reset_index(drop=True) for x in (a, b))
            if a.empty or b.empty:
                return none
            x, y = (np.stack(z["vector"].to_numpy()).astype(np.float64) for z in (a, b))
            nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            ids = a["id"].to_numpy()
            rows_out = []
            for i in range(len(y)):  # one query at a time bounds memory by the part
                with np.errstate(invalid="ignore", divide="ignore"):
                    c = np.round((x @ y[i]) / (nx * ny[i]), digits)
                c[(ids == b["query_id"].iloc[i]) | ~np.isfinite(c)] = -np.inf
                top = np.lexsort((ids, -c))[:k]
                top = top[np.isfinite(c[top])]
                rows_out.append(pd.DataFrame({"query_id": b["query_id"].iloc[i], "id": ids[top], "cosine": c[top]}))
            return pd.concat(rows_out)

        found = mine.groupBy("part", "block").cogroup(theirs.groupBy("part", "block")).applyInPandas(best, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
