"""Sources and sinks: JSON lines, JSON documents, coded graphs, knowledge bases, prompts, results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

TRIPLE = "struct<head:string,relation:string,tail:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = False) -> DataFrame:
    """One JSON object per line under an explicit schema; blank lines are skipped."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_keyed_document(spark: SparkSession, path: str, rows: str | None, key: str, schema: str) -> DataFrame:
    """Rows of one JSON document (a list, or a list under ``rows``) keyed by ``key``; the last of a key wins."""
    if rows:
        doc = spark.read.schema(f"{rows} array<{schema}>").json(path, multiLine=True).select(F.posexplode(rows).alias("_at", "_row"))
    else:
        doc = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{schema}>")).alias("_at", "_row"))
    w = Window.partitionBy(f"_row.{key}").orderBy(F.col("_at").desc())
    return doc.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_row.*")


GLOSSARY = "struct<status:string,description:string,subject_role:string,object_role:string,fact_template:string,confidence:double>"


def read_glossary(spark: SparkSession, path: str | None) -> DataFrame:
    """``relation_key`` with its entry from one JSON object of entries; no path gives an empty glossary.

    A missing file and a document that is no object are errors.
    """
    fields = "status string, description string, subject_role string, object_role string, fact_template string, confidence double"
    if path is None:
        return spark.createDataFrame([], f"relation_key string, {fields}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{GLOSSARY}>").alias("m"), F.ltrim("value").startswith("{").alias("object"))
    sure = F.when(F.col("object") & F.col("m").isNotNull(), F.col("m")).otherwise(F.raise_error(F.lit("the glossary is no JSON object")).cast(f"map<string,{GLOSSARY}>"))
    return doc.select(F.explode(sure).alias("relation_key", "e")).select("relation_key", "e.*")


def read_benchmark(spark: SparkSession, paths: list[str], schema: str | T.StructType, order: str = "example_id") -> DataFrame:
    """Rows of several JSON lines files as one benchmark, sorted by id."""
    out = read_jsonl(spark, paths[0], schema)
    for p in paths[1:]:
        out = out.unionByName(read_jsonl(spark, p, schema))
    return out.orderBy(order)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary of a file of names, one a line: ``code, name`` from 0.

    The code is the line's number over the whole file, which no column expression gives; this
    is the one place that goes through an RDD, and it reads the file in splits.
    """
    numbered = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(numbered, "code long, name string").where("name <> ''")


def decode_graphs(rows: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Coded graphs ``(id, question, entities, answers, subgraph.tuples)`` with names in place of codes.

    Names are joined on codes; positions keep the order of the file. A code without a name is an error.
    """
    e, r = entities, relations
    t = rows.select("id", F.posexplode("subgraph.tuples").alias("at", "t")).select("id", "at", F.col("t")[0].alias("h"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))
    named = (
        t.join(e.select(F.col("code").alias("h"), F.col("name").alias("head")), "h", "left")
        .join(r.select(F.col("code").alias("r"), F.col("name").alias("relation")), "r", "left")
        .join(e.select(F.col("code").alias("o"), F.col("name").alias("tail")), "o", "left")
    )
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a code has no {c}")).cast("string"))
    graph = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", need("head").alias("head"), need("relation").alias("relation"), need("tail").alias("tail")))).alias("g"))
    graph = graph.select("id", F.transform("g", lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"))).alias("triples"))
    topics = rows.select("id", F.posexplode("entities").alias("at", "code")).join(e, "code").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n")).select("id", F.transform("n", lambda x: x["name"]).alias("topic_entities"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    gold = F.transform("answers", lambda a: a["kb_id"])
    return rows.select("id", "question", none(gold, "array<string>").alias("gold_answers")).join(topics, "id", "left").join(graph, "id", "left").select(
        F.col("id").alias("question_id"), "question", none(F.col("topic_entities"), "array<string>").alias("topic_entities"), "gold_answers", none(F.col("triples"), f"array<{TRIPLE}>").alias("triples")
    )


def knowledge_base(entities: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, labels and types of a knowledge base.

    ``entities(id, name, instance_of array<string>, relations array<struct<predicate, object,
    direction>>)``, ``concepts(id, name)``. A backward relation states its triple the other
    way round; triples are a set, and both ends need a label. Types are the distinct names of
    an entity's concepts joined by `` / ``.
    """
    labels = entities.select(F.col("id").alias("node"), F.col("name").alias("label")).unionByName(concepts.select(F.col("id").alias("node"), F.col("name").alias("label"))).where("label is not null").dropDuplicates(["node"])
    r = entities.select("id", F.explode("relations").alias("r"))
    back = F.col("r.direction") == "backward"
    t = r.select(F.when(back, F.col("r.object")).otherwise(F.col("id")).alias("head"), F.col("r.predicate").alias("relation"), F.when(back, F.col("id")).otherwise(F.col("r.object")).alias("tail")).distinct()
    known = labels.select("node")
    triples = t.join(known.withColumnRenamed("node", "head"), "head", "left_semi").join(known.withColumnRenamed("node", "tail"), "tail", "left_semi")
    types = entities.select("id", F.explode("instance_of").alias("c")).join(concepts.select(F.col("id").alias("c"), "name"), "c").groupBy(F.col("id").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("name")), " / ").alias("type"))
    return triples.select("head", "relation", "tail"), labels, types


def wanted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def parse_results(lines: DataFrame, schema: str, id_field: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """Good and bad results from ``lines(file, line_no, value)``; of one id the last file and line counts.

    A line is good when it parses as an object that has the id.
    """
    p = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    ok = F.col("r").isNotNull() & F.col(f"r.{id_field}").isNotNull()
    bad = p.where(~F.coalesce(ok, F.lit(False))).select("file", "line_no", "value")
    w = Window.partitionBy(f"r.{id_field}").orderBy(F.col("file").desc(), F.col("line_no").desc())
    good = p.where(ok).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("r.*")
    return good, bad


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns their number, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def write_document(df: DataFrame, path: str) -> None:
    """A metrics table of one row as an indented JSON document, in whatever file system the path names."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a document needs exactly one row")
    text = json.dumps(row[0].asDict(True), ensure_ascii=False, indent=2, default=str)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


def _fill(sizes: list[int], cap: int, chunk: int, used: int) -> tuple[list[int], int, int]:
    """Chunk of each item in sequence, and the state after the last."""
    out = []
    for n in sizes:
        if used and used + n > cap:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk)
    return out, chunk, used


def _ways_through(sizes: list[int], cap: int) -> list[tuple[int, int, int]]:
    """What a part does to the state it is entered with: ``(least used, more chunks, used after)`` by falling ``least used``.

    Entered with ``used``, the first row whose ``least used`` is not above it applies. The last
    row stands for no new chunk at all, its ``used after`` being the part's sum to add.
    """
    import numpy as np

    n = len(sizes)
    s = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    more, after = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):  # a chunk that starts at item i
        j = max(int(np.searchsorted(s[1:], s[i] + cap, side="right")), i + 1)
        if j < n and s[j] == s[i]:  # an empty chunk takes any item
            j += 1
        more[i], after[i] = (0, int(s[n] - s[i])) if j >= n else (1 + more[j], after[j])
    rows = [(0, more[0] if n else 0, after[0] if n else 0)]  # entered empty: as a chunk that starts here
    best = cap + 2
    for i in range(n):
        least = max(1, int(cap - s[i + 1] + 1))
        if least < best:
            rows.append((least, 1 + more[i], after[i]))
            best = least
        if least == 1:
            break
    return rows + [(-1, 0, int(s[n]))]


def pack_chunks(requests: DataFrame, size: str, order: str, cap: int) -> DataFrame:
    """Numbers chunks of requests in order so that each stays within ``cap``: adds ``chunk`` (an item above it has one to itself).

    Filling in sequence depends on all that came before, so it goes in three steps: the rows are
    range-sorted into parts; each part tells what it does to the fill it is entered with (at most
    one row per item of a chunk's worth), the driver walks the parts; each part is numbered
    from its own start. Equal ``order`` values keep no set order. With a ``shard`` column every
    shard is a sequence by itself.
    """
    import pandas as pd

    schema = T.StructType([*requests.schema.fields, T.StructField("chunk", T.IntegerType())])
    if "shard" in requests.columns:

        def alone(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values(order, kind="stable")
            return p.assign(chunk=_fill(p[size].fillna(0).astype(int).tolist(), cap, 0, 0)[0])

        return requests.groupBy("shard").applyInPandas(alone, schema)
    spark = requests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(requests.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "placed")

    def ways(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        return pd.DataFrame(_ways_through(p[size].fillna(0).astype(int).tolist(), cap), columns=["least", "more", "after"]).assign(_part=int(p["_part"].iloc[0]))

    through: dict[int, list[tuple[int, int, int]]] = {}
    for r in placed.select(order, size, "_part").groupBy("_part").applyInPandas(ways, "least long, more long, after long, _part int").collect():
        through.setdefault(r["_part"], []).append((r["least"], r["more"], r["after"]))
    chunk, used, starts = 0, 0, []
    for n in sorted(through):
        starts.append((n, chunk, used))
        least, more, after = (0, *next(x for x in through[n] if x[0] == 0)[1:]) if used == 0 else max(x for x in through[n] if x[0] != 0 and x[0] <= used)
        chunk, used = chunk + more, used + after if least == -1 else after
    begun = placed.join(F.broadcast(spark.createDataFrame(starts, "_part int, _chunk long, _used long")), "_part")

    def number(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        got, _, _ = _fill(p[size].fillna(0).astype(int).tolist(), cap, int(p["_chunk"].iloc[0]), int(p["_used"].iloc[0]))
        return p.assign(chunk=got)[schema.fieldNames()]

    return begun.groupBy("_part").applyInPandas(number, schema)
