"""Views over the driver's tables that several queries share, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

_SPACE = r"^[\s 　]+|[\s 　]+$"


def fold(c: Column | str) -> Column:
    """Relation spelling: trimmed, lower case, no leading ``ns:``."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, _SPACE, "")), "^ns:", "")


def sql_fold(c: str) -> str:
    return f"regexp_replace(lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '^ns:', '')"


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row per key; of rows that differ, the one with the smallest hash of its content, on every run the same."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("_r")).select("_r.*")


def graphs(spark: SparkSession, d: str) -> DataFrame:
    """One row per released question graph (rows delivered twice count once)."""
    g = one_each(table(spark, d, "question_graphs"), "question_id")
    return g.withColumn("triples", F.transform("triples", lambda t: F.when(t.isNotNull(), t.withField("relation", fold(t["relation"])))))


def triples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "question_graphs").select("question_id", F.explode("triples").alias("t")).select("question_id", "t.head", fold("t.relation").alias("relation"), "t.tail")
    return t.where("head is not null and relation is not null and tail is not null").distinct()


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question_graphs").select("question_id", F.explode("topic_entities").alias("node")).where("node is not null").distinct()


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question_graphs").select("question_id", F.explode("gold_answers").alias("node")).where("node is not null").distinct()


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One row per question with what :func:`triples`, :func:`topics` and :func:`gold` have of it, in arrays.

    The rows are shuffled whole, once. A triple that a question repeats stays repeated; topics and gold answers do not.
    """
    q = table(spark, d, "question_graphs").where("question_id is not null")
    whole = F.filter("triples", lambda t: t["head"].isNotNull() & t["relation"].isNotNull() & t["tail"].isNotNull())
    q = q.select("question_id", F.transform(whole, lambda t: F.struct(t["head"].alias("head"), fold(t["relation"]).alias("relation"), t["tail"].alias("tail"))).alias("triples"), "topic_entities", "gold_answers")
    own = lambda c: F.flatten(F.collect_set(c))
    nodes = lambda c: F.sort_array(F.array_distinct(F.array_compact(own(c))))
    return q.groupBy("question_id").agg(own("triples").alias("triples"), nodes("topic_entities").alias("topics"), nodes("gold_answers").alias("gold"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates; a missing retrieval score is 0, other nulls stay."""
    return one_each(table(spark, d, "candidates"), "candidate_id")


def examples(spark: SparkSession, d: str) -> DataFrame:
    return one_each(table(spark, d, "examples"), "example_id")


TRIPLES = f"""t AS (SELECT DISTINCT question_id, t.head AS head, {sql_fold('t.relation')} AS relation, t.tail AS tail
  FROM (SELECT question_id, unnest(triples) AS t FROM (SELECT DISTINCT question_id, triples FROM question_graphs))
  WHERE t.head IS NOT NULL AND t.relation IS NOT NULL AND t.tail IS NOT NULL)"""
EDGES = TRIPLES + """, e AS (SELECT question_id, head AS src, relation, 'forward' AS direction, tail AS dst FROM t
  UNION ALL SELECT question_id, tail, relation, 'backward', head FROM t)"""
TOPICS = "a AS (SELECT DISTINCT question_id, unnest(topic_entities) AS node FROM question_graphs)"
GOLD = "g AS (SELECT DISTINCT question_id, unnest(gold_answers) AS node FROM question_graphs)"
CANDIDATES = "c AS (SELECT DISTINCT * FROM candidates)"
EXAMPLES = "x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS n FROM examples) WHERE n = 1)"
PATHS = EDGES + ", " + TOPICS + """, p1 AS (SELECT a.question_id, a.node AS anchor, [e.relation || '::' || e.direction] AS seq, [a.node, e.dst] AS nodes
    FROM a JOIN e ON e.question_id = a.question_id AND e.src = a.node WHERE e.dst <> a.node),
  p2 AS (SELECT p.question_id, p.anchor, list_append(p.seq, e.relation || '::' || e.direction) AS seq, list_append(p.nodes, e.dst) AS nodes
    FROM p1 p JOIN e ON e.question_id = p.question_id AND e.src = p.nodes[2] WHERE NOT list_contains(p.nodes, e.dst)),
  p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
  f AS (SELECT question_id, anchor, array_to_string(seq, '|') AS sequence, array_to_string(list_sort(list(DISTINCT nodes[len(nodes)])), '|') AS answers, CAST(count(*) AS BIGINT) AS n_paths
    FROM p GROUP BY question_id, anchor, seq)"""


def sql_resampled(rows: str, samples: int, keys: str = "", seed: int = 17) -> str:
    """CTE ``m(keys, rep, m)``: means of the Poisson resamples of ``rows`` with columns id, v and keys."""
    from ..functions.stats import POISSON, PRIME

    k = f"{keys}, " if keys else ""
    drawn = " + ".join(f"CAST(u > {bar!r} AS INT)" for bar in POISSON)
    return f"""rep AS (SELECT i AS rep, (i * 1664525 + 1013904223 + {seed}) % {PRIME} AS a, (i * 22695477 + 1) % {PRIME} AS b FROM range(1, {samples + 1}) x(i)),
      unit AS (SELECT {k}rep, v, ((('0x' || substr(md5(id), 1, 7))::BIGINT * a + b) % {PRIME} + 0.5) / {PRIME} AS u FROM {rows}, rep),
      m AS (SELECT {k}rep, sum(v * c) / nullif(sum(c), 0) AS m FROM (SELECT *, {drawn} AS c FROM unit) GROUP BY ALL)"""
