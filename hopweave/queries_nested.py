"""Registered queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import nested
from .session import table


def _shown(df: DataFrame) -> DataFrame:
    """Identities as hexadecimal text."""
    return df.select(*[F.lower(F.hex(c)).alias(c) if c.endswith("_hash") else F.col(c) for c in df.columns])


def _tables(spark: SparkSession, d: str) -> nested.FlatTables:
    both = nested.from_examples(table(spark, d, "examples")).unionByName(nested.from_lines(table(spark, d, "raw_examples")))
    return nested.flatten(both)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(_tables(spark, d)).select("record_id", "path_role", "path_index", "hop_index").distinct()


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).records)


def p3_record_objects(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).record_objects)


def p3_object_paths(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).object_paths)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).paths)


def p3_hops(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).hops)


def p3_record_paths(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).record_paths)


def p3_path_hops(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tables(spark, d).path_hops)


def p3_sharing(spark: SparkSession, d: str) -> DataFrame:
    """How often stored path objects are shared, by role."""
    t = _tables(spark, d)
    return t.record_paths.groupBy("path_role").agg(F.count("*").alias("occurrences"), F.countDistinct("path_hash").alias("objects"))


def p3_example_hops(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences per role and relation over the typed examples (SQL can express this part)."""
    t = nested.flatten(nested.from_examples(table(spark, d, "examples")))
    o = nested.occurrences(t).distinct().join(t.hops.select("hop_hash", "relation"), "hop_hash")
    return o.groupBy("path_role", "relation").agg(F.count("*").alias("n_hops"), F.countDistinct("record_id").alias("n_records"))


def p3_example_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table over the typed examples: objects stored once, a bridge row for every occurrence."""
    t = nested.flatten(nested.from_examples(table(spark, d, "examples")))
    names = ("records", "record_objects", "object_paths", "record_paths", "paths", "path_hops", "hops")
    sizes = [getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


def p3_example_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Path occurrences and stored path objects of the typed examples, by role and knowledge graph."""
    t = nested.flatten(nested.from_examples(table(spark, d, "examples")))
    return t.record_paths.join(t.paths.select("path_hash", "kg"), "path_hash").groupBy("path_role", "kg").agg(F.count("*").alias("occurrences"), F.countDistinct("path_hash").alias("objects"))


QUERIES = {f.__name__: f for f in (p3_found, p3_example_tables, p3_example_sharing, p3_record_objects, p3_object_paths, p3_records, p3_paths, p3_hops, p3_record_paths, p3_path_hops, p3_sharing, p3_example_hops)}

_OBJECTS = """
    WITH e AS (SELECT DISTINCT example_id, question, split, kg, positive_path, alternate_positive_paths, negative_paths FROM examples),
    p AS (
      SELECT example_id, 'positive' AS path_role, 0 AS i, positive_path AS x, NULL AS negative_type, NULL AS question FROM e
      UNION ALL
      SELECT example_id, 'alternate', i, x, NULL, NULL FROM (SELECT example_id, unnest(alternate_positive_paths) AS x, generate_subscripts(alternate_positive_paths, 1) - 1 AS i FROM e)
      UNION ALL
      SELECT example_id, 'negative', i, {'anchor': x.anchor, 'anchor_type': x.anchor_type, 'hops': x.hops, 'answer_type': x.answer_type, 'kg': x.kg}, x.negative_type, x.question
      FROM (SELECT example_id, unnest(negative_paths) AS x, generate_subscripts(negative_paths, 1) - 1 AS i FROM e)),
    o AS (SELECT example_id, path_role, i, x.kg AS kg, coalesce(x.hops, []) AS hops,
            {'a': x.anchor, 'b': x.anchor_type, 'c': x.answer_type, 'd': x.kg, 'e': negative_type, 'f': question, 'g': coalesce(x.hops, [])} AS object FROM p WHERE x IS NOT NULL),
    r AS (SELECT e.example_id, {'q': e.question, 's': e.split, 'k': e.kg, 'p': list_sort(list({'r': path_role, 'i': i, 'o': object}) FILTER (object IS NOT NULL))} AS record
          FROM e LEFT JOIN o USING (example_id) GROUP BY e.example_id, e.question, e.split, e.kg)"""

SQL = {
    "p3_example_tables": _OBJECTS + """,
        ro AS (SELECT DISTINCT record FROM r), po AS (SELECT DISTINCT object, hops FROM o), h AS (SELECT object, unnest(hops) AS hop FROM po)
        SELECT 'records' AS table_name, count(*) AS n_rows FROM r UNION ALL SELECT 'record_objects', count(*) FROM ro
        UNION ALL SELECT 'object_paths', coalesce(sum(len(record.p)), 0)::BIGINT FROM ro UNION ALL SELECT 'record_paths', count(*) FROM o
        UNION ALL SELECT 'paths', count(*) FROM po UNION ALL SELECT 'path_hops', count(*) FROM h WHERE hop IS NOT NULL
        UNION ALL SELECT 'hops', count(DISTINCT hop) FROM h WHERE hop IS NOT NULL""",
    "p3_example_sharing": _OBJECTS + " SELECT path_role, kg, count(*) AS occurrences, count(DISTINCT object) AS objects FROM o GROUP BY ALL",
    "p3_example_hops": """
        WITH e AS (SELECT DISTINCT example_id, positive_path, alternate_positive_paths, negative_paths FROM examples),
        p AS (
          SELECT example_id, 'positive' AS path_role, positive_path.hops AS hops, 0 AS i FROM e WHERE positive_path IS NOT NULL
          UNION ALL
          SELECT example_id, 'alternate', x.hops, i FROM (SELECT example_id, unnest(alternate_positive_paths) AS x, generate_subscripts(alternate_positive_paths, 1) AS i FROM e)
          UNION ALL
          SELECT example_id, 'negative', x.hops, i FROM (SELECT example_id, unnest(negative_paths) AS x, generate_subscripts(negative_paths, 1) AS i FROM e)),
        h AS (SELECT DISTINCT example_id, path_role, i, j, h.relation AS relation, h IS NULL AS gone FROM
          (SELECT example_id, path_role, i, unnest(hops) AS h, generate_subscripts(hops, 1) AS j FROM p))
        SELECT path_role, relation, CAST(count(*) AS BIGINT) AS n_hops, CAST(count(DISTINCT example_id) AS BIGINT) AS n_records
        FROM h WHERE NOT gone GROUP BY ALL""",
}
