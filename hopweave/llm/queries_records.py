"""Registered queries over examples: term frequencies (p2) and grouped splits (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import fold, frequency, grouped_split


def _term_fields() -> dict[str, Column]:
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<relation:string,direction:string,source_type:string,target_type:string>>")
    hops = lambda p: F.coalesce(p["hops"], none)
    every = F.concat(
        F.coalesce(F.col("positive_path.hops"), none),
        F.coalesce(F.flatten(F.transform("alternate_positive_paths", hops)), none),
        F.coalesce(F.flatten(F.transform("negative_paths", hops)), none),
    )
    return {
        "hop_relation": F.transform(every, lambda h: fold.relation(h["relation"])),
        "relation_sequence": F.coalesce(F.transform("relation_sequence", fold.element), empty),
    }


def _counts(spark: SparkSession, d: str) -> DataFrame:
    counts, total = frequency.term_counts(table(spark, d, "examples"), "example_id", _term_fields())
    return frequency.marked(counts, total)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p2_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).select("field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("useful")).alias("mark"))


def sequence_key() -> Column:
    """Folded elements joined by ``|``; null where the record has no usable sequence."""
    given = F.transform("relation_sequence", fold.element)
    walked = F.transform(F.col("positive_path.hops"), fold.hop_element)
    whole = lambda a: F.when((F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull()), F.array_join(a, "|"))
    return F.when(F.coalesce(F.size("relation_sequence"), F.lit(0)) > 0, whole(given)).otherwise(whole(walked))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """``example_id, side, kg, sequence_key, key, spelling``; the spelling is what the key was read from, as it stands."""
    from ..session import materialize

    pair = F.struct("kg", "sequence_key")
    kept = table(spark, d, "examples").select(
        "example_id", fold.side("split").alias("side"), fold.trimmed("kg").alias("kg"), sequence_key().alias("sequence_key"),
        F.md5(F.to_json(F.struct("kg", "relation_sequence", F.col("positive_path.hops").alias("hops")))).alias("spelling"),
    )
    return materialize(kept.withColumn("key", F.when(pair["kg"].isNotNull() & pair["sequence_key"].isNotNull(), F.to_json(F.array("kg", "sequence_key")))).distinct(), "keyed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups that the present split tears apart, among the keys of each component."""
    records = _keyed(spark, d)
    of = grouped_split.key_components(records, "example_id", F.array("key"), F.col("spelling"))
    sides = records.where("key is not null and side is not null").select("key", "kg", "sequence_key", "side").distinct()
    return sides.join(of, "key").groupBy("component", "kg", "sequence_key").agg(F.countDistinct("side").alias("n")).where("n >= 2").select("kg", "sequence_key").distinct()


SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    linked = grouped_split.with_components(_keyed(spark, d), "example_id", F.array("key"), F.col("spelling"))
    return grouped_split.assign(linked, SHARES)


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select(F.col("record_id").alias("example_id"), "component", "new_split")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records, components and share of each new split."""
    total = F.sum("records").over(Window.partitionBy())  # three rows
    return _assigned(spark, d).groupBy("new_split").agg(F.count("*").alias("records"), F.countDistinct("component").alias("components")).withColumn("share", F.col("records") / total)


QUERIES = {f.__name__: f for f in (p2_found, p2_term_counts, p5_found, p5_assignment, p5_shares)}

_FOLD = r"regexp_replace(lower(trim({0}, E' \t\n\r ')), '^ns:', '')"
_TERMS = f"""
    WITH e AS (SELECT DISTINCT example_id, positive_path, alternate_positive_paths, negative_paths, relation_sequence FROM examples),
    h AS (
      SELECT example_id, unnest(positive_path.hops) AS h FROM e
      UNION ALL SELECT example_id, unnest(p.hops) FROM (SELECT example_id, unnest(alternate_positive_paths) AS p FROM e)
      UNION ALL SELECT example_id, unnest(p.hops) FROM (SELECT example_id, unnest(negative_paths) AS p FROM e)),
    t AS (
      SELECT 'hop_relation' AS field_name, example_id, {_FOLD.format('h.relation')} AS term FROM h WHERE h.relation IS NOT NULL
      UNION ALL
      SELECT 'relation_sequence', example_id, {_FOLD.format("regexp_extract(s, '^(.*)::', 1, 's')")} || '::' || lower(trim(regexp_extract(s, '::([^:]*)$', 1), E' \\t\\n\\r\\u00a0'))
      FROM (SELECT example_id, unnest(relation_sequence) AS s FROM e) WHERE s IS NOT NULL),
    c AS (SELECT field_name, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT example_id) AS BIGINT) AS records FROM t GROUP BY ALL),
    m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(DISTINCT example_id) FROM examples) THEN 'common' END AS mark FROM c)"""
_SIDE = "CASE WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'dev%' THEN 'dev' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END"
# components by a recursive walk over links of spellings and keys, then the salt nearest to the shares
_KEYS = f"""
    WITH RECURSIVE e AS (SELECT DISTINCT example_id, {_SIDE} AS side, lower(trim(kg)) AS kg, md5(to_json({{'k': kg, 's': relation_sequence, 'h': positive_path.hops}})::VARCHAR) AS spelling,
      list_transform(relation_sequence, lambda s: {_FOLD.format("regexp_extract(s, '^(.*)::', 1, 's')")} || '::' || lower(trim(regexp_extract(s, '::([^:]*)$', 1)))) AS given,
      list_transform(positive_path.hops, lambda h: {_FOLD.format('h.relation')} || '::' || lower(trim(h.direction))) AS walked FROM examples),
    k AS (SELECT example_id, side, kg, spelling, CASE WHEN len(given) > 0 THEN given ELSE walked END AS seq FROM e),
    keyed AS (SELECT example_id, side, kg, spelling, CASE WHEN len(seq) > 0 AND len(list_filter(seq, lambda x: x IS NULL)) = 0 THEN array_to_string(seq, '|') END AS sequence_key FROM k)"""
_GIVEN = _KEYS + """,
    links AS (
      SELECT DISTINCT 'spelling:' || spelling AS a, 'key:' || to_json([kg, sequence_key])::VARCHAR AS b FROM keyed WHERE kg IS NOT NULL AND sequence_key IS NOT NULL
      UNION SELECT DISTINCT 'record:' || example_id, 'spelling:' || spelling FROM keyed WHERE kg IS NOT NULL AND sequence_key IS NOT NULL),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(node, start) AS (
      SELECT DISTINCT a, a FROM both_ways WHERE a LIKE 'key:%'
      UNION SELECT l.b, w.start FROM walk w JOIN both_ways l ON l.a = w.node),
    member AS (SELECT example_id, coalesce(min(start), 'record:' || example_id) AS component
      FROM (SELECT DISTINCT example_id FROM keyed) LEFT JOIN walk ON node = 'record:' || example_id GROUP BY example_id),
    sizes AS (SELECT component, count(*) AS n FROM member GROUP BY component),
    bits AS (SELECT component, n, seed, md5(component || '|' || seed || '|0') AS h FROM sizes, range(1, 33) t(seed)),
    units AS (SELECT component, n, seed, -ln((('0x' || h[1:10])::BIGINT + 0.5) / 1099511627776.0) AS d, -ln((('0x' || h[11:20])::BIGINT + 0.5) / 1099511627776.0) AS t, -ln((('0x' || h[21:30])::BIGINT + 0.5) / 1099511627776.0) AS r FROM bits),
    w0 AS (SELECT seed, 0.1::DOUBLE / (0.8 + 0.1 + 0.1::DOUBLE) AS d, 0.1::DOUBLE / (0.8 + 0.1 + 0.1::DOUBLE) AS t, 0.8::DOUBLE / (0.8 + 0.1 + 0.1::DOUBLE) AS r FROM range(1, 33) x(seed))""" + "".join(
    f""",
    tried{i} AS (SELECT component, n, seed, CASE WHEN w.r / u.r >= w.d / u.d AND w.r / u.r >= w.t / u.t THEN 'train' WHEN w.t / u.t >= w.d / u.d THEN 'test' ELSE 'dev' END AS new_split FROM units u JOIN w{i} w USING (seed)),
    got{i} AS (SELECT seed, coalesce(sum(n) FILTER (new_split = 'dev'), 0) / sum(n) AS d, coalesce(sum(n) FILTER (new_split = 'test'), 0) / sum(n) AS t, coalesce(sum(n) FILTER (new_split = 'train'), 0) / sum(n) AS r FROM tried{i} GROUP BY seed),
    w{i + 1} AS (SELECT seed, w.d * coalesce(least(4, greatest(0.25, 0.1 / nullif(g.d, 0))), 4) AS d, w.t * coalesce(least(4, greatest(0.25, 0.1 / nullif(g.t, 0))), 4) AS t, w.r * coalesce(least(4, greatest(0.25, 0.8 / nullif(g.r, 0))), 4) AS r FROM w{i} w JOIN got{i} g USING (seed))"""
    for i in range(4)
) + """,
    tried AS (""" + " UNION ALL ".join(f"SELECT {i} AS turn, component, seed, new_split FROM tried{i}" for i in range(4)) + """),
    gaps AS (SELECT turn, seed, greatest(abs(d - 0.1), abs(t - 0.1), abs(r - 0.8)) AS gap FROM (""" + " UNION ALL ".join(f"SELECT {i} AS turn, * FROM got{i}" for i in range(4)) + """)),
    best AS (SELECT turn, seed FROM gaps ORDER BY round(gap, 12), turn, seed LIMIT 1),
    given AS (SELECT example_id, component, new_split FROM member JOIN tried USING (component) JOIN best USING (turn, seed))"""

SQL = {
    "p2_found": _TERMS + " SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_term_counts": _TERMS + " SELECT field_name, term, occurrences, records, coalesce(mark, 'useful') AS mark FROM m",
    "p5_found": _KEYS + """
        SELECT kg, sequence_key FROM keyed WHERE sequence_key IS NOT NULL AND kg IS NOT NULL
        GROUP BY ALL HAVING count(DISTINCT side) >= 2""",
    "p5_assignment": _GIVEN + " SELECT example_id, component, new_split FROM given",
    "p5_shares": _GIVEN + """
        SELECT new_split, count(*) AS records, count(DISTINCT component) AS components, count(*) / (SELECT count(*) FROM given) AS share
        FROM given GROUP BY new_split""",
}
