"""Corpus-building queries over the typed paths of all examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus
from ..session import table
from . import views as v


def _paths(spark: SparkSession, d: str) -> DataFrame:
    x = v.examples(spark, d).where("positive_path is not null and size(positive_path.hops) > 0")
    return x.where(~F.exists("positive_path.hops", lambda h: h.isNull() | h["relation"].isNull() | h["direction"].isNull())).select("example_id", "split", F.col("positive_path").alias("path"))


def path_corruptions(spark: SparkSession, d: str) -> DataFrame:
    """Corruptions of every path, one row each."""
    p = _paths(spark, d)
    inventory = p.select(F.explode("path.hops").alias("h")).select("h.target_type", "h.relation").distinct()
    got = corpus.corruptions(p, inventory)
    return got.select("example_id", "negative_type", F.array_join(corpus.relation_sequence(F.col("hops")), "|").alias("sequence"), "answer_type")


def wrong_direction_counterfactuals(spark: SparkSession, d: str) -> DataFrame:
    got = corpus.direction_counterfactuals(_paths(spark, d), table(spark, d, "relation_glossary"))
    return got.select("example_id", F.col("flipped_hop").cast("int").alias("flipped_hop"), "sequence")


def heldout_relations(spark: SparkSession, d: str) -> DataFrame:
    h = _paths(spark, d).select(F.explode("path.hops").alias("h")).select(v.fold("h.relation").alias("relation"))
    return corpus.heldout_relations(h)


def hash_splits(spark: SparkSession, d: str) -> DataFrame:
    """New splits: held-out relations, held-out compositions, a tenth to dev."""
    h = _paths(spark, d).select(F.explode("path.hops").alias("h")).select("h.relation")
    return corpus.assign_splits(_paths(spark, d), corpus.heldout_relations(h))


def unseen_slices(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records with relations or compositions that training lacks."""
    s = _paths(spark, d).select("example_id", F.lower(F.trim("split")).alias("s"), corpus.relation_sequence(F.col("path.hops")).alias("sequence"))
    got = corpus.generalization(s.where("s like 'train%'"), s.where("s like 'dev%' or s like 'test%'"))
    return got.groupBy("unseen_relation", "unseen_composition").agg(F.count("*").alias("n"))


def direction_pairs(spark: SparkSession, d: str) -> DataFrame:
    one = _paths(spark, d).where("size(path.hops) = 1").select(F.col("example_id").alias("id"), v.fold("path.kg").alias("kg"), v.fold(F.get("path.hops", F.lit(0))["relation"]).alias("relation"), F.get("path.hops", F.lit(0))["direction"].alias("direction"))
    best = v.candidates(spark, d).groupBy("example_id").agg(F.max("score").alias("score"))
    return corpus.direction_pairs(one.join(best, F.col("id") == F.col("example_id"), "left").select("id", "kg", "relation", "direction", F.coalesce("score", F.lit(0.0)).alias("score")))


def glossary_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all hops with and without a glossary entry, per graph."""
    h = _paths(spark, d).select(v.fold("path.kg").alias("kg"), F.explode("path.hops").alias("h")).select("kg", v.fold("h.relation").alias("relation")).distinct()
    g = table(spark, d, "relation_glossary").select(F.lower("relation_key").alias("k")).distinct()
    j = h.withColumn("k", F.concat_ws("::", "kg", "relation")).join(g.withColumn("known", F.lit(True)), "k", "left")
    return j.groupBy("kg").agg(F.count("*").alias("relations"), F.count_if("known").alias("described"))


def generic_types(spark: SparkSession, d: str) -> DataFrame:
    """Paths that state a type which says nothing, and answer types worth stating."""
    bad = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*text.GENERIC_TYPES)
    generic = F.exists("path.hops", lambda h: bad(h["source_type"]) | bad(h["target_type"]))
    informative = ~F.lower(F.trim(F.coalesce("path.answer_type", F.lit("")))).isin(*text.UNINFORMATIVE_TYPES)
    return _paths(spark, d).groupBy(F.size("path.hops").alias("hops")).agg(F.count("*").alias("n"), F.count_if(generic).alias("generic"), F.count_if(informative).alias("informative"))


def question_covers_path(spark: SparkSession, d: str) -> DataFrame:
    """Naturalized prompts that state every relation of their example's path."""
    p = _paths(spark, d)
    q = table(spark, d, "path_naturalizations").where("id like '%:positive' and canonical_question is not null").select("example_id", F.lower("canonical_question").alias("q")).distinct()
    covered = F.forall("path.hops", lambda h: F.contains(F.col("q"), text.relation_words(v.fold(h["relation"]))) & F.contains(F.col("q"), h["direction"]))
    return p.join(q, "example_id").agg(F.count("*").alias("n"), F.count_if(covered).alias("covered"))


QUERIES = {
    f.__name__: f
    for f in (path_corruptions, wrong_direction_counterfactuals, heldout_relations, hash_splits, unseen_slices, direction_pairs, glossary_coverage, generic_types, question_covers_path)
}

_P = f"""{v.EXAMPLES}, p AS (SELECT example_id, split, positive_path AS path FROM x WHERE positive_path IS NOT NULL AND len(positive_path.hops) > 0
    AND len(list_filter(positive_path.hops, lambda h: h IS NULL OR h.relation IS NULL OR h.direction IS NULL)) = 0)"""
_SEQ = "list_transform(path.hops, lambda h: h.relation || '::' || h.direction)"
_BUCKET = "CAST(('0x' || substr(sha256({0}), 1, {2})) AS BIGINT) % {1}"


def _held(relation: str) -> str:
    return f"""n AS (SELECT relation FROM (SELECT {relation} AS relation FROM (SELECT unnest(path.hops) AS h FROM p)) GROUP BY 1 HAVING count(*) >= 4), z AS (SELECT relation FROM n WHERE {_BUCKET.format('relation', 7, 12)} = 0),
    held AS (SELECT relation FROM z UNION ALL SELECT max(relation) FROM n WHERE NOT EXISTS (SELECT 1 FROM z) HAVING max(relation) IS NOT NULL)"""


_SYM = f"(array_to_string(regexp_extract_all(lower(replace(h.relation, '_', ' ')), '[a-z0-9]+'), ' ') IN ({', '.join(repr(x) for x in text.SYMMETRIC_WHOLE)})" + "".join(f" OR contains(array_to_string(regexp_extract_all(lower(replace(h.relation, '_', ' ')), '[a-z0-9]+'), ' '), '{x}')" for x in text.SYMMETRIC_PARTS) + ")"
_ROLE = "array_to_string(regexp_extract_all(lower(replace(coalesce({0}, ''), '_', ' ')), '[a-z0-9]+'), ' ')"

SQL = {
    "wrong_direction_counterfactuals": f"""WITH {_P}, g AS (SELECT relation_key, any_value(subject_role) AS s, any_value(object_role) AS o FROM relation_glossary GROUP BY 1),
        f AS (SELECT example_id, path, unnest(path.hops) AS h, generate_subscripts(path.hops, 1) AS i FROM p)
        SELECT example_id, CAST(i - 1 AS INT) AS flipped_hop, array_to_string(list_transform(path.hops, lambda q, j: q.relation || '::' || CASE WHEN j = i THEN CASE WHEN q.direction = 'forward' THEN 'backward' ELSE 'forward' END ELSE q.direction END), '|') AS sequence
        FROM f LEFT JOIN g ON g.relation_key = concat_ws('::', f.path.kg, f.h.relation) WHERE NOT ({_SYM} OR ({_ROLE.format('g.s')} <> '' AND {_ROLE.format('g.s')} = {_ROLE.format('g.o')}))""",
    "heldout_relations": f"WITH {_P}, {_held(v.sql_fold('h.relation'))} SELECT relation FROM held",
    "unseen_slices": f"""WITH {_P}, s AS (SELECT example_id, lower(trim(split)) AS s, {_SEQ} AS q FROM p), tr AS (SELECT DISTINCT unnest(q) AS r FROM s WHERE s LIKE 'train%'), ts AS (SELECT DISTINCT array_to_string(q, '|') AS k FROM s WHERE s LIKE 'train%'),
        e AS (SELECT * FROM s WHERE s LIKE 'dev%' OR s LIKE 'test%'), b AS (SELECT DISTINCT example_id FROM (SELECT example_id, unnest(q) AS r FROM e) WHERE r NOT IN (SELECT r FROM tr)),
        l AS (SELECT example_id IN (SELECT example_id FROM b) AS ur, array_to_string(q, '|') NOT IN (SELECT k FROM ts) AS us FROM e) SELECT ur AS unseen_relation, us AND NOT ur AS unseen_composition, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL""",
    "direction_pairs": f"""WITH {_P}, b AS (SELECT example_id, max(score) AS score FROM candidates GROUP BY 1), o AS (SELECT p.example_id AS id, {v.sql_fold('path.kg')} AS kg, {v.sql_fold('path.hops[1].relation')} AS relation, path.hops[1].direction AS direction, coalesce(b.score, 0) AS score FROM p LEFT JOIN b USING (example_id) WHERE len(path.hops) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY kg, relation, direction ORDER BY score DESC, id DESC) AS n FROM o), k AS (SELECT * FROM r WHERE n = 1)
        SELECT f.kg, f.relation, f.id AS forward_id, w.id AS backward_id, CASE WHEN {_BUCKET.format("f.kg || '::' || f.relation", 10, 8)} = 0 THEN 'dev' ELSE 'train' END AS split FROM k f JOIN k w ON w.kg = f.kg AND w.relation = f.relation AND f.direction = 'forward' AND w.direction = 'backward'""",
    "glossary_coverage": f"""WITH {_P}, h AS (SELECT DISTINCT {v.sql_fold('path.kg')} AS kg, {v.sql_fold('h.relation')} AS relation FROM (SELECT path, unnest(path.hops) AS h FROM p)), g AS (SELECT DISTINCT lower(relation_key) AS k FROM relation_glossary)
        SELECT kg, CAST(count(*) AS BIGINT) AS relations, CAST(count(g.k) AS BIGINT) AS described FROM h LEFT JOIN g ON g.k = concat_ws('::', kg, relation) GROUP BY 1""",
    "generic_types": f"""WITH {_P} SELECT CAST(len(path.hops) AS INT) AS hops, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (len(list_filter(path.hops, lambda h: lower(trim(coalesce(h.source_type, ''))) IN ({', '.join(repr(x) for x in text.GENERIC_TYPES)}) OR lower(trim(coalesce(h.target_type, ''))) IN ({', '.join(repr(x) for x in text.GENERIC_TYPES)}))) > 0) AS BIGINT) AS generic,
        CAST(count(*) FILTER (lower(trim(coalesce(path.answer_type, ''))) NOT IN ({', '.join(repr(x) for x in text.UNINFORMATIVE_TYPES)})) AS BIGINT) AS informative FROM p GROUP BY 1""",
}
SQL["hash_splits"] = f"""WITH {_P}, {_held('h.relation')}, s AS (SELECT example_id, {_SEQ} AS q FROM p), b AS (SELECT DISTINCT example_id FROM (SELECT example_id, unnest(path.hops) AS h FROM p) WHERE h.relation IN (SELECT relation FROM held))
    SELECT example_id, CASE WHEN example_id IN (SELECT example_id FROM b) THEN 'test_unseen_relation' WHEN len(q) > 1 AND {_BUCKET.format("array_to_string(q, '|')", 10, 12)} = 0 THEN 'test_unseen_composition' WHEN {_BUCKET.format('example_id', 10, 12)} = 0 THEN 'dev' ELSE 'train' END AS new_split FROM s"""

_DRAW = "(CAST(('0x' || substr(sha256('17|{0}|' || example_id), 1, 12)) AS BIGINT) % len({1}))"


def _chained(hops: str) -> str:
    return "list_transform(" + hops + ", lambda h, k: {'relation': h.relation, 'direction': h.direction, 'source_type': CASE WHEN k = 1 THEN path.anchor_type ELSE " + hops + "[k - 1].target_type END, 'target_type': h.target_type})"


def _hop(**changed: str) -> str:
    parts = {n: changed.get(n, f"h.{n}") for n in ("relation", "direction", "source_type", "target_type")}
    return "{" + ", ".join(f"'{n}': {e}" for n, e in parts.items()) + "}"


SQL["path_corruptions"] = f"""WITH {_P}, b AS (SELECT example_id, path, path.hops AS hops, path.answer_type AS answer FROM p),
    inv AS (SELECT lower(h.target_type) AS type, list_sort(list(DISTINCT h.relation)) AS relations FROM (SELECT unnest(hops) AS h FROM b) WHERE h.target_type IS NOT NULL GROUP BY 1),
    types AS (SELECT list_sort(list(type) FILTER (type <> 'entity')) AS types FROM inv),
    o AS (SELECT b.*, list_filter(relations, lambda r: r <> hops[place].relation) AS others FROM (SELECT *, {_DRAW.format('relation', 'hops')} + 1 AS place FROM b) b LEFT JOIN inv ON inv.type = lower(hops[place].target_type)),
    t AS (SELECT b.*, list_filter(types, lambda x: x <> lower(coalesce(answer, ''))) AS other_types FROM b, types),
    f AS (SELECT *, list_filter(hops, lambda h, k: k <> {_DRAW.format('missing', 'hops')} + 1) AS fewer, list_concat([hops[2], hops[1]], hops[3:]) AS exchanged FROM b WHERE len(hops) > 1),
    every AS (
      SELECT example_id, 1 AS n, 'wrong_direction' AS negative_type, list_transform(hops, lambda h, k: CASE WHEN k = {_DRAW.format('direction', 'hops')} + 1 THEN {_hop(direction="CASE WHEN h.direction = 'forward' THEN 'backward' ELSE 'forward' END")} ELSE {_hop()} END) AS made, answer AS made_type, hops, answer FROM b
      UNION ALL SELECT example_id, 2, 'wrong_relation', list_transform(hops, lambda h, k: CASE WHEN k = place THEN {_hop(relation="others[" + _DRAW.format('other', 'others') + " + 1]")} ELSE {_hop()} END), answer, hops, answer FROM o WHERE len(others) > 0
      UNION ALL SELECT example_id, 3, 'wrong_order', {_chained('exchanged')}, answer, hops, answer FROM f
      UNION ALL SELECT example_id, 4, 'missing_hop', {_chained('fewer')}, fewer[len(fewer)].target_type, hops, answer FROM f
      UNION ALL SELECT example_id, 5, 'wrong_answer_type', list_transform(hops, lambda h, k: CASE WHEN k = len(hops) THEN {_hop(target_type="other_types[" + _DRAW.format('type', 'other_types') + " + 1]")} ELSE {_hop()} END), other_types[{_DRAW.format('type', 'other_types')} + 1], hops, answer FROM t WHERE len(other_types) > 0),
    kept AS (SELECT *, row_number() OVER (PARTITION BY example_id, made, made_type ORDER BY n) AS first FROM every WHERE made IS DISTINCT FROM list_transform(hops, lambda h: {_hop()}) OR made_type IS DISTINCT FROM answer)
    SELECT example_id, negative_type, array_to_string(list_transform(made, lambda h: h.relation || '::' || h.direction), '|') AS sequence, made_type AS answer_type FROM kept WHERE first = 1"""
_WORDS = "trim(regexp_replace(translate(CASE WHEN len(string_split({0}, '.')) >= 3 THEN string_split({0}, '.')[-1] ELSE array_to_string(string_split({0}, '.'), ' ') END, '_/', '  '), '\\s+', ' ', 'g'))"
SQL["question_covers_path"] = f"""WITH {_P}, q AS (SELECT DISTINCT example_id, lower(canonical_question) AS q FROM path_naturalizations WHERE id LIKE '%:positive' AND canonical_question IS NOT NULL)
    SELECT count(*) AS n, count(*) FILTER (len(list_filter(path.hops, lambda h: NOT (contains(q, {_WORDS.format(v.sql_fold('h.relation'))}) AND contains(q, h.direction)))) = 0) AS covered FROM p JOIN q USING (example_id)"""
