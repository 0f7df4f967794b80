"""Queries of the text functions over questions, responses, relations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, text
from ..session import table
from . import views as v

_DONE = lambda c: F.round(c, 9)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct prompts and responses of naturalizations that are not null."""
    t = table(spark, d, "path_naturalizations").select("canonical_question", "question").where("canonical_question is not null and question is not null")
    return t.distinct().select("canonical_question", "question", text.tokens("canonical_question").alias("a"), text.tokens("question").alias("b"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("canonical_question", "question", _DONE(text.token_f1(F.col("a"), F.col("b"))).alias("f1"))


def lexical_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("canonical_question", "question", _DONE(text.set_cosine(F.col("a"), F.col("b"))).alias("cosine"), _DONE(text.coverage(F.col("a"), F.col("b"))).alias("coverage"))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequence F1 of all pairs, by way of the Arrow function."""
    p = _pairs(spark, d)
    return p.select("canonical_question", "question", _DONE(text.rouge_l_long("a", "b")).alias("rouge"))


def lexical_distribution(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select(text.set_cosine(F.col("a"), F.col("b")).alias("x"))
    return p.agg(F.count("*").alias("n"), _DONE(F.avg("x")).alias("mean"), _DONE(F.percentile("x", 0.5)).alias("median"), _DONE(F.percentile("x", 0.1)).alias("p10"), _DONE(F.avg((F.col("x") >= 0.5).cast("double"))).alias("half"))


def repetition_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first repetition rule they break."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select(F.coalesce(text.repetition_reason("text"), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


def question_repetition(spark: SparkSession, d: str) -> DataFrame:
    t = v.candidates(spark, d).where("generated_question is not null")
    return t.select(F.coalesce(text.repetition_reason("generated_question"), F.lit("accepted")).alias("reason"), "negative_type").groupBy("reason", "negative_type").agg(F.count("*").alias("n"))


def relation_words(spark: SparkSession, d: str) -> DataFrame:
    r = v.triples(spark, d).select("relation").distinct()
    s = text.relation_schema("relation")
    return r.select(
        "relation", text.relation_words("relation").alias("words"), text.relation_words("relation", F.lit(True)).alias("inverse"), text.full_relation_words("relation").alias("full_words"),
        text.relation_text("relation").alias("short"), text.type_hint("relation").alias("hint"), s["domain"].alias("domain"), s["type"].alias("type"), s["property"].alias("property"), s["complete"].alias("complete"),
    )


def metadata_flag(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all tables that a metadata pattern matches."""
    r = v.triples(spark, d).select("relation").union(table(spark, d, "relation_glossary").select(F.substring_index("relation_key", "::", -1))).distinct()
    return r.select("relation", F.array_join(text.metadata_patterns("relation"), "|").alias("patterns"), text.is_semantic("relation").alias("semantic"))


def symmetric_by_name(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "relation_glossary").distinct()
    return g.select("relation_key", text.is_symmetric(F.substring_index("relation_key", "::", -1), F.col("subject_role"), F.col("object_role")).alias("symmetric"))


def mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Questions with letters beyond ASCII after their UTF-8 was read as Latin-1 and repaired: as they were."""
    q = v.examples(spark, d).where("question is not null").select("example_id", "question")
    q = q.where(F.col("question").rlike(r"[\x{C0}-\x{FF}]") & ~F.col("question").rlike("[ÃÂâ]"))
    damaged = F.decode(F.encode("question", "UTF-8"), "ISO-8859-1")
    return q.select("example_id", damaged.alias("damaged"), text.repair_mojibake(damaged).alias("repaired")).where("damaged <> repaired").select("example_id", "repaired")


def delexicalized(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the anchor of their path replaced, exact matches only."""
    x = v.examples(spark, d).where("question is not null and positive_path.anchor is not null")
    got = x.select("example_id", text.delexicalize_exact(F.col("question"), F.col("positive_path.anchor")).alias("masked"), "question")
    return got.agg(F.count("*").alias("n"), F.count_if(F.contains("masked", F.lit("[ENTITY]"))).alias("masked"))


def delexicalized_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    x = v.examples(spark, d).where("question is not null and positive_path.anchor is not null")
    return x.select("example_id", text.delexicalize("question", "positive_path.anchor").alias("masked"))


def normalized_answers(spark: SparkSession, d: str) -> DataFrame:
    a = v.candidates(spark, d).select(F.explode("answers").alias("a")).where("a is not null").distinct()
    return a.select(F.col("a").alias("answer"), text.normalize_answer("a").alias("normal"), text.normalize_space("a").alias("spaced"), text.normalized_words("a").alias("words"))


def stable_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = v.examples(spark, d).select("example_id")
    return x.select("example_id", text.stable_bucket("example_id").alias("bucket"), text.stable_bucket("example_id", 10, 8).alias("short_bucket"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    n = text.estimate_tokens("text")
    return t.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("tokens"), F.max(n).cast("long").alias("most"))


def directed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Elements of relation sequences taken apart at the last ``::``."""
    e = v.candidates(spark, d).select(F.explode("relation_sequence").alias("key")).where("key is not null")
    k = text.undirected("key")
    return e.select(k["relation"].alias("relation"), k["direction"].alias("direction")).groupBy("relation", "direction").agg(F.count("*").alias("n"))


def question_gate(spark: SparkSession, d: str) -> DataFrame:
    """Returned items by the first reason that rejects them."""
    t = table(spark, d, "path_naturalizations").distinct()
    reason = F.coalesce(quality.item_rejection(v.fold("status"), F.col("question")), F.lit("accepted"))
    return t.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("items"))


def notation_gate(spark: SparkSession, d: str) -> DataFrame:
    t = v.candidates(spark, d)
    reason = F.coalesce(quality.notation(F.col("generated_question")), F.lit("accepted"))
    return t.select(reason.alias("reason"), "negative_type").groupBy("reason", "negative_type").agg(F.count("*").alias("n"))


def glossary_gate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "relation_glossary").distinct()
    status = quality.glossary_status(F.substring_index("relation_key", "::", -1), F.col("status"), F.col("fact_template"), F.col("confidence"), 0.5)
    return g.select("relation_key", status.alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        token_f1, lexical_cosine, rouge_l, lexical_distribution, repetition_gate, question_repetition, relation_words, metadata_flag, symmetric_by_name, mojibake, delexicalized, delexicalized_fuzzy,
        normalized_answers, stable_buckets, token_estimates, directed_keys, question_gate, notation_gate, glossary_gate,
    )
}

_T = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_P = f"p AS (SELECT DISTINCT canonical_question, question FROM path_naturalizations WHERE canonical_question IS NOT NULL AND question IS NOT NULL), w AS (SELECT *, {_T.format('canonical_question')} AS a, {_T.format('question')} AS b FROM p)"
_N = "len(list_filter({0}, lambda y: y = z))"
_COS = "len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(sqrt(CAST(len(list_distinct(a)) * len(list_distinct(b)) AS DOUBLE)), 1.0)"
_BARE = "regexp_replace({0}, '^ns:', '')"
_PARTS = "string_split(relation, '.')"
_METADATA = "[" + ", ".join(f"'{p}'" for p in text.METADATA_PATTERNS) + "]"
_ROLE = "array_to_string(regexp_extract_all(lower(replace(coalesce({0}, ''), '_', ' ')), '[a-z0-9]+'), ' ')"
_GRAM = "(SELECT coalesce(max(k), 0) FROM (SELECT count(*) AS k FROM (SELECT unnest(list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' '))) AS g) GROUP BY g))"


def _repetition(source: str, group: str) -> str:
    g = f", {group}" if group else ""
    grams = " UNION ALL ".join(
        f"SELECT id, {n} AS n, max(k) AS k FROM (SELECT id, g, count(*) AS k FROM (SELECT id, unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS g FROM w) GROUP BY ALL) GROUP BY ALL" for n in (3, 4, 5)
    )
    stop = ", ".join(f"'{x}'" for x in text.STOP_WORDS)
    return f"""WITH s AS ({source}), w AS (SELECT *, {_T.format('t')} AS w FROM s), m AS ({grams} UNION ALL SELECT id, 1, max(k) FROM (SELECT id, x, count(*) AS k FROM (SELECT id, unnest(w) AS x FROM w) WHERE x NOT IN ({stop}) GROUP BY ALL) GROUP BY ALL),
        v AS (SELECT id, max(k) FILTER (n = 3) AS g3, max(k) FILTER (n = 4) AS g4, max(k) FILTER (n = 5) AS g5, max(k) FILTER (n = 1) AS g1 FROM m GROUP BY id),
        r AS (SELECT w.*, CASE WHEN len(w) < 6 THEN 'accepted' WHEN g3 >= 5 THEN 'repeated_3_gram' WHEN g4 >= 5 THEN 'repeated_4_gram' WHEN g5 >= 5 THEN 'repeated_5_gram' WHEN g1 >= 7 THEN 'excessive_repeated_content_word' ELSE 'accepted' END AS reason FROM w LEFT JOIN v USING (id))
        SELECT reason{g}, CAST(count(*) AS BIGINT) AS {'n' if group else 'documents'} FROM r GROUP BY ALL"""


SQL = {
    "token_f1": f"WITH {_P}, o AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda z: least({_N.format('a')}, {_N.format('b')}))) AS s FROM w) SELECT canonical_question, question, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(s, 0) / (len(a) + len(b)) END, 9) AS f1 FROM o",
    "lexical_cosine": f"WITH {_P} SELECT canonical_question, question, round({_COS}, 9) AS cosine, round(CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(b)) END, 9) AS coverage FROM w",
    "lexical_distribution": f"WITH {_P}, x AS (SELECT {_COS} AS x FROM w) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(x), 9) AS mean, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.1), 9) AS p10, round(avg(CASE WHEN x >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS half FROM x",
    "repetition_gate": _repetition("SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL", ""),
    "question_repetition": _repetition("SELECT DISTINCT candidate_id AS id, generated_question AS t, negative_type FROM candidates WHERE generated_question IS NOT NULL", "negative_type"),
    "relation_words": f"""WITH {v.TRIPLES}, r AS (SELECT DISTINCT relation, {_PARTS} AS p FROM t), q AS (SELECT *, trim(regexp_replace(translate(CASE WHEN len(p) >= 3 THEN p[-1] ELSE array_to_string(p, ' ') END, '_/', '  '), '\\s+', ' ', 'g')) AS words,
        string_split(trim(relation, '/'), CASE WHEN contains(relation, '/') THEN '/' ELSE '.' END) AS s FROM r), z AS (SELECT *, list_filter(s, lambda x: x <> '') AS k FROM q)
        SELECT relation, words, 'inverse of ' || words AS inverse, trim(regexp_replace(replace(replace(replace(relation, '.', ' / '), '_', ' '), '/', ' / '), '\\s+', ' ', 'g')) AS full_words,
        replace(array_to_string(p[greatest(len(p) - 1, 1):len(p)], ' '), '_', ' ') AS short, CASE WHEN len(p) < 2 THEN '' ELSE lower(replace(p[-2], '_', ' ')) END AS hint,
        CASE WHEN len(k) >= 3 THEN k[1] END AS domain, CASE WHEN len(k) >= 3 THEN k[2] END AS type, CASE WHEN len(k) >= 3 AND contains(relation, '/') THEN array_to_string(k[3:], '/') WHEN len(k) >= 3 THEN array_to_string(k[3:], '.') END AS property, len(k) >= 3 AS complete FROM z""",
    "metadata_flag": f"WITH {v.TRIPLES}, r AS (SELECT relation FROM t UNION SELECT string_split(relation_key, '::')[-1] FROM relation_glossary) SELECT relation, array_to_string(list_filter({_METADATA}, lambda p: contains(lower(relation), p)), '|') AS patterns, len(list_filter({_METADATA}, lambda p: contains(lower(relation), p))) = 0 AS semantic FROM r",
    "symmetric_by_name": f"""WITH g AS (SELECT DISTINCT relation_key, subject_role, object_role FROM relation_glossary), q AS (SELECT relation_key, {_ROLE.format("string_split(relation_key, '::')[-1]")} AS r, {_ROLE.format('subject_role')} AS s, {_ROLE.format('object_role')} AS o FROM g)
        SELECT relation_key, r IN ({', '.join(f"'{x}'" for x in text.SYMMETRIC_WHOLE)}) OR {' OR '.join(f"contains(r, '{x}')" for x in text.SYMMETRIC_PARTS)} OR (s <> '' AND s = o) AS symmetric FROM q""",
    "normalized_answers": r"""WITH a AS (SELECT DISTINCT a FROM (SELECT unnest(answers) AS a FROM candidates) WHERE a IS NOT NULL) SELECT a AS answer, trim(regexp_replace(regexp_replace(regexp_replace(lower(a), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS normal,
        trim(regexp_replace(a, '\s+', ' ', 'g')) AS spaced, array_to_string(regexp_extract_all(lower(a), '[a-z0-9]+'), ' ') AS words FROM a""",
    "stable_buckets": f"WITH {v.EXAMPLES} SELECT example_id, CAST(('0x' || substr(sha256(example_id), 1, 12)) AS BIGINT) % 10000 AS bucket, CAST(('0x' || substr(sha256(example_id), 1, 8)) AS BIGINT) % 10 AS short_bucket FROM x",
    "question_gate": f"""WITH t AS (SELECT DISTINCT * FROM path_naturalizations), q AS (SELECT {v.sql_fold('status')} AS s, question, trim(coalesce(question, '')) AS q FROM t)
        SELECT CASE WHEN s IS NULL AND question IS NULL THEN 'missing_output' WHEN s IS DISTINCT FROM 'valid' THEN 'model_marked_opaque' WHEN (length(q) - length(replace(q, '[ENTITY]', ''))) / 8 <> 1 THEN 'entity_placeholder_count' WHEN NOT q LIKE '%?' THEN 'not_a_question'
        WHEN {' OR '.join(f"contains(lower(q), '{x}')" for x in quality.PROCEDURAL)} THEN 'procedural_language' ELSE 'accepted' END AS reason, CAST(count(*) AS BIGINT) AS items FROM q GROUP BY 1""",
    "notation_gate": f"""WITH c AS (SELECT DISTINCT * FROM candidates), q AS (SELECT negative_type, lower(coalesce(generated_question, '')) AS q FROM c)
        SELECT CASE WHEN regexp_matches(q, '\\bv\\d+\\b') OR contains(q, 'type:') OR contains(q, '(') OR contains(q, ')') THEN 'internal_notation_in_question' WHEN {' OR '.join(f"contains(q, '{x}')" for x in quality.VAGUE)} THEN 'vague_question_wording' ELSE 'accepted' END AS reason, negative_type, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL""",
    "glossary_gate": f"""WITH g AS (SELECT DISTINCT * FROM relation_glossary), q AS (SELECT *, lower(string_split(relation_key, '::')[-1]) AS r, lower(coalesce(fact_template, '')) AS f FROM g)
        SELECT relation_key, CASE WHEN len(list_filter({_METADATA}, lambda p: contains(r, p))) > 0 THEN 'metadata' WHEN status IS NULL THEN 'opaque' WHEN status IN ('semantic', 'valid') AND NOT (contains(f, 'subject') AND contains(f, 'object') AND coalesce(confidence, 0) >= 0.5) THEN 'opaque' ELSE status END AS status FROM q""",
    "token_estimates": "SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, CAST(max(ceil(length(text) / 4)) AS BIGINT) AS most FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "directed_keys": "WITH c AS (SELECT DISTINCT * FROM candidates), e AS (SELECT unnest(relation_sequence) AS key FROM c), k AS (SELECT CASE WHEN regexp_matches(key, '::(forward|backward)$') THEN regexp_replace(key, '::(forward|backward)$', '') END AS relation, CASE WHEN regexp_matches(key, '::(forward|backward)$') THEN regexp_extract(key, '::(forward|backward)$', 1) END AS direction FROM e WHERE key IS NOT NULL) SELECT relation, direction, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL",
}

SQL["mojibake"] = f"WITH {v.EXAMPLES} SELECT example_id, question AS repaired FROM x WHERE regexp_matches(question, '[\u00c0-\u00ff]') AND NOT regexp_matches(question, '[\u00c3\u00c2\u00e2]')"
SQL["delexicalized"] = f"""WITH {v.EXAMPLES}, q AS (SELECT question AS q, positive_path.anchor AS a FROM x WHERE question IS NOT NULL AND positive_path.anchor IS NOT NULL)
    SELECT count(*) AS n, count(*) FILTER (contains(q, '[ENTITY]') OR (length(trim(a)) > 0 AND regexp_matches(q, '(?i)(^|[^0-9A-Za-z_])' || regexp_escape(a) || '($|[^0-9A-Za-z_])'))) AS masked FROM q"""
# the longest common subsequence row by row: a cell is the largest of its row's candidates so far
SQL["rouge_l"] = f"""WITH RECURSIVE {_P}, n AS (SELECT row_number() OVER () AS k, * FROM w),
    r AS (SELECT k, 0 AS i, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) AS cells, a, b FROM n
          UNION ALL SELECT k, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda z: CASE WHEN z = 0 THEN 0 WHEN a[i + 1] = b[z] THEN greatest(cells[z + 1], cells[z] + 1) ELSE cells[z + 1] END))), a, b FROM r WHERE i < len(a))
    SELECT canonical_question, question, round(CASE WHEN len(n.a) = 0 OR len(n.b) = 0 THEN CASE WHEN len(n.a) = len(n.b) THEN 1.0 ELSE 0.0 END ELSE 2.0 * r.cells[-1] / (len(n.a) + len(n.b)) END, 9) AS rouge FROM n JOIN r ON r.k = n.k AND r.i = len(n.a)"""
