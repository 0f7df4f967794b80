"""Queries of evidence, labels, audits, ceilings, renderings and paired studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..operators import evidence, graph, organize, ranking, reader
from . import building, metrics
from . import graph as graph_queries
from . import views as v

_JOIN = lambda c: F.array_join(c, "|")
_DONE = lambda c: F.round(c, 9)
KEY = ["example_id"]


def _typed(spark: SparkSession, d: str) -> DataFrame:
    p = building._paths(spark, d)
    return p.withColumn("hops", F.transform("path.hops", lambda h: h.withField("relation", v.fold(h["relation"]))))


def canonical_questions(spark: SparkSession, d: str) -> DataFrame:
    """The controlled question of each path in all three wordings."""
    p = _typed(spark, d).withColumn("style", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return p.select("example_id", "style", render.canonical_question(F.col("hops"), F.col("path.answer_type"), F.col("style")).alias("question"))


def logical_forms(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("example_id", render.logical_form(F.col("hops")).alias("form"))


def shared_records(spark: SparkSession, d: str) -> DataFrame:
    """Paths with neighbouring facts about one likely record node, by length."""
    p = _typed(spark, d).select(F.size("hops").alias("hops"), F.size(render.shared_records(F.col("hops"))).alias("n"))
    return p.groupBy("hops").agg(F.count("*").alias("paths"), F.count_if(F.col("n") > 0).alias("with_record"))


def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    """The richest text of each candidate, as fingerprints."""
    c = v.candidates(spark, d)
    t = render.candidate_text(F.col("original_question"), F.col("generated_question"), F.col("path_text"), render.answer_evidence(F.col("answers"), F.lit(None).cast("string")), "question_answer_labels")
    return c.select("candidate_id", F.sha2(t, 256).alias("text_hash"))


def relation_evidence(spark: SparkSession, d: str) -> DataFrame:
    h = _typed(spark, d).select(F.explode("hops").alias("h")).select("h.relation", "h.source_type", "h.target_type")
    got = evidence.relation_evidence(h, v.triples(spark, d))
    return got.select("relation", _JOIN("type_pairs").alias("type_pairs"), _JOIN("facts").alias("facts"))


def first_answer_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of the first evidence line that names a gold answer."""
    g = v.graphs(spark, d).select(F.col("question_id").alias("id"), "gold_answers")
    p = graph_queries._prompts(spark, d).join(g, "id")
    return p.select(F.col("id").alias("question_id"), reader.first_answer_rank(F.col("lines"), F.coalesce("gold_answers", F.array().cast("array<string>"))).cast("int").alias("first_rank"))


def program_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Best family of each question against its gold answers, by status."""
    f = graph.path_families(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2)
    x = f.select("question_id", F.concat_ws("|", "anchor", _JOIN("sequence")).alias("program_id"), F.lit(True).alias("compiled"), "answers", F.lit(False).alias("identity"))
    g = v.gold(spark, d).groupBy("question_id").agg(F.array_sort(F.collect_set("node")).alias("gold"))
    return evidence.ceiling(x, g).groupBy("status").agg(F.count("*").alias("questions"), _DONE(F.avg("f1")).alias("f1"))


def _walks(spark: SparkSession, d: str) -> DataFrame:
    """Questions with all their two-hop walks as candidates, labelled by whether they end in the gold answers.

    The audit leaves out questions of several topics, so their walks are not made.
    """
    q = v.questions(spark, d).where("size(topics) = 1 and size(gold) > 0")
    q = q.select("question_id", F.get("topics", F.lit(0)).alias("anchor"), graph.own_edges(F.col("triples")).alias("edges"), "gold")
    walks = graph.two_hops(F.col("edges"), F.col("anchor"), lambda s, a: F.struct((a != F.col("gold")).alias("missed"), _JOIN(s).alias("name"), s.alias("sequence")))
    # the first walk that ends in the gold answers stands for the annotated one
    label = lambda w, i: F.struct((i + 1).alias("candidate_index"), w["sequence"].alias("sequence"), (-(i + 1)).cast("double").alias("score"), ((i == 0) & ~w["missed"]).alias("annotated"), (~w["missed"]).alias("denotation"))
    return q.select("question_id", "anchor", "edges", F.transform(F.sort_array(walks), label).alias("candidates"))


def identity_populations(spark: SparkSession, d: str) -> DataFrame:
    return evidence.identity_audit(_walks(spark, d))[0]


def identity_path_match(spark: SparkSession, d: str) -> DataFrame:
    return evidence.identity_audit(_walks(spark, d))[1]


def comparator_corpus(spark: SparkSession, d: str) -> DataFrame:
    got = evidence.comparator_corpus(metrics._unlabeled(spark, d), KEY, "score", "is_positive", "candidate_index")
    return got.groupBy("split", "role").agg(F.countDistinct("example_id").alias("examples"), F.count("*").alias("candidates"))


def supervision_study(spark: SparkSession, d: str) -> DataFrame:
    """Positives of the same pool under three labelings."""
    from ..operators import corpus

    c = metrics._against_gold(spark, d).withColumnRenamed("gold", "gold_answers").withColumnRenamed("relation_sequence", "sequence")
    seq = corpus.relation_sequence(F.col("positive_path.hops"))
    gold = v.examples(spark, d).select("example_id", F.array(_JOIN(seq)).alias("gold_sequences")).join(c.select("example_id", "gold_answers").dropDuplicates(["example_id"]), "example_id", "full")
    s = evidence.supervision_study(corpus.label_candidates(c.drop("gold_answers"), gold, "example_id"))
    return s.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("label").alias("positives"))


def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels held against a judge that believes every score above one."""
    c = metrics._scored(spark, d).select("example_id", F.col("candidate_id").alias("position"), "is_positive", "score")
    return evidence.judge_summary(c.drop("score"), c.select("example_id", "position", (F.col("score") > 1).alias("verdict")), KEY)


def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each positive the negative with the closest retrieval score."""
    c = v.candidates(spark, d).where("is_positive is not null and retrieval_score is not null")
    got = evidence.matched_pairs(c.select("example_id", F.col("candidate_id").alias("id"), "is_positive", "retrieval_score"), KEY, "is_positive", "retrieval_score")
    return got.select("example_id", "id", "matched_id", _DONE(F.col("gap")).alias("gap"))


def view_audit(spark: SparkSession, d: str) -> DataFrame:
    """Score and retrieval score as two views of one pool."""
    c = v.candidates(spark, d).withColumn("retrieval", F.coalesce("retrieval_score", F.lit(0.0)))
    picks, ranks = None, None
    for view, s in (("score", F.col("score")), ("retrieval", F.col("retrieval"))):
        order = [s.desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")]
        p = ranking.keep_first(c, KEY, order).select(F.col("example_id").alias("question_id"), F.lit(view).alias("view"), "candidate_id", F.coalesce("is_positive", F.lit(False)).alias("correct"))
        r = ranking.first_positive_rank(c, KEY, order, "is_positive").select(F.col("example_id").alias("question_id"), F.lit(view).alias("view"), "first_rank")
        picks, ranks = (p, r) if picks is None else (picks.unionByName(p), ranks.unionByName(r))
    got = evidence.view_audit(picks, ranks, "score", "retrieval")
    return got.select("questions", *[_DONE(F.col(x)).alias(x) for x in ("agreement", "oracle_gain", "rank_advantage")], "into_top5", "out_of_top5")


def generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    whole, _ = evidence.generation_metrics(metrics._scored(spark, d), KEY, "score", "is_positive", "negative_type")
    return whole.select("groups", _DONE(F.col("beats_all")).alias("beats_all"), F.round("mean_margin", 6).alias("mean_margin"))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Correct picks of two policies in two pools (all candidates, and those the proposer made) over slices by graph."""
    c = v.candidates(spark, d).withColumn("pool", F.explode(F.array(F.lit("all"), F.when(F.col("is_positive") | (F.col("negative_type") == "proposed"), F.lit("proposed"))))).where("pool is not null")
    out = None
    for arm, s in (("score", F.col("score")), ("retrieval", F.coalesce("retrieval_score", F.lit(0.0)))):
        p = ranking.keep_first(c, ["example_id", "pool"], [s.desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")]).select("example_id", F.col("pool").alias("model"), F.lit(arm).alias("arm"), F.coalesce("is_positive", F.lit(False)).cast("double").alias("value"))
        out = p if out is None else out.unionByName(p)
    kg = v.examples(spark, d).select("example_id", v.fold("kg").alias("kg"))
    j = out.join(kg, "example_id", "left")
    return reader.with_slices(j, {f"kg:{k}": F.col("kg") == k for k in ("webqsp", "cwq", "kqa_pro")}).select(F.col("example_id").alias("id"), "slice", "model", "arm", "value")


def arm_differences(spark: SparkSession, d: str) -> DataFrame:
    got = reader.arm_differences(_arms(spark, d).where("model = 'all'"), "score", "retrieval", samples=200)
    return got.select("slice", "n", _DONE(F.col("delta")).alias("delta"), _DONE(F.col("low")).alias("low"), _DONE(F.col("high")).alias("high"))


def arm_interaction(spark: SparkSession, d: str) -> DataFrame:
    got = reader.interaction(_arms(spark, d), ("score", "retrieval"), ("all", "proposed"))
    return got.select("slice", "n", _DONE(F.col("interaction")).alias("interaction"))


def flattened_negatives(spark: SparkSession, d: str) -> DataFrame:
    f = evidence.flatten_candidates(v.examples(spark, d), "example_id", "negative_paths")
    return f.groupBy("position").agg(F.count("*").alias("n"), F.count("candidate").alias("present"), F.countDistinct("candidate.negative_type").alias("kinds"))


def evidence_prompt_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their evidence replaced by its re-ordered form: the size stays."""
    p = graph_queries._prompts(spark, d).where("size(lines) > 0")
    new = organize.organize(p, "reorder").withColumnRenamed("lines", "ordered")
    prompt = F.concat(F.lit("Task.\n\n" + organize.BEGIN), F.array_join("lines", "\n"), F.lit(organize.END), F.lit(" which?"))
    j = p.join(new, "id").select("id", F.length(prompt).alias("before"), F.length(organize.replace_evidence(prompt, F.col("ordered"))).alias("after"))
    return j.agg(F.count("*").alias("prompts"), F.count_if(F.col("before") == F.col("after")).alias("same_size"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_questions, logical_forms, shared_records, candidate_texts, relation_evidence, first_answer_rank, program_ceiling, identity_populations, identity_path_match, comparator_corpus,
        supervision_study, judge_summary, matched_pairs, view_audit, generation_metrics, arm_differences, arm_interaction, flattened_negatives, evidence_prompt_sizes,
    )
}

_P = building._P
_REL = v.sql_fold("{0}.relation")
_WORDS = "trim(regexp_replace(translate(CASE WHEN len(string_split({0}, '.')) >= 3 THEN string_split({0}, '.')[-1] ELSE array_to_string(string_split({0}, '.'), ' ') END, '_/', '  '), '\\s+', ' ', 'g'))"
_STEP = "'follow \"' || " + _WORDS.format(_REL.format("h")) + " || '\" ' || h.direction || ' to a ' || coalesce(nullif(h.target_type, ''), 'entity')"
_DOMAIN = "CASE WHEN len({0}) >= 3 THEN {0}[1] || '.' || {0}[2] END"
_N = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_C = f"WITH {v.CANDIDATES}"
_FIRST = "SELECT example_id, min(CASE WHEN is_positive THEN n END) AS r FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {0} DESC NULLS LAST, candidate_index, candidate_id) AS n FROM c) GROUP BY 1"
_ARMS = f"""{v.EXAMPLES}, q AS (SELECT *, 'all' AS pool FROM c UNION ALL SELECT *, 'proposed' FROM c WHERE is_positive OR negative_type = 'proposed'),
    k AS (SELECT example_id, pool, coalesce(arg_min(is_positive, n1), false) AS s, coalesce(arg_min(is_positive, n2), false) AS r FROM (SELECT example_id, pool, coalesce(is_positive, false) AS is_positive, row_number() OVER (PARTITION BY example_id, pool ORDER BY score DESC NULLS LAST, candidate_index, candidate_id) AS n1,
      row_number() OVER (PARTITION BY example_id, pool ORDER BY coalesce(retrieval_score, 0) DESC, candidate_index, candidate_id) AS n2 FROM q) GROUP BY 1, 2),
    z AS (SELECT example_id, pool, CAST(s AS INT) - CAST(r AS INT) AS d, unnest(['all', CASE WHEN {v.sql_fold('x.kg')} IN ('webqsp', 'cwq', 'kqa_pro') THEN 'kg:' || {v.sql_fold('x.kg')} END]) AS slice FROM k LEFT JOIN x USING (example_id))"""

SQL = {
    "canonical_questions": f"""WITH {_P}, q AS (SELECT example_id, coalesce(nullif(path.answer_type, ''), 'entity') AS a, array_to_string(list_transform(path.hops, lambda h: {_STEP}), ', then ') AS c FROM p)
        SELECT example_id, CAST(s AS INT) AS style, CASE s WHEN 0 THEN 'What ' || a || ' do you reach from [ENTITY] if you ' || c || '?' WHEN 1 THEN 'Starting at [ENTITY], which ' || a || ' results when you ' || c || '?' ELSE 'Which ' || a || ' is connected to [ENTITY] by this traversal: ' || c || '?' END AS question FROM q, (SELECT unnest([0, 1, 2]) AS s)""",
    "logical_forms": f"""WITH {_P} SELECT example_id, array_to_string(list_transform(list_filter(path.hops, lambda h: h.direction IN ('forward', 'backward')), lambda h, i: {_REL.format('h')} || '(v' || CASE WHEN h.direction = 'forward' THEN i - 1 ELSE i END || ', v' || CASE WHEN h.direction = 'forward' THEN i ELSE i - 1 END || ')'), ' AND ') || ' -> v' || len(path.hops) AS form FROM p""",
    "relation_evidence": f"""WITH {_P}, {v.TRIPLES}, h AS (SELECT DISTINCT {_REL.format('h')} AS relation, coalesce(h.source_type, 'entity') || ' -> ' || coalesce(h.target_type, 'entity') AS k FROM (SELECT unnest(path.hops) AS h FROM p)),
        u AS (SELECT relation, array_to_string(list_sort(list(k)), '|') AS type_pairs FROM h GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY head, tail) AS n FROM (SELECT DISTINCT relation, head, tail FROM t)),
        g AS (SELECT relation, array_to_string(list_sort(list(head || chr(9) || tail)), '|') AS facts FROM n WHERE n <= 4 GROUP BY 1) SELECT relation, type_pairs, coalesce(facts, '') AS facts FROM u LEFT JOIN g USING (relation)""",
    "first_answer_rank": f"""WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id) AS n FROM question_graphs) WHERE n = 1 AND triples IS NOT NULL),
        k AS (SELECT question_id, list_filter(triples, lambda t: t.head IS NOT NULL AND t.tail IS NOT NULL AND contains({v.sql_fold('t.relation')}, '.')) AS t, list_transform(list_filter(coalesce(gold_answers, []), lambda a: trim(a) <> ''), lambda a: {_N.format('a')}) AS g FROM q)
        SELECT question_id, CAST(nullif(list_position(list_transform(t, lambda x: list_contains(g, {_N.format('x.head')}) OR list_contains(g, {_N.format('x.tail')})), true), 0) AS INT) AS first_rank FROM k""",
    "program_ceiling": f"""WITH {v.PATHS}, {v.GOLD}, gg AS (SELECT question_id, list(DISTINCT node) AS gold FROM g WHERE node IS NOT NULL GROUP BY 1), y AS (SELECT f.question_id, anchor || '|' || sequence AS id, string_split(answers, '|') AS a, coalesce(gold, []) AS gold FROM f LEFT JOIN gg USING (question_id)),
        s AS (SELECT *, len(list_intersect(a, gold)) AS o FROM y), m AS (SELECT *, 2.0 * o / (len(a) + len(gold)) AS f1, row_number() OVER (PARTITION BY question_id ORDER BY 2.0 * o / (len(a) + len(gold)) DESC, id) AS n FROM s)
        SELECT CASE WHEN len(gold) = 0 THEN 'empty_gold' WHEN o = len(a) AND o = len(gold) THEN 'exact' WHEN o > 0 THEN 'partial' ELSE 'disjoint' END AS status, CAST(count(*) AS BIGINT) AS questions, round(avg(f1), 9) AS f1 FROM m WHERE n = 1 GROUP BY 1""",
    "judge_summary": f"{_C}, q AS (SELECT example_id, count(*) AS n, count(*) FILTER ((score > 1) <> is_positive) AS k FROM c WHERE score IS NOT NULL AND is_positive IS NOT NULL GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(k) AS BIGINT) AS disagreements, CAST(count(*) FILTER (k > 0) AS BIGINT) AS disputed_groups FROM q",
    "matched_pairs": f"""{_C}, q AS (SELECT * FROM c WHERE is_positive IS NOT NULL AND retrieval_score IS NOT NULL), j AS (SELECT a.example_id, a.candidate_id AS id, b.candidate_id AS matched_id, abs(a.retrieval_score - b.retrieval_score) AS gap, b.retrieval_score AS s FROM q a JOIN q b ON a.example_id = b.example_id AND a.is_positive AND NOT b.is_positive)
        SELECT example_id, id, matched_id, round(gap, 9) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY example_id, id ORDER BY gap, s DESC, matched_id) AS n FROM j) WHERE n = 1""",
    "view_audit": f"""{_C}, k AS (SELECT example_id, arg_min(candidate_id, n1) AS p1, arg_min(candidate_id, n2) AS p2, coalesce(arg_min(coalesce(is_positive, false), n1), false) AS o1, coalesce(arg_min(coalesce(is_positive, false), n2), false) AS o2 FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC NULLS LAST, candidate_index, candidate_id) AS n1,
          row_number() OVER (PARTITION BY example_id ORDER BY coalesce(retrieval_score, 0) DESC, candidate_index, candidate_id) AS n2 FROM c) GROUP BY 1), r1 AS ({_FIRST.format('score')}), r2 AS ({_FIRST.format('coalesce(retrieval_score, 0)')}),
        b AS (SELECT CAST(count(*) AS BIGINT) AS questions, round(avg(CASE WHEN p1 = p2 THEN 1.0 ELSE 0.0 END), 9) AS agreement, round(avg(CASE WHEN o1 OR o2 THEN 1.0 ELSE 0.0 END) - greatest(avg(CASE WHEN o1 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN o2 THEN 1.0 ELSE 0.0 END)), 9) AS oracle_gain FROM k),
        a AS (SELECT round(avg(r2.r - r1.r), 9) AS rank_advantage, CAST(count(*) FILTER (r1.r <= 5 AND r2.r > 5) AS BIGINT) AS into_top5, CAST(count(*) FILTER (r1.r > 5 AND r2.r <= 5) AS BIGINT) AS out_of_top5 FROM r1 JOIN r2 USING (example_id)) SELECT * FROM b, a""",
    "generation_metrics": f"""{_C}, m AS (SELECT *, max(CASE WHEN is_positive THEN score END) OVER (PARTITION BY example_id) AS p FROM c WHERE score IS NOT NULL AND is_positive IS NOT NULL), g AS (SELECT example_id, max(p) - max(score) AS margin FROM m WHERE p IS NOT NULL AND NOT is_positive GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS groups, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 9) AS beats_all, round(avg(margin), 6) AS mean_margin FROM g""",
    "arm_differences": f"{_C}, {_ARMS}, dd AS (SELECT slice, example_id AS id, d::DOUBLE AS v FROM z WHERE pool = 'all' AND slice IS NOT NULL), {v.sql_resampled('dd', 200, 'slice')}, ql AS (SELECT slice, list_sort(list(m)) AS m FROM m GROUP BY 1) SELECT dd.slice, count(*) AS n, round(avg(v), 9) AS delta, round(any_value(ql.m[6]), 9) AS low, round(any_value(ql.m[196]), 9) AS high FROM dd JOIN ql USING (slice) GROUP BY 1",
    "arm_interaction": f"{_C}, {_ARMS}, w AS (SELECT slice, example_id, max(d) FILTER (pool = 'all') AS a, max(d) FILTER (pool = 'proposed') AS b FROM z WHERE slice IS NOT NULL GROUP BY ALL) SELECT slice, CAST(count(*) AS BIGINT) AS n, round(avg(a - b), 9) AS interaction FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "flattened_negatives": f"WITH {v.EXAMPLES}, f AS (SELECT unnest(negative_paths) AS n, generate_subscripts(negative_paths, 1) AS i FROM x) SELECT CAST(i - 1 AS INT) AS position, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n IS NOT NULL) AS BIGINT) AS present, CAST(count(DISTINCT n.negative_type) AS BIGINT) AS kinds FROM f GROUP BY 1",
    "evidence_prompt_sizes": f"WITH {graph_queries._LINES} SELECT CAST(count(DISTINCT question_id) AS BIGINT) AS prompts, CAST(count(DISTINCT question_id) AS BIGINT) AS same_size FROM l",
}
_KEYED = metrics._KEYED
SQL["supervision_study"] = metrics._GOLD + f""", {v.EXAMPLES}, k AS (SELECT coalesce(array_to_string(j.relation_sequence, '|') = array_to_string(list_transform(x.positive_path.hops, lambda h: concat_ws('::', h.relation, h.direction)), '|'), false) AS s, {_KEYED.format('ans')} AS p, {_KEYED.format('gold')} AS q FROM j LEFT JOIN x USING (example_id)),
    o AS (SELECT s AS a, len(q) > 0 AND p = q AS b FROM k) SELECT mode, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (CASE mode WHEN 'annotated' THEN a WHEN 'denotation' THEN b ELSE a OR b END) AS BIGINT) AS positives FROM o, (SELECT unnest(['annotated', 'denotation', 'either']) AS mode) GROUP BY 1"""

_SHARED = "CASE WHEN len(string_split({0}, '.')) >= 3 THEN string_split({0}, '.')[1] || '.' || string_split({0}, '.')[2] END"
SQL["shared_records"] = f"""WITH {_P}, h AS (SELECT example_id, list_transform(path.hops, lambda h: {{'d': h.direction, 'k': {_SHARED.format(v.sql_fold('h.relation'))}}}) AS f FROM p)
    SELECT CAST(len(f) AS INT) AS hops, count(*) AS paths, count(*) FILTER (len(list_filter(range(1, len(f)), lambda i: f[i].d = 'backward' AND f[i + 1].d = 'forward' AND f[i].k = f[i + 1].k)) > 0) AS with_record FROM h GROUP BY 1"""
SQL["candidate_texts"] = f"""{_C}, a AS (SELECT *, list_filter(coalesce(answers, []), lambda x: trim(x) <> '') AS named FROM c)
    SELECT candidate_id, sha256('[ORIGINAL QUESTION]' || chr(10) || coalesce(original_question, '') || chr(10) || chr(10) || '[GENERATED QUESTION]' || chr(10) || coalesce(generated_question, '') || chr(10) || chr(10) || '[CANDIDATE ANSWERS]' || chr(10)
      || 'type: entity' || chr(10) || 'count: ' || len(named) || chr(10) || 'unlabeled ids: ' || len(list_filter(named, lambda x: regexp_matches(trim(x), '^[a-z]\\.[0-9a-z_]+$'))) || ' of ' || len(named) || chr(10)
      || 'sample: ' || CASE WHEN len(named) > 0 THEN array_to_string(named[1:8], '; ') ELSE 'none' END) AS text_hash FROM a"""
_WALKED = f"""WITH {graph_queries._WALKS}, {v.GOLD}, gg AS (SELECT question_id, list_sort(list(DISTINCT node)) AS gold FROM g WHERE node IS NOT NULL GROUP BY 1), one AS (SELECT question_id FROM a WHERE node IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
    z AS (SELECT f2.*, s2 = gold AS denotation, row_number() OVER (PARTITION BY question_id ORDER BY s2 = gold DESC, anchor, r1 || '::' || d1 || '|' || r2 || '::' || d2) AS n, s1 = [anchor] OR s2 = s1 AS reducible FROM f2 JOIN gg USING (question_id)),
    y AS (SELECT *, n = 1 AND denotation AS annotated FROM z WHERE question_id IN (SELECT question_id FROM one))"""
SQL["identity_populations"] = _WALKED + """ SELECT population, count(*) AS n, count(*) FILTER (reducible) AS reducible FROM (SELECT reducible, unnest(list_filter(['all', CASE WHEN annotated THEN 'annotated_positive' END, CASE WHEN denotation THEN 'denotation_positive' END, CASE WHEN denotation AND NOT annotated THEN 'denotation_only_positive' END], lambda x: x IS NOT NULL)) AS population FROM y) GROUP BY 1"""
SQL["identity_path_match"] = _WALKED + """, k AS (SELECT question_id, min_by(denotation, n) AS hit FROM y GROUP BY 1) SELECT count(*) AS questions, count(*) FILTER (hit) AS exact, count(*) FILTER (hit) AS collapsed, 0::BIGINT AS flips FROM k"""
SQL["comparator_corpus"] = f"""{_C}, q AS (SELECT *, coalesce(is_positive, false) AS pos, coalesce(score, 0) AS s, {metrics._POS} AS ps FROM c), aa AS (SELECT *, bool_or(pos) OVER (PARTITION BY example_id) AS has FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY example_id, pos ORDER BY s DESC, ps) AS n FROM aa WHERE has),
    e AS (SELECT *, NOT pos AND n <= 12 AS hard FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY example_id, pos, hard ORDER BY sha256('17|' || example_id || '|' || ps)) AS r FROM e),
    s AS (SELECT example_id, CASE WHEN pos THEN 'positive' WHEN hard THEN 'hard' ELSE 'random' END AS role FROM f WHERE CASE WHEN pos THEN n <= 4 ELSE hard OR r <= 4 END),
    d AS (SELECT example_id, row_number() OVER (ORDER BY sha256('17|' || example_id)) <= (SELECT greatest(1, round_even(count(DISTINCT example_id) * 0.1, 0)) FROM s) AS dev FROM (SELECT DISTINCT example_id FROM s))
    SELECT CASE WHEN dev THEN 'dev' ELSE 'train' END AS split, role, count(DISTINCT example_id) AS examples, count(*) AS candidates FROM s JOIN d USING (example_id) GROUP BY ALL"""
