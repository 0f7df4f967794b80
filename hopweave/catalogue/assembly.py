"""Queries of retrieval, example assembly, run comparison, pilots and request lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render, text
from ..operators import assembly, evidence, graph, pilot, ranking, requests, retrieval, runs
from ..plans import programs
from ..session import table
from . import building, metrics, studies
from . import graph as graph_queries
from . import views as v

_DONE = lambda c: F.round(c, 9)
_JOIN = lambda c: F.array_join(c, "|")


def _gold_families(spark: SparkSession, d: str) -> DataFrame:
    """Families of at most two hops that end exactly in the gold answers."""
    g = v.gold(spark, d).groupBy("question_id").agg(_JOIN(F.array_sort(F.collect_set("node"))).alias("gold_key"))
    f = graph.path_families(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2).join(g, "question_id")
    return f.where(_JOIN("answers") == F.col("gold_key")).select("question_id", "sequence")


def _patterns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    questions = v.graphs(spark, d).select("question_id", "question")
    return retrieval.executable_patterns(graph.edges(v.triples(spark, d)), v.topics(spark, d), _gold_families(spark, d), questions, 20)


def executable_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best patterns of each question that keeps a gold one."""
    return _patterns(spark, d)[0].select("question_id", _JOIN("sequence").alias("sequence"), _DONE(F.col("score")).alias("score"), "rank", "is_gold")


def pattern_recall(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d)[1].select("questions", "gold_in_graph", "gold_after_cap", _DONE(F.col("average_candidates")).alias("average_candidates"))


def best_families(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved paths of each example once, at their best retrieval score, the five best."""
    c = v.candidates(spark, d).select(F.col("example_id").alias("question_id"), "anchor", F.col("relation_sequence").alias("sequence"), F.coalesce("retrieval_score", F.lit(0.0)).alias("score"), "answers")
    return retrieval.best_families(c.where("anchor is not null and not exists(sequence, x -> x is null)"), 5).select("question_id", "anchor", _JOIN("sequence").alias("sequence"), _DONE(F.col("score")).alias("score"), "rank")


def gold_sequence_available(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose graph can run one of the twenty most frequent training sequences of at most two hops from a topic."""
    s = building._paths(spark, d).where("size(path.hops) <= 2").select(F.transform("path.hops", lambda h: text.directed(v.fold(h["relation"]), h["direction"])).alias("sequence"))
    top = s.groupBy("sequence").count().orderBy(F.desc("count"), _JOIN("sequence")).limit(20).agg(F.collect_list("sequence").alias("s"))
    q = v.graphs(spark, d).select("question_id").crossJoin(F.broadcast(top)).select("question_id", F.explode("s").alias("sequence"))  # one row of twenty sequences
    got = retrieval.gold_available(graph.edges(v.triples(spark, d)), v.topics(spark, d), q)
    return got.groupBy("available").agg(F.count("*").alias("questions"))


def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A hundred paths of each graph and depth from the topics, by hash."""
    p = graph.simple_paths(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2)
    kg = v.graphs(spark, d).select("question_id", v.fold("kg").alias("kg")).where("kg is not null")
    got = assembly.synthesize(p.join(kg, "question_id").select("kg", "anchor", "sequence", F.element_at("nodes", -1).alias("end")), 100)
    return got.select("kg", "anchor", _JOIN("sequence").alias("sequence"), "end", "depth", "split")


def assembled_examples(spark: SparkSession, d: str) -> DataFrame:
    """Accepted examples with their surviving negatives, rejected ones with the reason."""
    good, bad = assembly.assemble(v.examples(spark, d))
    kept = good.select("example_id", F.lit("accepted").alias("outcome"), F.size("negative_paths").alias("negatives"))
    return kept.unionByName(bad.select("example_id", F.col("reason").alias("outcome"), F.lit(0).alias("negatives")))


def direction_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples of relations read both ways, each also the other way round."""
    rows = v.examples(spark, d).select(F.col("example_id").alias("id"), "question", F.col("positive_path").alias("path"))
    got = assembly.both_directions(assembly.direction_examples(building.direction_pairs(spark, d), rows))
    return got.select("example_id", "split", "kg", _JOIN("sequence").alias("sequence"), "forward_id", "question", "negative_question")


def pool_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    c = metrics._unlabeled(spark, d)
    return runs.pool_fingerprints(c, "example_id", "candidate_index", "relation_sequence")


def answer_equivalent_paths(spark: SparkSession, d: str) -> DataFrame:
    """Walks that end in the gold answers without standing for the annotated path."""
    _, c = studies._walks(spark, d)
    return runs.answer_equivalent(c).select("question_id", "candidate_index", _JOIN("sequence").alias("sequence"))


def pair_means(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d).select("negative_type", "retrieval_score", (F.col("score") - F.col("retrieval_score")).alias("lead"))
    got = runs.pair_means(c, "negative_type", ["retrieval_score", "lead"])
    return got.select("negative_type", "pairs", _DONE(F.col("mean_retrieval_score")).alias("mean_retrieval_score"), F.round("mean_lead", 6).alias("mean_lead"))


def pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty questions whose answer stands first in the evidence and thirty where it stands later."""
    r = studies.first_answer_rank(spark, d).select(F.col("question_id").alias("id"), F.col("first_rank").alias("evidence_rank"))
    return pilot.select_pilot(r, 30, {"first": (1, 1), "later": (2, 1000)})


def _campaign(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits of three picks in two pools, and slices by graph and length."""
    c = v.candidates(spark, d).withColumn("model", F.explode(F.array(F.lit("all"), F.when(F.col("is_positive") | (F.col("negative_type") == "proposed"), F.lit("proposed"))))).where("model is not null")
    arms = {"score": [F.col("score").desc_nulls_last()], "retrieval": [F.coalesce("retrieval_score", F.lit(0.0)).desc()], "first": []}
    out = None
    for arm, order in arms.items():
        p = ranking.keep_first(c, ["example_id", "model"], [*order, F.col("candidate_index"), F.col("candidate_id")]).select(F.col("example_id").alias("id"), "model", F.lit(arm).alias("arm"), F.lit("hit").alias("metric"), F.coalesce("is_positive", F.lit(False)).cast("double").alias("value"))
        out = p if out is None else out.unionByName(p)
    names = F.array_compact(F.array(F.lit("all"), F.when(F.size("positive_path.hops") >= 2, F.lit("several_hops")), F.when(F.size("positive_path.hops") == 1, F.lit("one_hop"))))
    return out, v.examples(spark, d).select(F.col("example_id").alias("id"), F.explode(names).alias("slice"))


def campaign_means(spark: SparkSession, d: str) -> DataFrame:
    return pilot.arm_means(*_campaign(spark, d)).withColumn("mean", _DONE(F.col("mean")))


_PAIRS = [("score", "first"), ("retrieval", "first"), ("score", "retrieval")]


def campaign_effects(spark: SparkSession, d: str) -> DataFrame:
    got = pilot.effects(*_campaign(spark, d), _PAIRS, samples=100)
    return got.select("slice", "model", "metric", "comparison", "n", *[_DONE(F.col(c)).alias(c) for c in ("delta", "low", "high")])


def campaign_interactions(spark: SparkSession, d: str) -> DataFrame:
    got = pilot.interactions(*_campaign(spark, d), _PAIRS[:2], ("all", "proposed"), samples=100)
    return got.select("slice", "metric", "comparison", "n", *[_DONE(F.col(c)).alias(c) for c in ("interaction", "low", "high")])


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "path_naturalizations").where("id is not null and canonical_question is not null").groupBy("row_id").agg(F.min("id").alias("id"), F.min("canonical_question").alias("prompt"))


def naturalization_requests(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in batches of eight as request lines."""
    got = requests.batched(_items(spark, d), 8, "row_id", F.concat_ws(": ", "id", "prompt"))
    line = requests.chat_request(F.concat(F.lit("batch-"), "batch"), "Rewrite every question.", F.array_join("items", "\n"), "any")
    return got.select("batch", F.size("items").alias("n_items"), line.alias("line"))


def parsed_results(spark: SparkSession, d: str) -> DataFrame:
    """Returned items written as result lines, read back and counted: a later item of an id replaces an earlier one."""
    t = table(spark, d, "path_naturalizations").where("id is not null").select("row_id", "id", "status", "question", "reason").distinct()
    item = F.to_json(F.struct(F.array(F.struct("id", "status", "question", "reason")).alias("items")))
    fenced = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(item)
    content = F.when(F.col("row_id") % 50 == 0, F.lit("no json")).otherwise(fenced)
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    lines = t.select(F.to_json(F.struct(F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response"))).alias("value"), F.lit("f").alias("file"), F.col("row_id").alias("line_no"))
    good, bad = requests.parse_results(lines)
    kept = good.groupBy(v.fold("status").alias("outcome")).agg(F.count("*").alias("n"), F.count("question").alias("questions"))
    return kept.unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("questions")))


def margin(spark: SparkSession, d: str) -> DataFrame:
    """Lead of the best score over the second in each pool."""
    got = ranking.argmax(metrics._unlabeled(spark, d), ["example_id"], F.col("score"), "candidate_index")
    return got.select("example_id", "candidate_id", F.round("margin", 6).alias("margin"))


def conj_self_loop(spark: SparkSession, d: str) -> DataFrame:
    """Nodes reached from the topic that the relation also joins to themselves."""
    r = "stagework.observatory.first_director"
    p = programs.Conjunctive("?x", (programs.Atom(programs.TOPIC, r, "?x"), programs.Atom("?x", r, "?x")))
    return programs.run_conjunctive(v.triples(spark, d), p, v.topics(spark, d).withColumnRenamed("node", "topic"), unique=True).answers


def stratified_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred examples over the sides in proportion to their sizes, in turn by length and graph."""
    x = v.examples(spark, d).where("positive_path is not null and kg is not null and split is not null")
    side = F.regexp_extract(F.lower(F.trim("split")), "^(train|dev|test)", 1)
    x = x.select("example_id", side.alias("side"), v.fold("kg").alias("kg"), F.coalesce(F.size("positive_path.hops"), F.lit(-1)).alias("hops"))
    got = ranking.stratified_selection(x, "side", ["train", "dev", "test"], ["hops", "kg"], [F.sha2("example_id", 256)], 300)
    return got.select("example_id", "side", F.col("place").cast("long").alias("place"))


def adjudication_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels judged by scores above one and again by scores above 1.2."""
    c = metrics._scored(spark, d).select("example_id", F.col("candidate_id").alias("position"), "is_positive", "score").withColumn("verdict", F.col("score") > 1)
    picks = evidence.adjudication_picks(c, ["example_id"], 50)
    _, counts = evidence.apply_adjudication(c.drop("verdict"), picks, c.select("example_id", "position", (F.col("score") > 1.2).alias("verdict")), ["example_id"])
    return counts


def represented_queries(spark: SparkSession, d: str) -> DataFrame:
    q = studies._typed(spark, d).where(~F.exists("hops", lambda h: ~h["direction"].isin("forward", "backward"))).select("example_id", render.represent_query(F.col("hops")).alias("q"))
    return q.select("example_id", F.array_join(F.transform("q.variables", lambda x: F.concat_ws(":", x["id"], x["type"])), " ").alias("variables"), F.size("q.facts").alias("facts"), "q.form", "q.answer", "q.answer_type")


def compact_queries(spark: SparkSession, d: str) -> DataFrame:
    """Paths as required facts in the words of the glossary."""
    p = studies._typed(spark, d).where(~F.exists("hops", lambda h: ~h["direction"].isin("forward", "backward"))).select("example_id", v.fold("path.kg").alias("kg"), "hops")
    got = evidence.compact_queries(p, table(spark, d, "relation_glossary"))
    return got.select("example_id", "query", _JOIN("unusable").alias("unusable"))


def ceiling_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Best families against gold answers, by graph and status."""
    f = graph.path_families(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2)
    x = f.select("question_id", F.concat_ws("|", "anchor", _JOIN("sequence")).alias("program_id"), F.lit(True).alias("compiled"), "answers", F.lit(False).alias("identity"))
    g = v.gold(spark, d).groupBy("question_id").agg(F.array_sort(F.collect_set("node")).alias("gold"))
    kinds = v.graphs(spark, d).select("question_id", v.fold("kg").alias("kind"))
    got = evidence.ceiling_by_kind(evidence.ceiling(x, g), kinds)
    return got.select("kind", "status", "questions", _DONE(F.col("f1")).alias("f1"))


QUERIES = {
    f.__name__: f
    for f in (
        stratified_by_split, adjudication_summary, represented_queries, compact_queries, ceiling_by_kind,
        executable_patterns, pattern_recall, best_families, gold_sequence_available, synthetic_corpus, assembled_examples, direction_examples, pool_fingerprints, answer_equivalent_paths,
        pair_means, pilot_sample, campaign_means, campaign_effects, campaign_interactions, naturalization_requests, parsed_results, margin, conj_self_loop,
    )
}

_WORDS = building._WORDS
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_MINE = f"""WITH {v.PATHS}, {v.GOLD}, k AS (SELECT question_id, array_to_string(list_sort(list(DISTINCT node)), '|') AS gold_key FROM g WHERE node IS NOT NULL GROUP BY 1),
    gold AS (SELECT DISTINCT f.question_id, f.sequence FROM f JOIN k USING (question_id) WHERE f.answers = k.gold_key),
    lim AS (SELECT question_id, max(len(string_split(sequence, '|'))) AS lim FROM gold GROUP BY 1),
    s AS (SELECT DISTINCT p.question_id, p.seq FROM p JOIN lim USING (question_id) WHERE len(p.seq) <= lim),
    q AS (SELECT question_id, any_value(question) AS question FROM question_graphs GROUP BY 1),
    w AS (SELECT s.question_id, seq, array_to_string(seq, '|') AS sequence, list_distinct({_TOKENS.format("coalesce(question, '')")}) AS asked,
          list_distinct(flatten(list_transform(seq, lambda x: {_TOKENS.format(_WORDS.format("regexp_replace(x, '::(forward|backward)$', '')"))}))) AS own FROM s LEFT JOIN q USING (question_id)),
    sc AS (SELECT w.question_id, w.sequence, coalesce(len(list_intersect(own, asked)) / nullif(len(own), 0), 0) AS score, len(seq) AS n, gold.sequence IS NOT NULL AS is_gold FROM w LEFT JOIN gold ON gold.question_id = w.question_id AND gold.sequence = w.sequence),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, sequence DESC) AS rank FROM sc),
    held AS (SELECT DISTINCT question_id FROM r WHERE rank <= 20 AND is_gold)"""
_PICKS = f"""WITH {v.CANDIDATES}, {v.EXAMPLES}, pl AS (SELECT *, 'all' AS model FROM c UNION ALL SELECT *, 'proposed' FROM c WHERE is_positive OR negative_type = 'proposed'),
    sc AS (SELECT example_id AS id, model, unnest([{{'arm': 'score', 'n': n1}}, {{'arm': 'retrieval', 'n': n2}}, {{'arm': 'first', 'n': n3}}], recursive := true), CAST(coalesce(is_positive, false) AS DOUBLE) AS value FROM (SELECT *,
      row_number() OVER (PARTITION BY example_id, model ORDER BY score DESC NULLS LAST, candidate_index, candidate_id) AS n1, row_number() OVER (PARTITION BY example_id, model ORDER BY coalesce(retrieval_score, 0) DESC, candidate_index, candidate_id) AS n2,
      row_number() OVER (PARTITION BY example_id, model ORDER BY candidate_index, candidate_id) AS n3 FROM pl)),
    hits AS (SELECT id, model, arm, value FROM sc WHERE n = 1),
    sl AS (SELECT example_id AS id, unnest(list_filter(['all', CASE WHEN len(positive_path.hops) >= 2 THEN 'several_hops' WHEN len(positive_path.hops) = 1 THEN 'one_hop' END], lambda x: x IS NOT NULL)) AS slice FROM x),
    wide AS (SELECT id, model, max(value) FILTER (arm = 'score') AS s, max(value) FILTER (arm = 'retrieval') AS r, max(value) FILTER (arm = 'first') AS f FROM hits GROUP BY 1, 2)"""
_DIFF = _PICKS + """, dd AS (SELECT slice, model, 'hit' AS metric, z.comparison, id, z.d AS v FROM (SELECT id, model, unnest([{'comparison': 'score_minus_first', 'd': s - f}, {'comparison': 'retrieval_minus_first', 'd': r - f}, {'comparison': 'score_minus_retrieval', 'd': s - r}]) AS z FROM wide) JOIN sl USING (id) WHERE z.d IS NOT NULL)"""
_INTER = _PICKS + """, pr AS (SELECT a.id, a.s - a.f - (b.s - b.f) AS d1, a.r - a.f - (b.r - b.f) AS d2 FROM wide a JOIN wide b ON a.id = b.id AND a.model = 'all' AND b.model = 'proposed'),
    dd AS (SELECT slice, 'hit' AS metric, z.comparison, id, z.d AS v FROM (SELECT id, unnest([{'comparison': 'score_minus_first', 'd': d1}, {'comparison': 'retrieval_minus_first', 'd': d2}]) AS z FROM pr) JOIN sl USING (id) WHERE z.d IS NOT NULL)"""
_WHOLE = "(len({0}.hops) > 0 AND len(list_filter({0}.hops, lambda h: h IS NULL OR h.relation IS NULL OR h.direction IS NULL)) = 0)"
_SEQ = "array_to_string(list_transform({0}.hops, lambda h: h.relation || '::' || h.direction), '|')"


def _bounds(keys: str, out: str) -> str:
    return f"""{v.sql_resampled('dd', 100, keys)}, ql AS (SELECT {keys}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL)
        SELECT {', '.join('dd.' + k.strip() for k in keys.split(','))}, count(*) AS n, round(avg(v), 9) AS {out}, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high FROM dd JOIN ql USING ({keys}) GROUP BY ALL"""


SQL = {
    "executable_patterns": _MINE + " SELECT question_id, sequence, round(score, 9) AS score, CAST(rank AS INT) AS rank, is_gold FROM r JOIN held USING (question_id) WHERE rank <= 20",
    "pattern_recall": _MINE + """, per AS (SELECT question_id, count(sc.sequence) AS n, coalesce(bool_or(is_gold), false) AS hit FROM (SELECT DISTINCT question_id FROM lim JOIN a USING (question_id) WHERE node IS NOT NULL AND question_id IN (SELECT question_id FROM e)) LEFT JOIN sc USING (question_id) GROUP BY 1)
        SELECT count(*) AS questions, count(*) FILTER (hit) AS gold_in_graph, (SELECT count(*) FROM held) AS gold_after_cap, round(avg(n), 9) AS average_candidates FROM per""",
    "best_families": f"""WITH {v.CANDIDATES}, b AS (SELECT example_id, anchor, array_to_string(relation_sequence, '|') AS sequence, max(coalesce(retrieval_score, 0)) AS score FROM c WHERE anchor IS NOT NULL AND len(relation_sequence) > 0 AND len(list_filter(relation_sequence, lambda x: x IS NULL)) = 0 AND len(answers) > 0 GROUP BY ALL)
        SELECT example_id AS question_id, anchor, sequence, round(score, 9) AS score, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, anchor, sequence) AS n FROM b) WHERE n <= 5""",
    "gold_sequence_available": f"""WITH {v.EDGES}, {v.TOPICS}, {building._P}, sq AS (SELECT list_transform(path.hops, lambda h: {v.sql_fold('h.relation')} || '::' || h.direction) AS s FROM p WHERE len(path.hops) <= 2),
        top AS (SELECT s FROM sq GROUP BY 1 ORDER BY count(*) DESC, array_to_string(s, '|') LIMIT 20),
        h1 AS (SELECT a.question_id, s, e.dst FROM a, top JOIN e ON e.question_id = a.question_id AND e.src = a.node AND e.relation || '::' || e.direction = s[1]),
        h2 AS (SELECT h1.question_id FROM h1 JOIN e ON e.question_id = h1.question_id AND e.src = h1.dst AND e.relation || '::' || e.direction = s[2] WHERE len(s) = 2),
        ok AS (SELECT question_id FROM h1 WHERE len(s) = 1 UNION SELECT question_id FROM h2)
        SELECT question_id IN (SELECT question_id FROM ok) AS available, count(*) AS questions FROM (SELECT DISTINCT question_id FROM question_graphs) GROUP BY 1""",
    "synthetic_corpus": f"""WITH {v.PATHS}, kg AS (SELECT question_id, any_value({v.sql_fold('kg')}) AS kg FROM question_graphs GROUP BY 1), u AS (SELECT DISTINCT kg, anchor, array_to_string(seq, '|') AS sequence, nodes[len(nodes)] AS "end", len(seq) AS depth FROM p JOIN kg USING (question_id) WHERE kg IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY kg, depth ORDER BY sha256('17|' || kg || '|' || anchor || '|' || sequence || '|' || "end"), anchor, sequence, "end") AS n FROM u)
        SELECT kg, anchor, sequence, "end", CAST(depth AS INT) AS depth, CASE WHEN {building._BUCKET.format("'synthetic-dev:' || sequence", 10, 12)} = 0 THEN 'dev' ELSE 'train' END AS split FROM r WHERE n <= 100""",
    "assembled_examples": f"""WITH {v.EXAMPLES}, y AS (SELECT example_id, question, coalesce({_WHOLE.format('positive_path')}, false) AS ok, {_SEQ.format('positive_path')} AS own FROM x),
        alt AS (SELECT example_id, {_SEQ.format('p')} AS s FROM (SELECT example_id, unnest(alternate_positive_paths) AS p FROM x) WHERE coalesce({_WHOLE.format('p')}, false)),
        neg AS (SELECT example_id, {_SEQ.format('p')} AS s FROM (SELECT example_id, unnest(negative_paths) AS p FROM x) WHERE coalesce({_WHOLE.format('p')}, false)),
        n AS (SELECT y.example_id, count(DISTINCT s) AS n FROM y JOIN neg USING (example_id) WHERE s <> own AND NOT EXISTS (SELECT 1 FROM alt WHERE alt.example_id = y.example_id AND alt.s = neg.s) GROUP BY 1)
        SELECT example_id, CASE WHEN trim(coalesce(question, '')) = '' THEN 'no_question' WHEN NOT ok THEN 'no_path' WHEN coalesce(n, 0) = 0 THEN 'no_negative' ELSE 'accepted' END AS outcome, CAST(CASE WHEN trim(coalesce(question, '')) <> '' AND ok THEN coalesce(n, 0) ELSE 0 END AS INT) AS negatives FROM y LEFT JOIN n USING (example_id)""",
    "direction_examples": "WITH pairs AS (" + building.SQL["direction_pairs"] + f"""), ex AS (SELECT example_id, any_value(question) AS question FROM examples GROUP BY 1),
        j AS (SELECT 'direction-pair:' || kg || ':' || substr(sha256(kg || '::' || relation), 1, 16) AS example_id, split, kg, relation, forward_id, backward_id, f.question AS fq, b.question AS bq FROM pairs JOIN ex f ON f.example_id = forward_id JOIN ex b ON b.example_id = backward_id)
        SELECT example_id, split, kg, relation || '::forward' AS sequence, forward_id, fq AS question, bq AS negative_question FROM j UNION ALL SELECT example_id || ':backward', split, kg, relation || '::backward', backward_id, bq, fq FROM j""",
    "pool_fingerprints": f"""WITH {v.CANDIDATES}, l AS (SELECT example_id, {metrics._POS} AS p, array_to_string(coalesce(relation_sequence, []), '|') AS s FROM c) SELECT example_id, count(*) AS n, sha256(string_agg(p || ':' || s, chr(10) ORDER BY p, s)) AS fingerprint FROM l GROUP BY 1""",
    "answer_equivalent_paths": studies._WALKED.rsplit(",\n    y AS", 1)[0] + " SELECT question_id, CAST(n AS INT) AS candidate_index, r1 || '::' || d1 || '|' || r2 || '::' || d2 AS sequence FROM z WHERE denotation AND n > 1",
    "pair_means": f"WITH {v.CANDIDATES} SELECT negative_type, count(*) AS pairs, round(avg(retrieval_score), 9) AS mean_retrieval_score, round(avg(score - retrieval_score), 6) AS mean_lead FROM c GROUP BY 1",
    "pilot_sample": "WITH fr AS (" + studies.SQL["first_answer_rank"] + """), b AS (SELECT question_id AS id, first_rank AS evidence_rank, CASE WHEN first_rank = 1 THEN 'first' WHEN first_rank BETWEEN 2 AND 1000 THEN 'later' END AS pilot_bucket FROM fr),
        n AS (SELECT least(30, min(n)) AS n FROM (SELECT count(*) AS n FROM b WHERE pilot_bucket IS NOT NULL GROUP BY pilot_bucket))
        SELECT id, evidence_rank, pilot_bucket FROM (SELECT *, row_number() OVER (PARTITION BY pilot_bucket ORDER BY sha256('17|' || id), id) AS k FROM b WHERE pilot_bucket IS NOT NULL) WHERE k <= (SELECT n FROM n)""",
    "campaign_means": _PICKS + " SELECT slice, model, arm, 'hit' AS metric, count(value) AS n, round(avg(value), 9) AS mean FROM hits JOIN sl USING (id) GROUP BY ALL",
    "campaign_effects": _DIFF + ", " + _bounds("slice, model, metric, comparison", "delta"),
    "campaign_interactions": _INTER + ", " + _bounds("slice, metric, comparison", "interaction"),
    "naturalization_requests": """WITH i AS (SELECT row_id, min(id) AS id, min(canonical_question) AS prompt FROM path_naturalizations WHERE id IS NOT NULL AND canonical_question IS NOT NULL GROUP BY 1),
        b AS (SELECT *, CAST(('0x' || substr(sha256(row_id::VARCHAR), 1, 8)) AS BIGINT) % 64 AS b FROM i), n AS (SELECT *, (row_number() OVER (PARTITION BY b ORDER BY row_id) - 1) // 8 AS n FROM b),
        g AS (SELECT b || '-' || n AS batch, count(*) AS n_items, string_agg(id || ': ' || prompt, chr(10) ORDER BY row_id) AS body FROM n GROUP BY b, n)
        SELECT batch, CAST(n_items AS INT) AS n_items, to_json({'custom_id': 'batch-' || batch, 'method': 'POST', 'url': '/v1/chat/completions', 'body': {'model': 'any', 'messages': [{'role': 'system', 'content': 'Rewrite every question.'}, {'role': 'user', 'content': body}], 'temperature': 0.0::DOUBLE, 'max_tokens': 512}})::VARCHAR AS line FROM g""",
    "parsed_results": f"""WITH t AS (SELECT DISTINCT row_id, id, status, question, reason FROM path_naturalizations WHERE id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) AS n FROM t WHERE row_id % 50 <> 0)
        SELECT {v.sql_fold('status')} AS outcome, count(*) AS n, count(question) AS questions FROM k WHERE n = 1 GROUP BY 1 UNION ALL SELECT 'no_items', count(*), 0 FROM t WHERE row_id % 50 = 0""",
    "margin": f"""WITH {v.CANDIDATES}, r AS (SELECT example_id, candidate_id, score, row_number() OVER w AS n, lead(score) OVER w AS next FROM c WINDOW w AS (PARTITION BY example_id ORDER BY score DESC NULLS LAST, {metrics._POS})) SELECT example_id, candidate_id, round(coalesce(score - next, 0), 6) AS margin FROM r WHERE n = 1""",
    "conj_self_loop": f"WITH {v.TRIPLES}, {v.TOPICS} SELECT DISTINCT a.question_id, a.node AS topic, t1.tail AS answer FROM a JOIN t t1 ON t1.question_id = a.question_id AND t1.head = a.node AND t1.relation = 'stagework.observatory.first_director' JOIN t t2 ON t2.question_id = a.question_id AND t2.head = t1.tail AND t2.tail = t1.tail AND t2.relation = t1.relation",
}
_REL = studies._REL
_OK = f"{building._P}, ok AS (SELECT example_id, path, list_transform(path.hops, lambda h: {{'r': {_REL.format('h')}, 'd': h.direction, 's': coalesce(nullif(h.source_type, ''), 'entity'), 't': coalesce(nullif(h.target_type, ''), 'entity')}}) AS f FROM p WHERE len(list_filter(path.hops, lambda h: h.direction NOT IN ('forward', 'backward'))) = 0)"
SQL["represented_queries"] = f"""WITH {_OK} SELECT example_id, 'v0:' || f[1].s || ' ' || array_to_string(list_transform(f, lambda h, i: 'v' || i || ':' || h.t), ' ') AS variables, CAST(len(f) AS INT) AS facts,
    array_to_string(list_transform(f, lambda h, i: h.r || '(v' || CASE WHEN h.d = 'forward' THEN i - 1 ELSE i END || ', v' || CASE WHEN h.d = 'forward' THEN i ELSE i - 1 END || ')'), ' AND ') || ' -> v' || len(f) AS form, 'v' || len(f) AS answer, f[-1].t AS answer_type FROM ok"""
SQL["compact_queries"] = f"""WITH {_OK}, g AS (SELECT relation_key, any_value(status) AS status, any_value(description) AS description, any_value(fact_template) AS tpl FROM relation_glossary GROUP BY 1),
    u AS (SELECT example_id, {v.sql_fold('path.kg')} AS kg, unnest(f) AS h, generate_subscripts(f, 1) AS i FROM ok),
    w AS (SELECT *, CASE WHEN h.d = 'forward' THEN 'v' || (i - 1) || ' (type: ' || h.s || ')' ELSE 'v' || i || ' (type: ' || h.t || ')' END AS subject, CASE WHEN h.d = 'forward' THEN 'v' || i || ' (type: ' || h.t || ')' ELSE 'v' || (i - 1) || ' (type: ' || h.s || ')' END AS object FROM u),
    l AS (SELECT example_id, i, 'F' || (i - 1) || ': ' || CASE WHEN regexp_matches(replace(replace(coalesce(tpl, ''), '{{subject}}', ''), '{{object}}', ''), '[{{}}]') THEN subject || ' -- ' || coalesce(description, 'unknown') || ' --> ' || object ELSE replace(replace(coalesce(tpl, ''), '{{subject}}', subject), '{{object}}', object) END AS line,
      CASE WHEN status = 'semantic' THEN NULL ELSE h.r END AS bad FROM w LEFT JOIN g ON g.relation_key = concat_ws('::', kg, h.r)),
    k AS (SELECT example_id, string_agg(line, chr(10) ORDER BY i) AS body, coalesce(string_agg(bad, '|' ORDER BY i), '') AS unusable FROM l GROUP BY 1)
    SELECT example_id, 'Anchor: v0 = [ENTITY] (type: ' || f[1].s || ')' || chr(10) || 'Required facts:' || chr(10) || body || chr(10) || 'Return: v' || len(f) || ' (type: ' || f[-1].t || ')' AS query, unusable FROM k JOIN ok USING (example_id)"""
SQL["ceiling_by_kind"] = studies.SQL["program_ceiling"].replace("SELECT CASE WHEN len(gold) = 0", "SELECT kind, CASE WHEN len(gold) = 0").replace("FROM m WHERE n = 1 GROUP BY 1", f"FROM m JOIN (SELECT question_id, any_value({v.sql_fold('kg')}) AS kind FROM question_graphs GROUP BY 1) USING (question_id) WHERE n = 1 GROUP BY ALL")
SQL["adjudication_summary"] = f"""WITH {v.CANDIDATES}, q AS (SELECT example_id, candidate_id, score, score > 1 AS verdict, CASE WHEN (score > 1) <> is_positive THEN 'disagreement' ELSE 'agreement' END AS kind FROM c WHERE score IS NOT NULL AND is_positive IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('17|' || example_id || '|' || candidate_id)) AS n FROM q), pk AS (SELECT *, (score > 1.2) = verdict AS agree FROM r WHERE kind = 'disagreement' OR n <= 50)
    SELECT count(*) AS adjudicated, count(*) FILTER (agree) AS judges_agree, count(*) FILTER (kind = 'disagreement') AS from_disagreement, 0::BIGINT AS from_unclear, count(*) FILTER (kind = 'agreement') AS from_agreement,
      (SELECT count(DISTINCT example_id) FROM q) AS sets, count(DISTINCT example_id) FILTER (NOT agree) AS disputed_sets FROM pk"""
SQL["stratified_by_split"] = f"""WITH {v.EXAMPLES}, q AS (SELECT example_id, regexp_extract(lower(trim(split)), '^(train|dev|test)', 1) AS side, {v.sql_fold('kg')} AS kg, coalesce(len(positive_path.hops), -1) AS hops FROM x WHERE positive_path IS NOT NULL AND kg IS NOT NULL AND split IS NOT NULL),
    n AS (SELECT side, count(*) AS n, CASE side WHEN 'train' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END AS o FROM q WHERE side <> '' GROUP BY 1), t AS (SELECT sum(n) AS total, least(300, sum(n)) AS target FROM n),
    q0 AS (SELECT side, n, o, least(n, round_even(target * n / total, 0)) AS quota FROM n, t), gap AS (SELECT (SELECT target FROM t) - sum(quota) AS gap FROM q0),
    quotas AS (SELECT side, quota + CASE WHEN gap > 0 AND row_number() OVER (ORDER BY n - quota DESC, o) <= gap THEN 1 WHEN gap < 0 AND row_number() OVER (ORDER BY quota DESC, o) <= -gap THEN -1 ELSE 0 END AS quota FROM q0, gap),
    r AS (SELECT *, row_number() OVER (PARTITION BY side, kg, hops ORDER BY sha256(example_id)) AS rnd FROM q WHERE side <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY rnd, hops, kg) AS place FROM r)
    SELECT example_id, side, place FROM p JOIN quotas USING (side) WHERE place <= quota"""
