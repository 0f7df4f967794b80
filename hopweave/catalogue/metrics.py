"""Ranking, selection, scoring and statistics queries over the candidates of all examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import stats, text
from ..operators import audit, corpus, ranking, similarity
from ..session import table
from . import views as v

KEY = ["example_id"]
_DONE = lambda c: F.round(c, 9)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return v.candidates(spark, d).where("score is not null and is_positive is not null")


def ranking_metrics_ties(spark: SparkSession, d: str) -> DataFrame:
    """Tie-aware measures of scores cut to one decimal, so that ties are frequent."""
    m = ranking.ranking_metrics(_scored(spark, d).withColumn("score", F.floor(F.col("score") * 2) / 2), KEY, "score", "is_positive")
    return m.select("examples", *[_DONE(F.col(c)).alias(c) for c in m.columns if c != "examples"])


def pairwise_by_negative_type(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pairwise_by(_scored(spark, d), KEY, "score", "is_positive", "negative_type").withColumn("accuracy", _DONE(F.col("accuracy")))


def first_positive_rank(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d)
    return ranking.first_positive_rank(c, KEY, [F.col("score").desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")], "is_positive")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.recall_at(first_positive_rank(spark, d), (1, 2, 3, 5, 10, 20))
    return got.select("k", _DONE(F.col("recall")).alias("recall"), _DONE(F.col("recall_available")).alias("recall_available"))


def _unlabeled(spark: SparkSession, d: str) -> DataFrame:
    return v.candidates(spark, d).withColumn("candidate_index", F.col("candidate_index").cast("long") * 1_000_000_000 + F.col("candidate_id") % 1_000_000_000)


def argmax_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Best candidate by score plus retrieval score among those with a labelled answer."""
    s = F.col("score") + F.coalesce("retrieval_score", F.lit(0.0))
    got = ranking.argmax(_unlabeled(spark, d), KEY, s, "candidate_index", "answers")
    return got.select("example_id", "candidate_id", "fallback", _DONE(F.col("margin")).alias("margin"))


def top_k_candidates(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")]
    return ranking.top_k(v.candidates(spark, d), KEY, order, 3).select("example_id", "candidate_id", "rank")


def keep_first_answer(spark: SparkSession, d: str) -> DataFrame:
    """First candidate of each answer set."""
    c = v.candidates(spark, d).withColumn("answer_key", F.array_join(A.answer_key(F.col("answers")), "|"))
    return ranking.keep_first(c, ["example_id", "answer_key"], [F.col("candidate_index"), F.col("candidate_id")]).select("example_id", "answer_key", "candidate_id")


def fractional_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d).withColumn("coarse", F.floor("score"))
    return ranking.fractional_ranks(c, KEY, "coarse").select("example_id", "candidate_id", "rank")


def spearman_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of score and retrieval score inside each example, summarised."""
    c = _scored(spark, d).where("retrieval_score is not null")
    r = ranking.fractional_ranks(ranking.fractional_ranks(c, KEY, "score", "r1"), KEY, "retrieval_score", "r2")
    per = stats.spearman(r, "r1", "r2", KEY)
    return per.agg(F.count("*").alias("examples"), F.round(F.avg("spearman"), 6).alias("mean"), F.count_if(F.col("spearman") > 1e-9).alias("above_zero"))


def hard_negative_sample(spark: SparkSession, d: str) -> DataFrame:
    c = _unlabeled(spark, d)
    return ranking.sample_candidates(c, KEY, "score", "is_positive", "candidate_index", hard=3, other=2, positives=1).select("example_id", "candidate_id", "role")


def category_first(spark: SparkSession, d: str) -> DataFrame:
    c = _unlabeled(spark, d).where("not is_positive and negative_type is not null")
    return ranking.category_first(c, KEY, "negative_type", "candidate_index", 4).select("example_id", "candidate_id", "place")


def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """A quota of examples taken in turn from buckets of graph and hop count."""
    x = v.examples(spark, d).where("positive_path is not null").select("example_id", v.fold("kg").alias("kg"), F.coalesce(F.size("positive_path.hops"), F.lit(-1)).alias("hops"))
    return ranking.round_robin(x.where("kg is not null"), ["kg", "hops"], [F.sha2("example_id", 256)], 500).select("example_id", "place")


def answer_f1_contract(spark: SparkSession, d: str) -> DataFrame:
    """Answers of each candidate against those of the example's positive, raw sets, both empty exact."""
    s = A.contract_scores(F.col("answers"), F.col("gold"))
    return _against_gold(spark, d).select(s["exact"].alias("exact"), s["f1"].alias("f1"), "negative_type").groupBy("negative_type").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), _DONE(F.avg("f1")).alias("f1"))


def answer_metrics_folded(spark: SparkSession, d: str) -> DataFrame:
    s = A.folded_scores(F.col("answers"), F.col("gold"))
    cols = ("precision", "recall", "f1", "exact_match", "has_answer")
    return _against_gold(spark, d).select("negative_type", *[s[c].alias(c) for c in cols]).groupBy("negative_type").agg(*[_DONE(F.avg(c)).alias(c) for c in cols])


def answer_scores_raw(spark: SparkSession, d: str) -> DataFrame:
    s = A.raw_scores(F.col("answers"), F.col("gold"))
    return _against_gold(spark, d).select("negative_type", s["em"].alias("em"), s["f1"].alias("f1")).groupBy("negative_type").agg(_DONE(F.avg("em")).alias("em"), _DONE(F.avg("f1")).alias("f1"))


def _against_gold(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d)
    gold = c.where("is_positive").groupBy("example_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("answers", F.array().cast("array<string>")))))).alias("gold"))
    return c.join(gold, "example_id", "left")


def answerable_endpoints(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d)
    return c.groupBy("negative_type").agg(F.count("*").alias("n"), F.count_if(text.answerable(F.col("answers"))).alias("answerable"), F.sum(F.greatest(text.unlabeled_count(F.coalesce("answers", F.array().cast("array<string>"))), F.lit(0))).alias("unlabeled"))


def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by annotated sequence and by equal answers, against the example's own path and positive answers."""
    seq = corpus.relation_sequence(F.col("positive_path.hops"))
    c = _against_gold(spark, d).withColumnRenamed("gold", "gold_answers").withColumnRenamed("relation_sequence", "sequence")
    gold = v.examples(spark, d).select("example_id", F.array(F.array_join(seq, "|")).alias("gold_sequences"))
    answers = c.select("example_id", "gold_answers").dropDuplicates(["example_id"])
    got = corpus.label_candidates(c.drop("gold_answers"), gold.join(answers, "example_id", "full"), "example_id")
    return got.groupBy("annotated", "denotation", "is_gold").agg(F.count("*").alias("n"))


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """Picks of three policies: score, retrieval score, their sum; correct when a positive is picked."""
    c = v.candidates(spark, d).select("example_id", "candidate_id", "candidate_index", "is_positive", F.col("score").alias("a"), F.coalesce("retrieval_score", F.lit(0.0)).alias("b"))
    out = None
    for run, s in (("score", F.col("a")), ("retrieval", F.col("b")), ("sum", F.col("a") + F.col("b"))):
        one = ranking.keep_first(c, KEY, [s.desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")]).select(F.lit(run).alias("run"), "example_id", F.coalesce("is_positive", F.lit(False)).alias("correct"))
        out = one if out is None else out.unionByName(one)
    return out


def contingency(spark: SparkSession, d: str) -> DataFrame:
    wide = _picks(spark, d).groupBy("example_id").pivot("run", ["score", "retrieval"]).agg(F.max("correct"))
    return stats.contingency(wide, "score", "retrieval")


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the three policies with exact and Holm-adjusted p-values."""
    got = stats.compare_runs(_picks(spark, d), ["retrieval", "score", "sum"], "example_id")
    return got.select("left_run", "right_run", "both", "left_only", "right_only", "neither", _DONE(F.col("p")).alias("p"), _DONE(F.col("adjusted")).alias("adjusted"))


def mcnemar_small(spark: SparkSession, d: str) -> DataFrame:
    """Exact test per graph of examples with an early id against the rest of the run (counts of up to hundreds)."""
    wide = _picks(spark, d).groupBy("example_id").pivot("run", ["score", "sum"]).agg(F.max("correct"))
    kg = v.examples(spark, d).select("example_id", v.fold("kg").alias("kg"))
    t = stats.contingency(wide.join(kg, "example_id"), "score", "sum", ["kg"])
    return t.select("kg", "left_only", "right_only", _DONE(stats.mcnemar_p(F.col("left_only"), F.col("right_only"))).alias("p"))


def auc_ties(spark: SparkSession, d: str) -> DataFrame:
    got = stats.auc(_scored(spark, d).withColumn("score", F.floor(F.col("score") * 4) / 4), "score", "is_positive")
    return got.select("positives", "negatives", _DONE(F.col("auc")).alias("auc"))


def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    got = stats.summary(v.candidates(spark, d), "retrieval_score", ["negative_type"])
    return got.select("negative_type", "examples", *[_DONE(F.col(c)).alias(c) for c in got.columns if c not in ("negative_type", "examples")])


def listwise_loss(spark: SparkSession, d: str) -> DataFrame:
    got = stats.listwise_loss(_scored(spark, d), KEY, "score", "is_positive")
    return got.agg(F.count("*").alias("groups"), F.round(F.avg("loss"), 6).alias("loss"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the first positive with a resampled interval."""
    r = first_positive_rank(spark, d).withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    got = stats.bootstrap_interval(r, "example_id", "rr", samples=200)
    return got.select("n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "path_naturalizations").distinct()
    s = F.coalesce(v.fold("status"), F.lit("missing"))
    return t.groupBy(s.alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "")).alias("with_reason"))


def sliced_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank over overlapping slices: all, each graph, each hop count, each answer type."""
    r = first_positive_rank(spark, d).withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    x = v.examples(spark, d).select("example_id", v.fold("kg").alias("kg"), F.size("positive_path.hops").alias("hops"), F.col("positive_path.answer_type").alias("type"))
    slices = F.array(F.lit("all"), F.concat(F.lit("kg:"), "kg"), F.concat(F.lit("hops:"), F.when(F.col("hops") >= 0, F.col("hops")).cast("string")), F.concat(F.lit("type:"), "type"))
    j = r.join(x, "example_id", "left").select("rr", F.explode(F.array_compact(slices)).alias("slice"))
    return j.groupBy("slice").agg(F.count("*").alias("examples"), _DONE(F.avg("rr")).alias("mrr"))


def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    """Picks by score classified against the positive: relations of the path as fragments."""
    c = v.candidates(spark, d)
    rel: Column = F.transform("relation_sequence", lambda x: F.regexp_replace(x, "::[a-z]+$", ""))
    c = c.withColumn("rels", rel)
    pool = c.groupBy("example_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("rels", F.array().cast("array<string>"))))).alias("proposed"))
    gold = ranking.keep_first(c.where("is_positive"), KEY, [F.col("candidate_index"), F.col("candidate_id")]).select("example_id", F.col("rels").alias("reference"), F.array_join("relation_sequence", "|").alias("ref"))
    pick = ranking.keep_first(c, KEY, [F.col("score").desc_nulls_last(), F.col("candidate_index"), F.col("candidate_id")]).select("example_id", F.col("rels").alias("selected"), "is_positive", "answers", F.array_join("relation_sequence", "|").alias("got"), F.col("negative_type"))
    j = pick.join(gold, "example_id", "left").join(pool, "example_id")
    cat = audit.classify(
        F.when(F.col("ref").isNotNull(), "exact"), F.col("is_positive"), audit.fragments(F.col("reference"), F.lit(False), F.lit(False)), audit.fragments(F.col("selected"), F.lit(False), F.lit(False)), F.col("proposed"),
        F.col("negative_type") == "wrong_direction", F.size("answers") > 0, F.col("got") == F.col("ref"),
    )
    return j.select(cat.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def multiset_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of candidates against those of their example's path, as multisets."""
    c = v.candidates(spark, d).where("relation_sequence is not null").select("example_id", "relation_sequence")
    g = v.examples(spark, d).where("positive_path.hops is not null").select("example_id", F.transform(F.filter("positive_path.hops", lambda h: h.isNotNull()), lambda h: text.directed(h["relation"], h["direction"])).alias("gold"))
    j = c.join(g, "example_id")
    a, b = F.col("relation_sequence"), F.col("gold")
    return j.agg(F.count("*").alias("n"), F.count_if(A.multiset_equal(a, b)).alias("equal"), F.count_if(A.strict_submultiset(a, b)).alias("part"), F.sum(F.size(A.missing(b, a))).alias("missing"))


def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest by cosine of every vector whose id is divisible by 100, over all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.cosine_topk(e, e.where("id % 100 = 0"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        ranking_metrics_ties, pairwise_by_negative_type, first_positive_rank, recall_at_k, argmax_with_fallback, top_k_candidates, keep_first_answer, fractional_ranks, spearman_scores, hard_negative_sample,
        category_first, stratified_round_robin, answer_f1_contract, answer_metrics_folded, answer_scores_raw, answerable_endpoints, label_candidates, contingency, compare_runs, mcnemar_small, auc_ties,
        percentile_summary, listwise_loss, bootstrap_ci, status_counts, sliced_metrics, failure_categories, multiset_relations, embedding_cosine_topk,
    )
}

_C = f"WITH {v.CANDIDATES}"
_S = _C + ", s AS (SELECT * FROM c WHERE score IS NOT NULL AND is_positive IS NOT NULL)"
_ORDER = "score DESC NULLS LAST, candidate_index, candidate_id"
_KEYED = "list_sort(list_distinct(list_filter(list_transform(list_filter(coalesce({0}, []), lambda z: z IS NOT NULL), lambda z: lower(trim(z))), lambda z: z <> '')))"
_POS = "CAST(candidate_index AS BIGINT) * 1000000000 + candidate_id % 1000000000"
_GOLD = _C + ", g AS (SELECT example_id, list_sort(list_distinct(flatten(list(coalesce(answers, []))))) AS gold FROM c WHERE is_positive GROUP BY 1), j AS (SELECT c.*, coalesce(g.gold, []) AS gold, coalesce(answers, []) AS ans FROM c LEFT JOIN g USING (example_id))"
_OVER = "len(list_intersect(list_distinct(ans), list_distinct(gold)))"
_RANK = f"r AS (SELECT example_id, min(CASE WHEN is_positive THEN n END) AS first_rank FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {_ORDER}) AS n FROM c) GROUP BY 1)"
_PICK = """k AS (SELECT example_id, coalesce(arg_min(is_positive, n1), false) AS s, coalesce(arg_min(is_positive, n2), false) AS r, coalesce(arg_min(is_positive, n3), false) AS u FROM (SELECT example_id, coalesce(is_positive, false) AS is_positive,
    row_number() OVER (PARTITION BY example_id ORDER BY score DESC NULLS LAST, candidate_index, candidate_id) AS n1, row_number() OVER (PARTITION BY example_id ORDER BY coalesce(retrieval_score, 0) DESC, candidate_index, candidate_id) AS n2,
    row_number() OVER (PARTITION BY example_id ORDER BY score + coalesce(retrieval_score, 0) DESC NULLS LAST, candidate_index, candidate_id) AS n3 FROM c) GROUP BY 1)"""
_TABLE = "CAST(count(*) FILTER ({0} AND {1}) AS BIGINT) AS \"both\", CAST(count(*) FILTER ({0} AND NOT {1}) AS BIGINT) AS left_only, CAST(count(*) FILTER (NOT {0} AND {1}) AS BIGINT) AS right_only, CAST(count(*) FILTER (NOT {0} AND NOT {1}) AS BIGINT) AS neither"
_EXACT = "CASE WHEN left_only + right_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))) FROM range(0, least(left_only, right_only) + 1) q(i))) END"

SQL = {
    "ranking_metrics_ties": _S + """, q AS (SELECT example_id, is_positive, floor(score * 2) / 2 AS score FROM s), m AS (SELECT *, max(CASE WHEN is_positive THEN score END) OVER (PARTITION BY example_id) AS p, max(score) OVER (PARTITION BY example_id) AS t FROM q),
        g AS (SELECT example_id, count(*) FILTER (score > p) AS hi, count(*) FILTER (score = p) AS lv, count(*) FILTER (score = p AND is_positive) AS lp, count(*) FILTER (score = t) AS tp, count(*) FILTER (score = t AND is_positive) AS tq, count(*) FILTER (NOT is_positive) AS pr, count(*) FILTER (NOT is_positive AND p > score) AS wn FROM m WHERE p IS NOT NULL GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS examples, round(avg(tq / tp), 9) AS recall_at_1, round(avg(CASE WHEN tq = tp THEN 1.0 ELSE 0.0 END), 9) AS strict_recall_at_1, round(avg(CASE WHEN tp > 1 THEN 1.0 ELSE 0.0 END), 9) AS top_tie_rate, round(avg(1.0 / (hi + (lv + 1) / (lp + 1))), 9) AS mrr, round(CAST(sum(wn) AS DOUBLE) / CAST(sum(pr) AS DOUBLE), 9) AS pairwise_accuracy FROM g""",
    "pairwise_by_negative_type": _S + ", m AS (SELECT *, max(CASE WHEN is_positive THEN score END) OVER (PARTITION BY example_id) AS p FROM s) SELECT negative_type, CAST(count(*) AS BIGINT) AS pairs, round(avg(CASE WHEN p > score THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM m WHERE p IS NOT NULL AND NOT is_positive GROUP BY 1",
    "first_positive_rank": f"{_C}, {_RANK} SELECT example_id, CAST(first_rank AS INT) AS first_rank FROM r",
    "recall_at_k": f"{_C}, {_RANK} SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN first_rank <= k THEN 1.0 ELSE 0.0 END), 9) AS recall, round(sum(CASE WHEN first_rank <= k THEN 1.0 ELSE 0.0 END) / count(first_rank), 9) AS recall_available FROM r, (SELECT unnest([1, 2, 3, 5, 10, 20]) AS k) GROUP BY k",
    "argmax_with_fallback": _C + f""", q AS (SELECT *, score + coalesce(retrieval_score, 0) AS s, {_POS} AS pos, len(coalesce(answers, [])) > 0 AND len(list_filter(coalesce(answers, []), lambda z: regexp_matches(trim(z), '^[a-z]\\.[0-9a-z_]+$'))) < len(coalesce(answers, [])) AS ok FROM c),
        p AS (SELECT * FROM (SELECT *, NOT bool_or(ok) OVER (PARTITION BY example_id) AS fallback FROM q) WHERE ok OR fallback), r AS (SELECT *, row_number() OVER w AS n, s - lead(s) OVER w AS m FROM p WINDOW w AS (PARTITION BY example_id ORDER BY s DESC NULLS LAST, pos))
        SELECT example_id, candidate_id, fallback, round(coalesce(m, 0), 9) AS margin FROM r WHERE n = 1""",
    "top_k_candidates": f"{_C} SELECT example_id, candidate_id, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {_ORDER}) AS n FROM c) WHERE n <= 3",
    "keep_first_answer": f"{_C}, q AS (SELECT *, coalesce(array_to_string({_KEYED.format('answers')}, '|'), '') AS answer_key FROM c) SELECT example_id, answer_key, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY example_id, answer_key ORDER BY candidate_index, candidate_id) AS n FROM q) WHERE n = 1",
    "fractional_ranks": _S + ", q AS (SELECT *, floor(score) AS f FROM s) SELECT example_id, candidate_id, CAST(rank() OVER (PARTITION BY example_id ORDER BY f DESC) + (count(*) OVER (PARTITION BY example_id, f) - 1) / 2 AS DOUBLE) AS rank FROM q",
    "spearman_scores": _S + """, q AS (SELECT example_id, rank() OVER (PARTITION BY example_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY example_id, score) - 1) / 2 AS r1, rank() OVER (PARTITION BY example_id ORDER BY retrieval_score DESC) + (count(*) OVER (PARTITION BY example_id, retrieval_score) - 1) / 2 AS r2 FROM s WHERE retrieval_score IS NOT NULL),
        p AS (SELECT example_id, CASE WHEN count(*) < 2 OR var_pop(r1) = 0 OR var_pop(r2) = 0 THEN 0.0 ELSE corr(r1, r2) END AS v FROM q GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS examples, round(avg(v), 6) AS mean, CAST(count(*) FILTER (v > 1e-9) AS BIGINT) AS above_zero FROM p""",
    "hard_negative_sample": _C + f""", q AS (SELECT *, coalesce(is_positive, false) AS pos, coalesce(score, 0) AS s, {_POS} AS ps FROM c), a AS (SELECT *, bool_or(pos) OVER (PARTITION BY example_id) AS has FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY example_id, pos ORDER BY s DESC, ps) AS n FROM a WHERE has),
        e AS (SELECT *, NOT pos AND n <= 3 AS hard FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY example_id, pos, hard ORDER BY sha256('17|' || example_id || '|' || ps)) AS r FROM e)
        SELECT example_id, candidate_id, CASE WHEN pos THEN 'positive' WHEN hard THEN 'hard' ELSE 'random' END AS role FROM f WHERE CASE WHEN pos THEN n <= 1 ELSE hard OR r <= 2 END""",
    "category_first": _C + f""", q AS (SELECT *, {_POS} AS ps FROM c WHERE NOT is_positive AND negative_type IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY example_id, negative_type ORDER BY ps) = 1 AS fst FROM q)
        SELECT example_id, candidate_id, CAST(n AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY fst DESC, ps) AS n FROM f) WHERE n <= 4""",
    "stratified_round_robin": f"""WITH {v.EXAMPLES}, q AS (SELECT example_id, {v.sql_fold('kg')} AS kg, coalesce(len(positive_path.hops), -1) AS hops FROM x WHERE positive_path IS NOT NULL AND kg IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY kg, hops ORDER BY sha256(example_id)) AS rnd FROM q) SELECT example_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (ORDER BY rnd, kg, hops) AS place FROM r) WHERE place <= 500""",
    "answer_f1_contract": _GOLD + f""", k AS (SELECT negative_type, len(list_distinct(ans)) AS p, len(list_distinct(gold)) AS q, {_OVER} AS o FROM j) SELECT negative_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p = q AND o = p) AS BIGINT) AS exact, round(avg(CASE WHEN p + q = 0 THEN 1.0 ELSE 2.0 * o / (p + q) END), 9) AS f1 FROM k GROUP BY 1""",
    "answer_metrics_folded": _GOLD + f""", k AS (SELECT negative_type, {_KEYED.format('ans')} AS p, {_KEYED.format('gold')} AS q FROM j), o AS (SELECT *, len(list_intersect(p, q)) AS o FROM k)
        SELECT negative_type, round(avg(CASE WHEN len(p) = 0 THEN 0.0 ELSE o / len(p) END), 9) AS precision, round(avg(CASE WHEN len(q) = 0 THEN 0.0 ELSE o / len(q) END), 9) AS recall, round(avg(CASE WHEN len(p) + len(q) = 0 THEN 0.0 ELSE 2.0 * o / (len(p) + len(q)) END), 9) AS f1,
        round(avg(CASE WHEN len(q) > 0 AND p = q THEN 1.0 ELSE 0.0 END), 9) AS exact_match, round(avg(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END), 9) AS has_answer FROM o GROUP BY 1""",
    "answer_scores_raw": _GOLD + f""", k AS (SELECT negative_type, len(list_distinct(ans)) AS p, len(list_distinct(gold)) AS q, {_OVER} AS o FROM j) SELECT negative_type, round(avg(CASE WHEN p = q AND o = p THEN 1.0 ELSE 0.0 END), 9) AS em, round(avg(CASE WHEN p + q = 0 THEN 0.0 ELSE 2.0 * o / (p + q) END), 9) AS f1 FROM k GROUP BY 1""",
    "answerable_endpoints": _C + r""", q AS (SELECT negative_type, coalesce(answers, []) AS a, len(list_filter(coalesce(answers, []), lambda z: regexp_matches(trim(z), '^[a-z]\.[0-9a-z_]+$'))) AS u FROM c) SELECT negative_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (len(a) > 0 AND u < len(a)) AS BIGINT) AS answerable, CAST(sum(u) AS BIGINT) AS unlabeled FROM q GROUP BY 1""",
    "label_candidates": _GOLD + f""", {v.EXAMPLES}, k AS (SELECT array_to_string(j.relation_sequence, '|') = array_to_string(list_transform(x.positive_path.hops, lambda h: concat_ws('::', h.relation, h.direction)), '|') AS s, {_KEYED.format('ans')} AS p, {_KEYED.format('gold')} AS q FROM j LEFT JOIN x USING (example_id)),
        o AS (SELECT coalesce(s, false) AS annotated, len(q) > 0 AND p = q AS denotation FROM k) SELECT annotated, denotation, annotated OR denotation AS is_gold, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL""",
    "contingency": f"{_C}, {_PICK} SELECT {_TABLE.format('s', 'r')} FROM k",
    "compare_runs": f"""{_C}, {_PICK}, t AS (SELECT 'retrieval' AS left_run, 'score' AS right_run, {_TABLE.format('r', 's')} FROM k UNION ALL SELECT 'retrieval', 'sum', {_TABLE.format('r', 'u')} FROM k UNION ALL SELECT 'score', 'sum', {_TABLE.format('s', 'u')} FROM k),
        p AS (SELECT *, {_EXACT} AS p FROM t), h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, left_run, right_run) + 1)) AS st FROM p)
        SELECT left_run, right_run, "both", left_only, right_only, neither, round(p, 9) AS p, round(max(st) OVER (ORDER BY p, left_run, right_run ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM h""",
    "mcnemar_small": f"{_C}, {_PICK}, {v.EXAMPLES}, t AS (SELECT {v.sql_fold('x.kg')} AS kg, {_TABLE.format('s', 'u')} FROM k JOIN x USING (example_id) GROUP BY 1) SELECT kg, left_only, right_only, round({_EXACT}, 9) AS p FROM t",
    "auc_ties": _S + ", q AS (SELECT floor(score * 4) / 4 AS f, count(*) FILTER (is_positive) AS p, count(*) FILTER (NOT is_positive) AS n FROM s GROUP BY 1), w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won FROM q) SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(won) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 9) AS auc FROM w",
    "percentile_summary": _C + ", q AS (SELECT negative_type, retrieval_score AS s FROM c WHERE retrieval_score IS NOT NULL) SELECT negative_type, CAST(count(*) AS BIGINT) AS examples, round(avg(s), 9) AS mean, round(quantile_cont(s, 0.5), 9) AS median, round(quantile_cont(s, 0.1), 9) AS p10, round(quantile_cont(s, 0.25), 9) AS p25, " + ", ".join(f"round(avg(CASE WHEN s >= 0.{k} THEN 1.0 ELSE 0.0 END), 9) AS at_least_{k}0" for k in (6, 7, 8, 9)) + " FROM q GROUP BY 1",
    "listwise_loss": _S + ", m AS (SELECT example_id, is_positive, exp(score - max(score) OVER (PARTITION BY example_id)) AS e FROM s), g AS (SELECT example_id, sum(e) AS a, sum(e) FILTER (is_positive) AS p FROM m GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS groups, round(avg(ln(a) - ln(p)), 6) AS loss FROM g WHERE p IS NOT NULL",
    "bootstrap_ci": f"{_C}, {_RANK}, rr AS (SELECT example_id AS id, coalesce(1.0 / first_rank, 0.0)::DOUBLE AS v FROM r), {v.sql_resampled('rr', 200)} SELECT (SELECT count(*) FROM rr) AS n, (SELECT round(avg(v), 6) FROM rr) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
    "status_counts": f"SELECT coalesce({v.sql_fold('status')}, 'missing') AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (reason IS NOT NULL AND reason <> '') AS BIGINT) AS with_reason FROM (SELECT DISTINCT * FROM path_naturalizations) GROUP BY 1",
    "sliced_metrics": f"""{_C}, {_RANK}, {v.EXAMPLES}, j AS (SELECT coalesce(1.0 / first_rank, 0.0) AS rr, unnest(['all', 'kg:' || {v.sql_fold('x.kg')}, 'hops:' || len(positive_path.hops), 'type:' || positive_path.answer_type]) AS slice FROM r LEFT JOIN x USING (example_id)) SELECT slice, CAST(count(*) AS BIGINT) AS examples, round(avg(rr), 9) AS mrr FROM j WHERE slice IS NOT NULL GROUP BY 1""",
    "multiset_relations": f"""{_C}, {v.EXAMPLES}, j AS (SELECT c.relation_sequence AS a, list_transform(list_filter(x.positive_path.hops, lambda h: h IS NOT NULL), lambda h: concat_ws('::', h.relation, h.direction)) AS b FROM c JOIN x USING (example_id) WHERE c.relation_sequence IS NOT NULL AND x.positive_path.hops IS NOT NULL),
        k AS (SELECT list_sort(a) = list_sort(b) AS eq, len(list_filter(list_distinct(a), lambda z: len(list_filter(a, lambda y: y = z)) > len(list_filter(b, lambda y: y = z)))) = 0 AS le, len(list_filter(list_distinct(b), lambda z: NOT list_contains(a, z))) AS m FROM j)
        SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (eq) AS BIGINT) AS equal, CAST(count(*) FILTER (le AND NOT eq) AS BIGINT) AS part, CAST(sum(m) AS BIGINT) AS missing FROM k""",
    "embedding_cosine_topk": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
        s AS (SELECT q.id AS query_id, r.id, round(list_dot_product(q.v, r.v) / (q.n * r.n), 6) AS cosine FROM n q JOIN n r ON q.id % 100 = 0 AND q.id <> r.id)
        SELECT query_id, id, cosine, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM s) WHERE k <= 10""",
}

_RELS = "list_transform(coalesce({0}, []), lambda x: regexp_replace(x, '::[a-z]+$', ''))"
_TIMES = "len(list_filter({0}, lambda y: y = x))"
SQL["failure_categories"] = f"""{_C}, pool AS (SELECT example_id, list_distinct(flatten(list({_RELS.format('relation_sequence')}))) AS proposed FROM c GROUP BY 1),
    gold AS (SELECT example_id, {_RELS.format('relation_sequence')} AS reference, array_to_string(relation_sequence, '|') AS ref FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY candidate_index, candidate_id) AS n FROM c WHERE is_positive) WHERE n = 1),
    pick AS (SELECT example_id, {_RELS.format('relation_sequence')} AS selected, is_positive, answers, array_to_string(relation_sequence, '|') AS got, negative_type FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {_ORDER}) AS n FROM c) WHERE n = 1),
    j AS (SELECT pick.*, coalesce(reference, []) AS reference, ref, proposed FROM pick LEFT JOIN gold USING (example_id) JOIN pool USING (example_id)),
    k AS (SELECT *, len(list_filter(list_distinct(reference), lambda x: NOT list_contains(proposed, x))) > 0 AS never,
      len(selected) < len(reference) AND len(list_filter(list_distinct(selected), lambda x: {_TIMES.format('selected')} > {_TIMES.format('reference')})) = 0 AS part FROM j)
    SELECT CASE WHEN ref IS NULL THEN 'evidence_absent' WHEN coalesce(is_positive, false) THEN 'correct_answer' WHEN never THEN 'fragment_never_proposed' WHEN coalesce(negative_type = 'wrong_direction', false) THEN 'ranked_below'
      WHEN coalesce(len(answers) > 0, false) AND part THEN 'silent_incompleteness' WHEN coalesce(got = ref, false) THEN 'execution_normalization' ELSE 'fragment_pruned' END AS category, count(*) AS n FROM k GROUP BY 1"""
