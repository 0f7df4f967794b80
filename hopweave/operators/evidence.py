"""Corpus evidence, labels, audits and ceilings around candidate paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text
from ..session import materialize
from . import graph, ranking


def relation_evidence(hops: DataFrame, triples: DataFrame, most: int = 4) -> DataFrame:
    """Type pairs and a few example facts of every relation in use.

    ``hops(relation, source_type, target_type)``, ``triples(head, relation, tail)``.
    """
    used = hops.where("relation is not null").groupBy("relation").agg(F.array_sort(F.collect_set(F.concat_ws(" -> ", F.coalesce("source_type", F.lit("entity")), F.coalesce("target_type", F.lit("entity"))))).alias("type_pairs"))
    facts = ranking.top_k(triples.select("relation", "head", "tail").distinct().join(used.select("relation"), "relation", "left_semi"), ["relation"], [F.col("head"), F.col("tail")], most)
    shown = facts.groupBy("relation").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "head", "tail"))).alias("facts"))
    return used.join(shown, "relation", "left").select("relation", "type_pairs", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def rebuild_paths(edge: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates' sequences run again from each anchor; the first anchor with answers is taken.

    ``candidates(question_id, candidate_index, sequence)``, ``anchors(question_id, position, node)``.
    """
    p = candidates.join(anchors, "question_id").select("question_id", F.concat_ws("|", "candidate_index", "position").alias("path_id"), F.col("node").alias("anchor"), "sequence", "candidate_index", "position")
    m = graph.materialize_paths(edge, p.select("question_id", "path_id", "anchor", "sequence"))
    j = m.join(p.select("question_id", "path_id", "candidate_index", "position"), ["question_id", "path_id"]).where(F.size("answers") > 0)
    return ranking.keep_first(j, ["question_id", "candidate_index"], [F.col("position")]).select("question_id", "candidate_index", "anchor", "answers", "facts")


def identity_audit(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reducible candidates per label population, and picks that match gold exactly or only once reduced.

    ``questions(question_id, anchor, edges array<struct<src, key, dst>>, candidates
    array<struct<candidate_index, sequence, score, annotated, denotation>>)``, one row for each
    question with one topic. Gold sequences are those of annotated candidates. A row has all that
    its candidates need, so nothing is joined and no walk is shuffled.
    """
    audit = lambda e: F.transform("candidates", lambda c: F.struct(c["candidate_index"].alias("candidate_index"), c["score"].alias("score"), c["annotated"].alias("annotated"), c["denotation"].alias("denotation"), c["sequence"].alias("whole"), graph.reduced(e, F.col("anchor"), c["sequence"]).alias("reduced")))
    j = questions.select("question_id", F.explode(text.let(F.col("edges"), audit)).alias("c")).select("question_id", "c.*")
    member = F.array_compact(F.array(F.lit("all"), F.when(F.col("annotated"), "annotated_positive"), F.when(F.col("denotation"), "denotation_positive"), F.when(F.col("denotation") & ~F.col("annotated"), "denotation_only_positive")))
    populations = j.select(F.explode(member).alias("population"), (F.col("reduced") != F.col("whole")).alias("reducible")).groupBy("population").agg(F.count("*").alias("n"), F.count_if("reducible").alias("reducible"))
    # the pick and the gold sequences of a question meet in one grouping, so the audit is not run twice and joined
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc_nulls_last(), F.col("candidate_index")))
    own = lambda a: F.collect_set(F.when(F.col("annotated"), F.col(a)))
    pick = F.max(F.when(F.col("n") == 1, F.struct("whole", "reduced")))
    picks = j.withColumn("n", place).groupBy("question_id").agg(pick.alias("pick"), own("whole").alias("gold"), own("reduced").alias("gold_reduced"))
    hit = lambda a, b: F.coalesce(F.array_contains(a, F.col(b)), F.lit(False))
    match = picks.select(hit("gold", "pick.whole").alias("exact"), hit("gold_reduced", "pick.reduced").alias("collapsed")).agg(F.count("*").alias("questions"), F.count_if("exact").alias("exact"), F.count_if("collapsed").alias("collapsed"), F.count_if(F.col("exact") != F.col("collapsed")).alias("flips"))
    return populations, match


def comparator_corpus(candidates: DataFrame, keys: list[str], score: str, positive: str, position: str, dev: float = 0.1, seed: str = "17") -> DataFrame:
    """Sampled groups with a positive, and a dev split of ``max(1, round(n * dev))`` groups by hash order."""
    s = ranking.sample_candidates(candidates, keys, score, positive, position, seed=seed)
    n = s.select(*keys).distinct().count()
    chosen = ranking.exact_sample(s, keys, max(1, round(n * dev)) if n else 0, seed).withColumn("_dev", F.lit(True))
    return s.join(chosen, keys, "left").withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).drop("_dev")


def supervision_study(labelled: DataFrame) -> DataFrame:
    """The same candidates under three labelings: ``mode`` and ``label`` from ``annotated`` and ``denotation``."""
    mode = F.explode(F.array(F.struct(F.lit("annotated").alias("m"), F.col("annotated").alias("l")), F.struct(F.lit("denotation").alias("m"), F.col("denotation").alias("l")), F.struct(F.lit("either").alias("m"), (F.col("annotated") | F.col("denotation")).alias("l"))))
    return labelled.withColumn("_x", mode).select(*[f"`{c}`" for c in labelled.columns], F.col("_x.m").alias("mode"), F.col("_x.l").alias("label"))


def judge_summary(candidates: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of path labels with a judge's; a candidate without a judgement is an error.

    ``candidates(*keys, position, is_positive)``, ``labels(*keys, position, verdict boolean)``.
    """
    j = candidates.join(labels, [*keys, "position"], "left")
    verdict = F.when(F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.raise_error(F.lit("a candidate has no judgement")).cast("boolean"))
    g = j.withColumn("verdict", verdict).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != F.col("is_positive")).alias("disagreements"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("candidates"), F.sum("disagreements").alias("disagreements"), F.count_if(F.col("disagreements") > 0).alias("disputed_groups"))


def adjudication_picks(judged: DataFrame, keys: list[str], agreements: int, seed: str = "17") -> DataFrame:
    """Disagreements, unclear verdicts and a hash sample of agreements, each candidate once.

    ``judged(*keys, position, is_positive, verdict)``, verdict null where unclear.
    """
    kind = F.when(F.col("verdict").isNull(), "unclear").when(F.col("verdict") != F.col("is_positive"), "disagreement").otherwise("agreement")
    j = ranking.keep_first(judged.withColumn("kind", kind), [*keys, "position"], [F.col("kind")])
    sample = j.where("kind = 'agreement'").withColumn("_h", ranking.hash_order(seed, *keys, "position")).orderBy("_h").limit(agreements).drop("_h")
    return j.where("kind <> 'agreement'").unionByName(sample)


def apply_adjudication(candidates: DataFrame, picks: DataFrame, second: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates with ``disputed`` and ``set_disputed``, and one row of counts.

    ``picks(*keys, position, verdict, kind)`` were judged again in ``second(*keys, position,
    verdict)``; a pick without a second judgement is an error. A candidate is disputed where the
    judges differ (an unclear first verdict differs from any), a set where one of its candidates is.
    """
    at = [*keys, "position"]
    j = picks.join(second.select(*at, F.col("verdict").alias("second")), at, "left")
    again = F.when(F.col("second").isNotNull(), F.col("second")).otherwise(F.raise_error(F.lit("a pick has no second judgement")).cast("boolean"))
    j = j.withColumn("agree", again.eqNullSafe(F.col("verdict")))
    c = candidates.join(j.where("not agree").select(*at, F.lit(True).alias("disputed")), at, "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))
    c = c.withColumn("set_disputed", F.max("disputed").over(Window.partitionBy(*keys)))
    judged = j.agg(F.count("*").alias("adjudicated"), F.count_if("agree").alias("judges_agree"), *[F.count_if(F.col("kind") == k).alias(f"from_{k}") for k in ("disagreement", "unclear", "agreement")])
    sets = c.select(*keys, "set_disputed").distinct().agg(F.count("*").alias("sets"), F.count_if("set_disputed").alias("disputed_sets"))
    return c, judged.crossJoin(sets)  # one row each


def coverage_reasons(parses: DataFrame, max_hops: int) -> DataFrame:
    """Why questions are left out: ``question_id, kept, reason`` (one row per question and distinct reason).

    ``parses(question_id, chain array<string>, quality, n_constraints, has_time, has_order)``;
    a question is kept if one parse has no reason, one without a parse has the reason ``no_parses``.
    """
    n = F.coalesce(F.size("chain"), F.lit(0))
    reason = (
        F.when(n <= 0, "no_inferential_chain")
        .when(n > max_hops, "over_max_hops")
        .when(F.col("quality") == "Incomplete", "incomplete_parse")
        .when(F.coalesce("n_constraints", F.lit(0)) > 0, "constraints")
        .when(F.col("has_time"), "time")
        .when(F.col("has_order"), "order")
        .otherwise("kept")
    )
    p = parses.withColumn("reason", F.when(F.col("has_parse"), reason).otherwise("no_parses"))
    g = p.groupBy("question_id").agg(F.bool_or(F.col("reason") == "kept").alias("kept"), F.collect_set("reason").alias("reasons"))
    return g.select("question_id", "kept", F.explode(F.when(F.col("kept"), F.array(F.lit("supported"))).otherwise(F.col("reasons"))).alias("reason"))


def program_paths(programs: DataFrame) -> DataFrame:
    """Typed paths of annotated programs with one of the two chain signatures.

    ``programs(id, question, program array<struct<function, inputs array<string>>>)``.
    """
    # The two chains of functions that are paths.
    chains = (("Find", "Relate", "FilterConcept", "What"), ("Find", "Relate", "FilterConcept", "Relate", "FilterConcept", "What"))
    names = F.array_join(F.transform("program", lambda s: s["function"]), "|")
    ok = programs.where(names.isin(*["|".join(c) for c in chains]))
    relate = F.filter(F.transform("program", lambda s, i: F.struct(s["function"].alias("f"), s["inputs"].alias("x"), F.get(F.get("program", i + 1)["inputs"], F.lit(0)).alias("t"))), lambda s: s["f"] == "Relate")
    typed = ok.withColumn("_r", relate)
    hop = F.transform("_r", lambda s, i: F.struct(F.get(s["x"], F.lit(0)).alias("relation"), F.get(s["x"], F.lit(1)).alias("direction"), F.when(i == 0, "entity").otherwise(F.get("_r", i - 1)["t"]).alias("source_type"), s["t"].alias("target_type")))
    return typed.select("id", text.normalize_space("question").alias("question"), F.get(F.get("program", F.lit(0))["inputs"], F.lit(0)).alias("anchor"), hop.alias("hops")).withColumn("answer_type", F.element_at("hops", -1)["target_type"])


def ceiling_by_kind(statuses: DataFrame, kinds: DataFrame) -> DataFrame:
    """Two-level counts: ``kind, status, questions, f1`` from :func:`ceiling` and ``kinds(question_id, kind)``."""
    return statuses.join(kinds, "question_id").groupBy("kind", "status").agg(F.count("*").alias("questions"), F.avg("f1").alias("f1"))


def ceiling(executed: DataFrame, gold: DataFrame) -> DataFrame:
    """Status of executed programs against gold answers: ``question_id, status, f1``.

    ``executed(question_id, program_id, compiled, answers, identity)``; per question the best F1
    counts, the first program on ties. Questions without gold answers are told apart, identity
    traversals too.
    """
    j = executed.join(gold, "question_id", "left")
    s = A.contract_scores(F.col("answers"), F.col("gold"))
    best = ranking.keep_first(j.withColumn("f1", F.when(F.col("compiled"), s["f1"]).otherwise(-1.0)).withColumn("exact", s["exact"]), ["question_id"], [F.col("f1").desc(), F.col("program_id")])
    n = F.coalesce(F.size("answers"), F.lit(0))
    overlap = F.size(F.array_intersect(F.coalesce("answers", F.array().cast("array<string>")), F.coalesce("gold", F.array().cast("array<string>"))))
    status = (
        F.when(~F.col("compiled"), "uncompiled")
        .when(F.coalesce(F.size("gold"), F.lit(0)) <= 0, "empty_gold")
        .when(F.col("identity"), "identity")
        .when(F.col("exact"), "exact")
        .when(n <= 0, "empty")
        .when(overlap > 0, "partial")
        .otherwise("disjoint")
    )
    return best.select("question_id", status.alias("status"), F.greatest("f1", F.lit(0.0)).alias("f1"))


def view_audit(picks: DataFrame, ranks: DataFrame, left: str, right: str) -> DataFrame:
    """Agreement, gain of an oracle over the better view, and mean rank advantage of one view.

    ``picks(question_id, view, candidate_id, correct)``, ``ranks(question_id, view, first_rank)``.
    """
    wide = picks.groupBy("question_id").pivot("view", [left, right]).agg(F.first("candidate_id").alias("pick"), F.max("correct").alias("ok"))
    c = lambda v, n: F.col(f"`{v}_{n}`")
    base = wide.agg(
        F.count("*").alias("questions"),
        F.avg((c(left, "pick") == c(right, "pick")).cast("double")).alias("agreement"),
        (F.avg((c(left, "ok") | c(right, "ok")).cast("double")) - F.greatest(F.avg(c(left, "ok").cast("double")), F.avg(c(right, "ok").cast("double")))).alias("oracle_gain"),
    )
    r = ranks.groupBy("question_id").pivot("view", [left, right]).agg(F.max("first_rank"))
    adv = r.agg(F.avg(F.col(f"`{right}`") - F.col(f"`{left}`")).alias("rank_advantage"), F.count_if((F.col(f"`{left}`") <= 5) & (F.col(f"`{right}`") > 5)).alias("into_top5"), F.count_if((F.col(f"`{left}`") > 5) & (F.col(f"`{right}`") <= 5)).alias("out_of_top5"))
    return base.crossJoin(adv)  # one row each


def matched_pairs(rows: DataFrame, keys: list[str], flag: str, control: str) -> DataFrame:
    """For each flagged row of a group the unflagged one closest in ``control`` (then the larger, then by id).

    ``rows(*keys, id, flag, control)``: ``*keys, id, matched_id, gap``. The nearest ones are the
    neighbours in the order of ``control``, so no pairs are made.
    """
    free = rows.where(~F.col(flag)).groupBy(*keys, F.col(control).alias("_c")).agg(F.min("id").alias("_id")).withColumn("_flag", F.lit(0))
    mine = rows.where(F.col(flag)).select(*keys, F.col(control).alias("_c"), F.col("id").alias("_id"), F.lit(1).alias("_flag"))
    w = Window.partitionBy(*keys).orderBy("_c", "_flag", "_id")
    other = F.when(F.col("_flag") == 0, F.struct("_c", "_id"))
    near = mine.unionByName(free.select(*mine.columns)).withColumn("_low", F.last(other, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_high", F.first(other, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    below, above = F.col("_c") - F.col("_low._c"), F.col("_high._c") - F.col("_c")
    upper = F.col("_high").isNotNull() & (F.col("_low").isNull() | (above <= below))
    best = near.where("_flag = 1 and (_low is not null or _high is not null)")
    return best.select(*keys, F.col("_id").alias("id"), F.when(upper, F.col("_high._id")).otherwise(F.col("_low._id")).alias("matched_id"), F.when(upper, above).otherwise(below).alias("gap"))


def flatten_candidates(rows: DataFrame, key: str, candidates: str) -> DataFrame:
    """Nested candidates as rows with their place: ``key, position, candidate``."""
    return rows.select(key, F.posexplode(candidates).alias("position", "candidate"))


def attach_scores(rows: DataFrame, scores: DataFrame, key: str, candidates: str) -> DataFrame:
    """Scores ``(key, position, score)`` put back as an array beside the nested candidates; a missing score is null."""
    by = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "score"))).alias("_m"))
    at = F.transform(F.col(candidates), lambda _, i: F.try_element_at("_m", i))
    return rows.join(by, key, "left").withColumn("scores", at).drop("_m")


def generation_metrics(df: DataFrame, keys: list[str], score: str, positive: str, category: str) -> tuple[DataFrame, DataFrame]:
    """Does the positive outscore all negatives, by how much over the best, and by category of negative?"""
    w = Window.partitionBy(*keys)
    m = df.where(F.col(score).isNotNull()).withColumn("_p", F.max(F.when(F.col(positive), F.col(score))).over(w)).where("_p is not null and not " + positive)
    g = m.groupBy(*keys).agg((F.max("_p") - F.max(score)).alias("margin"))
    whole = g.agg(F.count("*").alias("groups"), F.avg((F.col("margin") > 0).cast("double")).alias("beats_all"), F.avg("margin").alias("mean_margin"))
    by = m.groupBy(category).agg(F.count("*").alias("pairs"), F.avg((F.col("_p") > F.col(score)).cast("double")).alias("beaten"))
    return whole, by


def compact_queries(paths: DataFrame, glossary: DataFrame, key: str = "example_id") -> DataFrame:
    """``key, query, unusable``: each path as anchor, required facts in their relations' words, and what is returned.

    ``paths(key, kg, hops)``, ``glossary(relation_key, status, description, fact_template)``.
    ``unusable`` lists the relations without a semantic entry. A path's facts are gathered again
    by its key, so nothing larger than a path is in one place.
    """
    from ..functions import render

    # used twice below; staged also so that the check of hops is not pushed beneath the caller's filters
    q = materialize(materialize(paths.select(key, "kg", "hops"), "hops").select(key, "kg", render.represent_query(F.col("hops")).alias("q")), "queries")
    fact = q.select(key, "kg", F.posexplode("q.facts").alias("place", "fact")).withColumn("relation_key", F.concat_ws("::", "kg", "fact.predicate"))
    g = glossary.where("relation_key is not null").groupBy("relation_key").agg(F.min_by(F.struct("status", "description", "fact_template"), F.xxhash64("status", "description", "fact_template")).alias("g")).select("relation_key", "g.*")
    j = fact.join(g.withColumn("known", F.lit(True)), "relation_key", "left")
    line = F.concat(F.lit("F"), F.col("place").cast("string"), F.lit(": "), render.fact_statement(F.col("fact"), F.col("description"), F.when(F.col("known"), F.col("fact_template"))))
    bad = F.when(~F.coalesce(F.col("status") == "semantic", F.lit(False)), F.col("fact.predicate"))
    facts = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), bad.alias("bad")))).alias("f"))
    v0, answer = F.get("q.variables", F.lit(0)), F.col("q")
    text_of = F.concat_ws("\n", F.concat(F.lit("Anchor: v0 = [ENTITY] (type: "), v0["type"], F.lit(")")), F.lit("Required facts:"), F.array_join(F.transform("f", lambda x: x["line"]), "\n"), F.concat(F.lit("Return: "), answer["answer"], F.lit(" (type: "), answer["answer_type"], F.lit(")")))
    return q.join(facts, key).select(key, text_of.alias("query"), F.array_compact(F.transform("f", lambda x: x["bad"])).alias("unusable"))


def annotated_paths(questions: DataFrame, types: DataFrame) -> DataFrame:
    """Typed paths of annotated parses: ``id, question, anchor, hops, answer_type``.

    ``questions(QuestionId, RawQuestion, Parses array<struct<...>>)`` with the fields read below;
    ``types(question_id, node, type)`` of the questions' graphs. A parse counts with a chain of
    one to three relations, complete, without constraints, time or order, and where its query
    text leads along the chain to the answer. Types of topic and answers come from the graph,
    else from the relation read forward.
    """
    from pyspark.sql.types import ArrayType, StringType

    from ..plans.programs import recover_route

    @F.pandas_udf(ArrayType(StringType()))
    def directions(sparql, topic, chain):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(s: str | None, t: str | None, c: list | None) -> list[str] | None:
            route = recover_route(s or "", t or "", list(c)) if c is not None and len(c) else None
            return [d for _, d in route] if route else None

        return pd.Series([one(s, t, c) for s, t, c in zip(sparql, topic, chain, strict=True)])

    p = questions.select("QuestionId", "RawQuestion", F.posexplode("Parses").alias("n", "p")).select("QuestionId", "RawQuestion", "n", "p.*")
    chain = F.coalesce("InferentialChain", F.array().cast("array<string>"))
    whole = F.size(chain).between(1, 3) & ~F.coalesce(F.col("AnnotatorComment.ParseQuality") == "Incomplete", F.lit(False)) & (F.coalesce(F.size("Constraints"), F.lit(0)) <= 0) & F.col("Time").isNull() & F.col("Order").isNull()
    p = p.where(whole).withColumn("ways", directions("Sparql", "TopicEntityMid", "InferentialChain")).where("ways is not null")
    topic = F.coalesce(F.when(F.col("TopicEntityName") != "", F.col("TopicEntityName")), F.when(F.col("PotentialTopicEntityMention") != "", F.col("PotentialTopicEntityMention")), F.lit("ENTITY_0"))
    p = p.select(F.concat_ws(":", F.lit("webqsp"), "QuestionId", "n").alias("id"), "QuestionId", text.normalize_space("RawQuestion").alias("question"), topic.alias("anchor"), F.arrays_zip(F.col("InferentialChain").alias("relation"), F.col("ways").alias("direction")).alias("steps"), F.coalesce(F.transform("Answers", lambda a: a["EntityName"]), F.array().cast("array<string>")).alias("names"))
    sets = types.groupBy(F.col("question_id").alias("QuestionId"), "node").agg(F.collect_set("type").alias("t"))
    named = p.select("id", "QuestionId", F.explode(F.array_union(F.array("anchor"), "names")).alias("node")).join(sets, ["QuestionId", "node"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("node", "t"))).alias("of"))
    j = p.join(named, "id", "left")
    kinds = lambda nodes: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(nodes, lambda x: F.coalesce(F.try_element_at("of", x), F.array().cast("array<string>")))))), " / ")
    given = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    source = lambda r: F.when(F.size(F.split(r, r"\.")) >= 2, F.replace(F.array_join(F.slice(F.split(r, r"\."), 1, 2), " "), F.lit("_"), F.lit(" "))).otherwise("entity")
    first, n = F.get("steps", F.lit(0)), F.size("steps")
    start = given(kinds(F.array("anchor")), F.when(first["direction"] == "forward", source(first["relation"])).otherwise("entity"))
    end = given(kinds(F.col("names")), F.lit("answer entity"))
    follows = lambda i: F.get("steps", i + 1)
    target = lambda i: F.when(i == n - 1, F.col("_end")).when(follows(i)["direction"] == "forward", source(follows(i)["relation"])).otherwise("intermediate entity")
    j = j.withColumn("_start", start).withColumn("_end", end).withColumn("_targets", F.transform("steps", lambda s, i: target(i)))
    hops = F.transform("steps", lambda s, i: F.struct(s["relation"].alias("relation"), s["direction"].alias("direction"), F.when(i == 0, F.col("_start")).otherwise(F.get("_targets", i - 1)).alias("source_type"), F.get("_targets", i).alias("target_type")))
    return j.select("id", "question", "anchor", hops.alias("hops"), F.col("_end").alias("answer_type"))
