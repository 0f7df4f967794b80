import pytest
from pyspark.sql import functions as F

from hopweave.functions import render
from hopweave.operators import evidence, graph, reader

HOPS = "array<struct<relation string, direction string, source_type string, target_type string>>"


def test_rendering(spark):
    hops = [("a.b.c_d", "forward", "film", "person"), ("a.b.e", "backward", "person", None)]
    df = spark.createDataFrame([(hops, "place")], f"h {HOPS}, t string")
    r = df.select(
        render.canonical_question(F.col("h"), F.col("t"), 1).alias("q"), render.logical_form(F.col("h")).alias("f"), render.shared_records(F.col("h")).alias("m"), render.covers(F.lit('Follow "c d" FORWARD and "e" backward'), F.col("h")).alias("c"), render.triples_of(F.col("h")).alias("t")
    ).first()
    assert r["q"] == 'Starting at [ENTITY], which place results when you follow "c d" forward to a person, then follow "e" backward to a entity?'
    assert r["f"] == "a.b.c_d(v0, v1) AND a.b.e(v2, v1) -> v2" and r["m"] == [] and r["c"] is True
    assert r["t"][1]["subject_type"] == "entity" and r["t"][1]["object_type"] == "person"
    rec = spark.createDataFrame([([("a.b.c", "backward", "x", "y"), ("a.b.d", "forward", "y", "z")],)], f"h {HOPS}").select(render.shared_records(F.col("h")).alias("m")).first()
    assert rec["m"] == ["v1"]


def test_candidate_text(spark):
    df = spark.createDataFrame([("q", None, "p", ["Vienna", " ", "m.0x"])], "q string, g string, p string, a array<string>")
    e = render.answer_evidence(F.col("a"), F.lit("city"))
    t = lambda mode: df.select(render.candidate_text(F.col("q"), F.col("g"), F.col("p"), e, mode).alias("t")).first()["t"]
    assert t("question_path") == "[ORIGINAL QUESTION]\nq\n\n[CANDIDATE PATH]\np"
    assert t("question_answer_labels").endswith("type: city\ncount: 2\nunlabeled ids: 1 of 2\nsample: Vienna; m.0x")
    with pytest.raises(ValueError, match="unknown mode"):
        t("other")
    assert df.select(render.sparql_relations(F.lit("?x ns:a.b ?y .\nFILTER(x)\nns:m ns:c.d ?x .")).alias("r")).first()["r"] == ["a.b", "c.d"]


def test_answer_lines(spark):
    rows = [
        ("1", "who?", ["Bob", "Al"], "ans: Bob\nans: Cy\nans: none\nans: Bob"),
        ("2", "when was it?", ["1990-01-02"], "ans: in 1990"),
        ("3", "where?", ["New York City"], "ans: New York"),
        ("4", "who?", ["New York City"], "ans: New York"),
        ("5", None, None, None),
        ("6", "who?", ["x"], "ans: not available"),
    ]
    df = spark.createDataFrame(rows, "id string, question string, ground_truth array<string>, prediction string")
    got = {r["id"]: (r["hit"], round(r["f1"], 6), r["no_answer"]) for r in reader.score_predictions(df).collect()}
    assert got == {"1": (1.0, 0.5, 0.0), "2": (1.0, 1.0, 0.0), "3": (1.0, 1.0, 0.0), "4": (0.0, 0.0, 0.0), "5": (0.0, 0.0, 1.0), "6": (0.0, 0.0, 1.0)}
    follow = {r["id"]: r["f"] for r in df.select("id", reader.needs_follow_up(F.col("prediction")).alias("f")).collect()}
    assert follow["1"] is False and follow["6"] is True
    lines = spark.createDataFrame([(["(a,x.y,b)", "(c,x.y,The D!)"], ["d"]), (["(a,x.y,b)"], []), ([], ["d"])], "l array<string>, a array<string>")
    assert [r["r"] for r in lines.select(reader.first_answer_rank(F.col("l"), F.col("a")).alias("r")).collect()] == [2, None, None]


def test_arms(spark):
    rows = [(f"i{k}", "all", m, a, float((k % 2 == 0) if a == "x" else 0)) for k in range(40) for m in ("m1", "m2") for a in ("x", "y")]
    df = spark.createDataFrame(rows, "id string, slice string, model string, arm string, value double")
    d = reader.arm_differences(df.where("model = 'm1'"), "x", "y", samples=200).first()
    assert d["n"] == 40 and d["delta"] == 0.5 and d["low"] < 0.5 < d["high"]
    assert reader.interaction(df, ("x", "y"), ("m1", "m2")).first()["interaction"] == 0.0


def test_coverage_and_programs(spark):
    schema = "question_id string, has_parse boolean, chain array<string>, quality string, n_constraints int, has_time boolean, has_order boolean"
    rows = [("kept", True, ["a"], "Complete", 0, False, False), ("both", True, ["a"], None, 2, False, False), ("both", True, ["a"], None, 0, False, True), ("none", False, None, None, None, None, None), ("long", True, ["a", "b", "c"], None, 0, False, False), ("kept", True, [], None, 0, False, False)]
    got = sorted((r["question_id"], r["reason"]) for r in evidence.coverage_reasons(spark.createDataFrame(rows, schema), 2).collect())
    assert got == [("both", "constraints"), ("both", "order"), ("kept", "supported"), ("long", "over_max_hops"), ("none", "no_parses")]
    prog = [("Find", ["Paris"]), ("Relate", ["capital of", "forward"]), ("FilterConcept", ["country"]), ("Relate", ["born in", "backward"]), ("FilterConcept", ["person"]), ("What", [])]
    p = spark.createDataFrame([("1", " who  is ", prog), ("2", "no", prog[:2])], "id string, question string, program array<struct<function string, inputs array<string>>>")
    r = evidence.program_paths(p).collect()
    assert len(r) == 1 and r[0]["anchor"] == "Paris" and r[0]["answer_type"] == "person" and [tuple(h) for h in r[0]["hops"]] == [("capital of", "forward", "entity", "country"), ("born in", "backward", "country", "person")]


def test_ceiling_and_rebuild(spark):
    x = spark.createDataFrame([("a", "1", True, ["x"], False), ("a", "2", True, ["x", "y"], False), ("b", "1", False, None, False), ("c", "1", True, [], False), ("d", "1", True, ["q"], False), ("e", "1", True, ["x"], True), ("f", "1", True, ["x"], False)], "question_id string, program_id string, compiled boolean, answers array<string>, identity boolean")
    g = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x"]), ("d", ["x"]), ("e", ["x"]), ("f", [])], "question_id string, gold array<string>")
    got = {r["question_id"]: r["status"] for r in evidence.ceiling(x, g).collect()}
    assert got == {"a": "exact", "b": "uncompiled", "c": "empty", "d": "disjoint", "e": "identity", "f": "empty_gold"}
    e = graph.edges(spark.createDataFrame([("q", "b", "r", "z")], "question_id string, head string, relation string, tail string"))
    c = spark.createDataFrame([("q", 0, ["r::forward"])], "question_id string, candidate_index int, sequence array<string>")
    a = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b")], "question_id string, position int, node string")
    r = evidence.rebuild_paths(e, c, a).first()
    assert (r["anchor"], r["answers"]) == ("b", ["z"])


def test_judgements(spark):
    c = spark.createDataFrame([("g", 0, True), ("g", 1, False), ("h", 0, True)], "k string, position int, is_positive boolean")
    full = spark.createDataFrame([("g", 0, True), ("g", 1, True), ("h", 0, True)], "k string, position int, verdict boolean")
    assert tuple(evidence.judge_summary(c, full, ["k"]).first()) == (2, 3, 1, 1)
    with pytest.raises(Exception, match="no judgement"):
        evidence.judge_summary(c, full.where("k = 'g'"), ["k"]).collect()
    judged = c.join(full.where("k = 'g'"), ["k", "position"], "left")
    assert sorted(r["kind"] for r in evidence.adjudication_picks(judged, ["k"], 0).collect()) == ["disagreement", "unclear"]
    assert evidence.adjudication_picks(judged, ["k"], 5).count() == 3


def test_scores_attach_by_place(spark):
    rows = spark.createDataFrame([("r", [("a",), None, ("b",)]), ("s", None)], "k string, c array<struct<x string>>")
    flat = evidence.flatten_candidates(rows, "k", "c")
    assert flat.count() == 3
    scores = flat.where("position <> 1").select("k", "position", (F.col("position") * 1.5).alias("score"))
    assert {r["k"]: r["scores"] for r in evidence.attach_scores(rows, scores, "k", "c").collect()} == {"r": [0.0, None, 3.0], "s": None}


def test_comparator_split_has_one_dev_group(spark):
    rows = [(f"g{i}", j, j == 0, float(j)) for i in range(4) for j in range(3)]
    got = evidence.comparator_corpus(spark.createDataFrame(rows, "k string, i int, pos boolean, s double"), ["k"], "s", "pos", "i").collect()
    assert len({r["k"] for r in got if r["split"] == "dev"}) == 1 and len(got) == 12


def _plans(spark, run):
    """Physical plans of everything that ``run`` executes, with the rows it gives."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = run().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = store.executionsList()
    return rows, [new.apply(i).physicalPlanDescription() for i in range(before, new.size())]


def _graphs(spark, folder):
    """Three questions: one topic with a walk to gold and one back, one without gold among its walks, one of two topics."""
    t = [("a", "r.s", "b"), ("b", "r.t", "c"), ("a", "r.s", "b"), ("d", "R.t", "a")]
    rows = [("q1", ["a"], ["c"], t), ("q2", ["a", None, "a"], ["z"], [*t[:2], None]), ("q3", ["a", "b"], ["c"], t), ("q4", ["a"], None, t), ("q5", None, ["c"], None)]
    spark.createDataFrame(rows, "question_id string, topic_entities array<string>, gold_answers array<string>, triples array<struct<head string, relation string, tail string>>").write.parquet(f"{folder}/question_graphs.parquet")
    return f"file://{folder}"


def test_identity_path_match_broadcasts_nothing(spark, tmp_path):
    from hopweave.catalogue import studies

    rows, plans = _plans(spark, lambda d=_graphs(spark, tmp_path): studies.identity_path_match(spark, d))
    assert [tuple(r) for r in rows] == [(2, 1, 1, 0)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_identity_populations_broadcast_nothing(spark, tmp_path):
    from hopweave.catalogue import studies

    rows, plans = _plans(spark, lambda d=_graphs(spark, tmp_path): studies.identity_populations(spark, d))
    assert {r["population"]: (r["n"], r["reducible"]) for r in rows} == {"all": (5, 0), "annotated_positive": (1, 0), "denotation_positive": (1, 0)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_identity_populations_need_one_row_a_question(spark, tmp_path):
    """Nothing is joined or staged, and a question's rows are shuffled once."""
    from hopweave.catalogue import studies

    _, plans = _plans(spark, lambda d=_graphs(spark, tmp_path): studies.identity_populations(spark, d))
    assert len(plans) == 1 and "Join" not in plans[0]
    assert plans[0].split("== Initial Plan ==")[-1].split("\n\n")[0].count("Exchange") == 2


def test_identity_populations_against_plain_sets(spark, tmp_path):
    """Random graphs of few nodes, with loops, repeated rows and triples, and names that hold the separator."""
    import random

    from hopweave.catalogue import studies

    rng, nodes, rows = random.Random(7), ["a", "b", "c", "a|b", "b|c"], []
    for q in range(200):
        t = [(rng.choice(nodes), rng.choice(["r.s", " NS:R.s", "r.t"]), rng.choice(nodes)) for _ in range(rng.randint(1, 8))]
        gold = rng.choice([["b|c"], ["b", "c"], ["a", "b"], ["a|b", None], ["a"], [], None])
        rows.append((f"q{q}", rng.choice([["a"], ["a"], ["a|b"], ["a", "b"], [None]]), gold, [*t, None, t[0], (None, "r.s", "b")]))
        rows += [rows[-1]] * (q % 3 == 0) + [(f"q{q}", None, None, [("a", "r.u", "c")])] * (q % 4 == 0)
    spark.createDataFrame(rows, "question_id string, topic_entities array<string>, gold_answers array<string>, triples array<struct<head string, relation string, tail string>>").write.parquet(f"{tmp_path}/question_graphs.parquet")
    edges, topics, gold = ({r[0]: set() for r in rows} for _ in range(3))
    for q, a, g, t in rows:
        topics[q] |= {x for x in a or [] if x}
        gold[q] |= {x for x in g or [] if x}
        for h, r, x in filter(None, t):
            if h:
                r = r.strip().lower().removeprefix("ns:")
                edges[q] |= {(h, f"{r}::forward", x), (x, f"{r}::backward", h)}
    counts = {}
    for q, e in edges.items():
        if len(topics[q]) != 1 or not gold[q]:
            continue
        step = lambda front, k, e=e: {y for x, key, y in e if key == k and x in front}
        walks = []
        for k1 in {k for _, k, _ in e}:
            for k2 in {k for _, k, _ in e}:
                if s2 := step(s1 := step(topics[q], k1), k2):
                    walks.append((s2 != gold[q], f"{k1}|{k2}", s1 == topics[q] or s2 == s1))
        for n, (missed, _, reducible) in enumerate(sorted(walks)):
            for name in ["all"] + ["denotation_positive", "annotated_positive" if n == 0 else "denotation_only_positive"] * (not missed):
                was = counts.get(name, (0, 0))
                counts[name] = (was[0] + 1, was[1] + reducible)
    got = {r["population"]: (r["n"], r["reducible"]) for r in studies.identity_populations(spark, f"file://{tmp_path}").collect()}
    assert got == counts and len(counts) == 4 and all(0 < r < n for n, r in counts.values())


def test_reduction_in_a_row_is_strict_reduce(spark):
    triples = spark.createDataFrame([("q", "a", "r", "a"), ("q", "a", "s", "b"), ("q", "b", "s", "a"), ("q", "b", "t", "c")], "question_id string, head string, relation string, tail string")
    keys = ["r::forward", "s::forward", "s::backward", "t::forward"]
    paths = spark.createDataFrame([("q", f"{x}{y}{z}", "a", [x, y, z]) for x in keys for y in keys for z in keys] + [("q", "none", "a", [])], "question_id string, path_id string, anchor string, sequence array<string>")
    slow = {r["path_id"]: r["reduced"] for r in graph.strict_reduce(graph.edges(triples), paths).collect()}
    own = triples.groupBy("question_id").agg(F.collect_list(F.struct("head", "relation", "tail")).alias("t")).select(graph.own_edges(F.col("t")).alias("e"))
    fast = {r["path_id"]: r["reduced"] for r in paths.crossJoin(own).select("path_id", graph.reduced(F.col("e"), F.col("anchor"), F.col("sequence")).alias("reduced")).collect()}
    assert fast == slow and len({tuple(x) for x in fast.values()}) > 5
