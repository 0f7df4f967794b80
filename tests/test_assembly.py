import json

import pytest
from pyspark.sql import functions as F

from hopweave.operators import assembly, evidence, graph, pilot, ranking, requests, retrieval, runs
from hopweave.sources import files

T = "question_id string, head string, relation string, tail string"
HOPS = "struct<hops array<struct<relation string, direction string>>>"


def test_executable_patterns(spark):
    rows = [("q", "a", "town.mayor", "b"), ("q", "b", "person.boat", "c"), ("q", "a", "town.river", "d"), ("q", "a", graph.TYPE_RELATION, "Town"), ("other", "x", "r", "y")]
    e = graph.edges(spark.createDataFrame(rows, T))
    anchors = spark.createDataFrame([("q", "a"), ("other", "x"), ("gone", "z")], "question_id string, node string")
    gold = spark.createDataFrame([("q", ["town.mayor::forward", "person.boat::forward"]), ("q", None), ("other", ["no::forward"]), ("gone", ["r::forward"])], "question_id string, sequence array<string>")
    questions = spark.createDataFrame([("q", "which boat has the mayor?"), ("other", None)], "question_id string, question string")
    kept, summary = retrieval.executable_patterns(e, anchors, gold, questions, 2)
    assert [(tuple(r["sequence"]), r["is_gold"], r["rank"]) for r in kept.orderBy("rank").collect()] == [(("town.mayor::forward",), False, 1), (("town.mayor::forward", "person.boat::forward"), True, 2)]
    assert tuple(summary.first()) == (2, 1, 1, 2.0)
    none, summary = retrieval.executable_patterns(e, anchors.limit(0), gold, questions)
    assert none.count() == 0 and summary.first()["questions"] == 0


def test_best_families_and_availability(spark):
    rows = [("q", "a", ["r"], 0.5, ["x"]), ("q", "a", ["r"], 0.9, ["y"]), ("q", "a", ["s"], 2.0, []), ("q", "a", [], 3.0, ["x"]), ("q", "b", ["r"], None, ["x"])]
    got = retrieval.best_families(spark.createDataFrame(rows, "question_id string, anchor string, sequence array<string>, score double, answers array<string>"))
    assert [(r["anchor"], r["score"], r["rank"]) for r in got.orderBy("rank").collect()] == [("a", 0.9, 1), ("b", None, 2)]
    e = graph.edges(spark.createDataFrame([("q", "a", "r", "b")], T))
    gold = spark.createDataFrame([("q", ["r::forward"]), ("q", ["s::forward"]), ("p", ["r::forward"])], "question_id string, sequence array<string>")
    topics = spark.createDataFrame([("q", "a"), ("p", "a")], "question_id string, node string")
    assert {r["question_id"]: r["available"] for r in retrieval.gold_available(e, topics, gold).collect()} == {"q": True, "p": False}


def test_assembled_examples(spark):
    h = lambda *r: ([(x, "forward") for x in r],)
    rows = [
        ("ok", "q?", h("a"), [h("b")], [h("a"), h("b"), h("c"), h("c"), None, ([],), ([("d", None)],)], "x"),
        ("bad", "q?", h("a"), None, [h("a")], "x"),
        ("path", "q?", (None,), None, [h("c")], "x"),
        ("ask", " ", h("a"), None, [h("c")], "x"),
        (None, "q?", h("a"), None, [h("c")], "x"),
    ]
    df = spark.createDataFrame(rows, f"example_id string, question string, positive_path {HOPS}, alternate_positive_paths array<{HOPS}>, negative_paths array<{HOPS}>, reason string")
    good, bad = assembly.assemble(df.drop("reason"))
    assert [(r["example_id"], len(r["negative_paths"])) for r in good.collect()] == [("ok", 1)]
    assert {r["example_id"]: r["reason"] for r in bad.collect()} == {"bad": "no_negative", "path": "no_path", "ask": "no_question", None: "no_id"}


def test_direction_examples_and_merge(spark):
    pairs = spark.createDataFrame([("k", "r", "f", "b", "train")], "kg string, relation string, forward_id string, backward_id string, split string")
    rows = spark.createDataFrame([("f", "fq", "fp"), ("b", "bq", "bp")], "id string, question string, path string")
    both = assembly.both_directions(assembly.direction_examples(pairs, rows)).orderBy("example_id").collect()
    assert [(r["question"], r["positive_path"], r["negative_path"], r["sequence"]) for r in both] == [("fq", "fp", "bp", ["r::forward"]), ("bq", "bp", "fp", ["r::backward"])]
    base = spark.createDataFrame([("b1", "q")], "example_id string, question string")
    extra = spark.createDataFrame([("e1", "q?", 1), ("e2", "no", 2)], "example_id string, question string, n int")
    got, left = assembly.merged(base, extra, F.when(~F.col("question").endswith("?"), "form"))
    assert sorted(r["example_id"] for r in got.collect()) == ["b1", "e1"] and [tuple(r) for r in left.select("example_id", "reason").collect()] == [("e2", "form")]


def test_synthetic_quotas(spark):
    rows = [("k", f"a{i}", ["r::forward"] * (1 + i % 2), f"e{i}") for i in range(40)] * 2 + [("k", None, ["r"], "e"), ("k", "a", [], "e")]
    got = assembly.synthesize(spark.createDataFrame(rows, "kg string, anchor string, sequence array<string>, end string"), 5).collect()
    assert sorted(r["depth"] for r in got) == [1] * 5 + [2] * 5 and len({r["split"] for r in got if r["depth"] == 1}) == 1


def write_run(folder, picks=None, scores=None, predictions=None):
    folder.mkdir()
    (folder / "metrics.json").write_text('{"n": 1}')
    for name, rows in (("picks", picks), ("scores", scores), ("predictions", predictions)):
        if rows is not None:
            (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(folder)


def test_runs_and_their_guards(spark, tmp_path):
    pick = lambda q: {"question_id": q, "candidate_index": 0, "relation_sequence": ["r::forward"], "exact_match": 1.0, "f1": 0.5}
    score = lambda q, s: {"question_id": q, "candidates": [{"candidate_index": 0, "relation_sequence": ["r::forward"], "score": s}, {"candidate_index": 1, "relation_sequence": ["s::forward"], "score": 0.1}]}
    load = lambda *a, **k: runs.load_run(spark, write_run(*a, **k))
    a = load(tmp_path / "a", [pick("q1"), pick("q2")], [score("q1", 1.0), score("q2", 2.0)])
    b = load(tmp_path / "b", [pick("q2"), pick("q1")], [score("q2", 0.3), score("q1", 0.2)])
    assert a.kind == "answer_selection" and a.metrics == {"n": 1} and a.picks.count() == 2
    runs.comparable([a, b])
    other = load(tmp_path / "c", [pick("q1"), pick("q3")], [score("q1", 1.0), score("q3", 1.0)])
    with pytest.raises(ValueError, match="questions"):
        runs.comparable([a, other])
    fewer = score("q2", 1.0)
    fewer["candidates"].pop()
    with pytest.raises(ValueError, match="pools"):
        runs.comparable([a, load(tmp_path / "d", [pick("q1"), pick("q2")], [score("q1", 1.0), fewer])])
    hop = {"hops": [{"relation": "r", "direction": "forward"}]}
    p = load(tmp_path / "p", predictions=[{"example_id": "q1", "candidates": [{"path": None, "is_positive": True, "cross_encoder_score": 0.5}, {"path": hop, "is_positive": None, "cross_encoder_score": 0.9}, {"path": hop, "is_positive": True, "cross_encoder_score": 0.9}]}])
    assert p.kind == "candidate_ranking" and tuple(p.picks.first()) == ("q1", 1, ["r::forward"], 0.0, 0.0)
    with pytest.raises(ValueError, match="kinds"):
        runs.comparable([a, p])
    with pytest.raises(ValueError, match="two"):
        runs.comparable([a])
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "e")


def test_pair_means_skip_nulls(spark):
    got = {r["k"]: tuple(r)[1:] for r in runs.pair_means(spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, x double"), "k", ["x"]).collect()}
    assert got == {"a": (2, 1.0), "b": (1, None)}


def test_pilot_sample_and_evaluation(spark):
    rows = spark.createDataFrame([(f"s{i}", 1 + i % 10) for i in range(20)] + [(f"d{i}", 51 + i) for i in range(7)] + [("mid", 30), ("none", None)], "id string, evidence_rank int")
    got = pilot.select_pilot(rows, 10).groupBy("pilot_bucket").count().collect()
    assert {r["pilot_bucket"]: r["count"] for r in got} == {"shallow_1_10": 7, "deep_51_100": 7}
    with pytest.raises(ValueError):
        pilot.select_pilot(rows.where("evidence_rank < 20"), 10)
    scores = spark.createDataFrame([(f"i{i}", m, a, "f1", float(v + i % 2)) for i in range(30) for m, a, v in (("x", "new", 3), ("x", "old", 1), ("y", "new", 1), ("y", "old", 0))], "id string, model string, arm string, metric string, value double")
    pilot.require_complete(scores)
    with pytest.raises(ValueError):
        pilot.require_complete(scores.where("not (id = 'i3' and arm = 'old' and model = 'y')"))
    slices = spark.createDataFrame([(f"i{i}", s) for i in range(30) for s in ("all", "even" if i % 2 == 0 else "odd")], "id string, slice string")
    assert {r["mean"] for r in pilot.arm_means(scores, slices).where("slice = 'even' and model = 'x' and arm = 'new'").collect()} == {3.0}
    e = {(r["slice"], r["model"]): (r["n"], r["delta"], r["low"], r["high"]) for r in pilot.effects(scores, slices, [("new", "old")], 50).collect()}
    assert len(e) == 6 and e["all", "x"] == (30, 2.0, 2.0, 2.0)
    i = pilot.interactions(scores, slices, [("new", "old")], ("x", "y"), 50).where("slice = 'all'").first()
    assert (i["n"], i["interaction"]) == (30, 1.0)


def test_requests_and_results(spark):
    items = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, prompt string")
    b = requests.batched(items, 3, "id", F.col("prompt"), bucket=4).collect()
    assert sorted(x for r in b for x in r["items"]) == sorted(f"p{i}" for i in range(40)) and max(len(r["items"]) for r in b) == 3
    line = json.loads(items.limit(1).select(requests.chat_request(F.lit("c"), "sys", F.col("prompt"), "m").alias("l")).first()["l"])
    assert line["custom_id"] == "c" and [m["role"] for m in line["body"]["messages"]] == ["system", "user"]
    wrap = lambda cid, content, **k: json.dumps({"custom_id": cid, "response": {"body": {"choices": [{"message": {"content": content}}]}}, **k})
    lines = [
        wrap("1", json.dumps({"items": [{"id": "a", "status": "natural", "question": "old"}, {"id": None}]})),
        wrap("2", "```json\n" + json.dumps({"items": [{"id": "a", "status": "natural", "question": "new"}, {"id": "b"}]}) + "\n```"),
        wrap("3", "sorry"), wrap("4", None), wrap(None, "x"), "{broken", wrap("5", "x", error="e"),
    ]
    good, bad = requests.parse_results(spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, file string, line_no int"))
    assert {r["id"]: r["question"] for r in good.collect()} == {"a": "new", "b": None}
    assert [r["reason"] for r in bad.orderBy("line_no").collect()] == ["no_items", "no_content", "no_id", "no_id", "error"]
    judged = spark.createDataFrame([("a", True), ("b", None)], "id string, ok boolean")
    assert [r["id"] for r in requests.accepted(good, judged, F.col("ok")).collect()] == ["a"]


def test_quotas_are_repaired():
    assert ranking.split_quotas({"train": 5, "dev": 5}, 5) == {"train": 3, "dev": 2}
    assert ranking.split_quotas({"a": 3, "b": 3, "c": 3}, 4) == {"a": 2, "b": 1, "c": 1}
    assert ranking.split_quotas({"a": 2}, 9) == {"a": 2} and ranking.split_quotas({}, 3) == {} and ranking.split_quotas({"a": 0}, 3) == {"a": 0}


def test_adjudication(spark):
    c = spark.createDataFrame([("g", 0, True), ("g", 1, False), ("h", 0, True)], "k string, position int, is_positive boolean")
    picks = spark.createDataFrame([("g", 0, True, "agreement"), ("g", 1, None, "unclear")], "k string, position int, verdict boolean, kind string")
    second = spark.createDataFrame([("g", 0, True), ("g", 1, False)], "k string, position int, verdict boolean")
    rows, counts = evidence.apply_adjudication(c, picks, second, ["k"])
    assert {(r["k"], r["position"]): (r["disputed"], r["set_disputed"]) for r in rows.collect()} == {("g", 0): (False, True), ("g", 1): (True, True), ("h", 0): (False, False)}
    assert counts.first().asDict() == {"adjudicated": 2, "judges_agree": 1, "from_disagreement": 0, "from_unclear": 1, "from_agreement": 1, "sets": 2, "disputed_sets": 1}
    with pytest.raises(Exception, match="second judgement"):
        evidence.apply_adjudication(c, picks, second.limit(1), ["k"])[1].collect()


def test_compact_queries(spark):
    hop = lambda r, d: (r, d, "town", "person")
    paths = spark.createDataFrame([("e", "k", [hop("mayor", "forward"), hop("boat", "backward"), hop("odd", "forward")])], "example_id string, kg string, hops array<struct<relation string, direction string, source_type string, target_type string>>")
    g = spark.createDataFrame([("k::mayor", "semantic", "x", "{subject} has mayor {object}"), ("k::odd", "opaque", "means", "{subject} {other}")], "relation_key string, status string, description string, fact_template string")
    r = evidence.compact_queries(paths, g).first()
    assert r["query"].split("\n") == [
        "Anchor: v0 = [ENTITY] (type: town)", "Required facts:", "F0: v0 (type: town) has mayor v1 (type: person)", "F1: ", "F2: v2 (type: town) -- means --> v3 (type: person)", "Return: v3 (type: person)",
    ]
    assert r["unusable"] == ["boat", "odd"]
    with pytest.raises(Exception, match="direction"):
        evidence.compact_queries(paths.withColumn("hops", F.array().cast(paths.schema["hops"].dataType)), g).collect()


def test_annotated_paths(spark):
    parse = "struct<TopicEntityMid string, TopicEntityName string, PotentialTopicEntityMention string, InferentialChain array<string>, Sparql string, AnnotatorComment struct<ParseQuality string>, Constraints array<string>, Time string, `Order` string, Answers array<struct<EntityName string>>>"
    sparql = "ns:m.1 ns:location.country.capital ?y .\n?x ns:people.person.born_in ?y ."
    chain = ["location.country.capital", "people.person.born_in"]
    base = {"a": "m.1", "b": "Land", "c": None, "d": chain, "e": sparql, "f": ("Complete",), "g": None, "h": None, "i": None, "j": [("Ann",), ("Bob",)]}
    row = lambda **k: tuple((base | k).values())
    parses = [row(), row(f=("Incomplete",)), row(g=["c"]), row(d=None), row(d=["x"] * 4), row(e="nothing"), row(b="", c="the land", j=None)]
    q = spark.createDataFrame([("W1", " who  was born ", parses), ("W2", "q", None)], f"QuestionId string, RawQuestion string, Parses array<{parse}>")
    types = spark.createDataFrame([("W1", "Ann", "Person"), ("W1", "Bob", "Artist"), ("W1", "Land", "Country"), ("W9", "Ann", "No")], "question_id string, node string, type string")
    got = {r["id"]: r for r in evidence.annotated_paths(q, types).collect()}
    assert set(got) == {"webqsp:W1:0", "webqsp:W1:6"}
    a = got["webqsp:W1:0"]
    assert (a["question"], a["anchor"], a["answer_type"]) == ("who was born", "Land", "Artist / Person")
    assert [tuple(h) for h in a["hops"]] == [("location.country.capital", "forward", "Country", "intermediate entity"), ("people.person.born_in", "backward", "intermediate entity", "Artist / Person")]
    b = got["webqsp:W1:6"]
    assert (b["anchor"], b["answer_type"], b["hops"][0]["source_type"]) == ("the land", "answer entity", "location country")


def test_glossary_and_benchmark_files(spark, tmp_path):
    assert files.read_glossary(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_glossary(spark, str(tmp_path / "none.json"))
    (tmp_path / "g.json").write_text('{"k::r": {"status": "semantic", "confidence": 0.5}}')
    assert files.read_glossary(spark, str(tmp_path / "g.json")).select("relation_key", "status", "confidence").collect() == [("k::r", "semantic", 0.5)]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(Exception, match="object"):
        files.read_glossary(spark, str(tmp_path / "l.json")).collect()
    for n, ids in (("a", ["e3", "e1"]), ("b", ["e2"])):
        (tmp_path / f"{n}.jsonl").write_text("\n".join(json.dumps({"example_id": i}) for i in ids))
    assert [r[0] for r in files.read_benchmark(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "example_id string").collect()] == ["e1", "e2", "e3"]
