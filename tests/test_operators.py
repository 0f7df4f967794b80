import random
from collections import Counter, deque

from pyspark.sql import functions as F

from hopweave.functions import text
from hopweave.operators import audit, corpus, graph, organize, ranking, search, similarity

T = "question_id string, head string, relation string, tail string"


def random_graph(rnd, n=9, m=14):
    return [("q", f"n{rnd.randint(0, n)}", f"r{rnd.randint(0, 2)}", f"n{rnd.randint(0, n)}") for _ in range(m)]


def near(rows):
    out = {}
    for _, h, _, t in rows:
        out.setdefault(h, set()).add(t)
        out.setdefault(t, set()).add(h)
    return out


def bfs(adj, root):
    d, q = {root: 0}, deque([root])
    while q:
        x = q.popleft()
        for y in adj.get(x, ()):
            if y not in d:
                d[y] = d[x] + 1
                q.append(y)
    return d


def test_distances_and_components_against_brute_force(spark):
    rnd = random.Random(5)
    rows = random_graph(rnd) + [("q", None, "r0", "n1"), ("q", "n1", "r0", None)] + [("q", f"c{i}", "r0", f"c{i + 1}") for i in range(12)]
    adj = near(r for r in rows if None not in r)
    e = graph.edges(spark.createDataFrame(rows, T))
    roots = spark.createDataFrame([("q", "n1"), ("q", "c0"), ("q", "absent")], "question_id string, node string")
    got = {(r["root"], r["node"]): r["distance"] for r in graph.distances(e, roots).collect()}
    assert got == {(r, x): d for r in ("n1", "c0", "absent") for x, d in bfs(adj, r).items()}
    comp = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert comp == {x: min(bfs(adj, x)) for x in adj}


def test_long_chains(spark):
    rows = [("q", f"c{i:03}", "r0", f"c{i + 1:03}") for i in range(150)] + [("q", "lone", "r0", "lone"), ("p", "c000", "r0", "x")]
    e = graph.edges(spark.createDataFrame(rows, T))
    got = graph.distances(e, spark.createDataFrame([("q", "c000")], "question_id string, node string"))
    assert got.count() == 151 and got.agg(F.max("distance")).first()[0] == 150
    comp = {(r["question_id"], r["node"]): r["component"] for r in graph.components(e).collect()}
    assert comp["q", "c150"] == "c000" and comp["q", "lone"] == "lone" and comp["p", "x"] == "c000" and len(comp) == 154


def test_families_provenance_and_reduction(spark):
    rows = [("q", "book", "author", "a1"), ("q", "book", "author", "a2"), ("q", "a1", "born", "London"), ("q", "a2", "born", "Paris"), ("q", "book", "author", "a1"), ("q", "book", "same", "book")]
    e = graph.edges(spark.createDataFrame(rows, T))
    anchors = spark.createDataFrame([("q", "book")], "question_id string, node string")
    f = {tuple(r["sequence"]): r["answers"] for r in graph.path_families(e, anchors).collect()}
    assert f == {("author::forward",): ["a1", "a2"], ("author::forward", "born::forward"): ["London", "Paris"]}
    p = spark.createDataFrame([("q", "1", "book", ["author::forward", "born::forward"]), ("q", "2", "book", ["same::forward", "author::forward"]), ("q", "3", "book", ["none::forward", "born::forward"])], "question_id string, path_id string, anchor string, sequence array<string>")
    m = {r["path_id"]: r for r in graph.materialize_paths(e, p).collect()}
    assert m["1"]["answers"] == ["London", "Paris"] and "a2\tborn\tParis" in m["1"]["facts"] and len(m["1"]["facts"]) == 4
    assert m["3"]["answers"] == []
    r = {x["path_id"]: x["reduced"] for x in graph.strict_reduce(e, p).collect()}
    assert r == {"1": ["author::forward", "born::forward"], "2": ["author::forward"], "3": ["none::forward", "born::forward"]}


def test_dominant_type(spark):
    rows = [("tie", "City", 1), ("tie", "Person", 1), ("most", "City", 3), ("most", "Person", 1), ("hint", "US President", 2), ("hint", "Artwork", 2)]
    df = spark.createDataFrame(rows, "k string, type string, n long").withColumn("h", F.when(F.col("k") == "hint", "us president"))
    got = {r["k"]: r["type"] for r in graph.dominant_type(df, ["k"], F.col("h")).collect()}
    assert got == {"tie": "entity", "most": "City", "hint": "US President"}


def test_symmetry(spark):
    rows = [("q", f"a{i}", "spouse", f"b{i}") for i in range(10)] + [("q", f"b{i}", "spouse", f"a{i}") for i in range(9)] + [("q", "x", "few", "y"), ("q", "y", "few", "x")]
    got = [tuple(r) for r in graph.symmetric_relations(spark.createDataFrame(rows, T)).collect()]
    assert got == [("spouse", 19, 18 / 19)]


def test_branches(spark):
    rows = [("q", "r1", "x", "a"), ("q", "r2", "x", "b"), ("q", "a", "x", "m"), ("q", "b", "x", "m"), ("q", "m", "x", "z"), ("q", "u", "x", "v")]
    e = graph.edges(spark.createDataFrame(rows, T))
    roots = spark.createDataFrame([("q", "r1"), ("q", "r2")], "question_id string, node string")
    got = {(r["src"], r["dst"]): r["branch"] for r in graph.assign_branches(e, roots).collect()}
    assert got == {("r1", "a"): "r1", ("r2", "b"): "r2", ("a", "m"): "r1", ("b", "m"): "r2", ("m", "z"): "connecting", ("u", "v"): "other"}


C = "k string, i int, pos boolean, score double, kind string, answers array<string>"


def test_ranking_metrics_with_ties(spark):
    rows = [("tie", 0, True, 1.0, "p", None), ("tie", 1, False, 1.0, "n", None), ("multi", 0, True, 0.1, "p", None), ("multi", 1, True, 0.9, "p", None), ("multi", 2, False, 0.8, "n", None), ("none", 0, False, 0.5, "n", None), ("null", 0, None, None, None, None)]
    m = ranking.ranking_metrics(spark.createDataFrame(rows, C), ["k"], "score", "pos").first()
    assert (m["examples"], m["recall_at_1"], m["strict_recall_at_1"], m["top_tie_rate"], m["pairwise_accuracy"]) == (2, 0.75, 0.5, 0.5, 0.5)
    assert abs(m["mrr"] - (1 / 1.5 + 1) / 2) < 1e-12
    e = ranking.ranking_metrics(spark.createDataFrame([], C), ["k"], "score", "pos").first()
    assert e["examples"] == 0 and e["mrr"] == 0.0


def test_argmax_fallback_and_margin(spark):
    rows = [("a", 0, None, 5.0, "", ["m.04gdzf4"]), ("a", 1, None, 2.0, "", ["Paris"]), ("a", 2, None, 1.9, "", ["Rome"]), ("b", 0, None, 1.0, "", ["m.1"]), ("b", 1, None, 1.0, "", []), ("c", 0, None, None, "", ["x"])]
    got = {r["k"]: (r["i"], r["fallback"], round(r["margin"], 6)) for r in ranking.argmax(spark.createDataFrame(rows, C), ["k"], F.col("score"), "i", "answers").collect()}
    assert got == {"a": (1, False, 0.1), "b": (0, True, 0.0), "c": (0, False, 0.0)}


def test_round_robin_and_samples(spark):
    rows = [(f"r{i}", i, None, 0.0, "big" if i < 20 else "small", None) for i in range(23)]
    got = [(r["place"], r["kind"]) for r in ranking.round_robin(spark.createDataFrame(rows, C), ["kind"], [F.col("i")], 9).orderBy("place").collect()]
    assert Counter(k for _, k in got) == {"big": 6, "small": 3} and [p for p, _ in got] == list(range(1, 10))
    pool = [("g", i, i == 0, float(i), "n", None) for i in range(30)] + [("no", 0, False, 1.0, "n", None)]
    s = ranking.sample_candidates(spark.createDataFrame(pool, C), ["k"], "score", "pos", "i", hard=3, other=2, positives=1).collect()
    assert Counter(r["role"] for r in s) == {"positive": 1, "hard": 3, "random": 2} and {r["i"] for r in s if r["role"] == "hard"} == {29, 28, 27} and {r["k"] for r in s} == {"g"}


G = "question_id string, question string, topic_entities array<string>, triples array<struct<head string, relation string, tail string>>"


def test_search_skips_identity_and_keeps_budget(spark):
    t = [("city", "located.in", "country"), ("city", "same.as", "city"), ("country", "has.capital", "town")]
    run = lambda q, topics, triples, **k: search.search_programs(spark.createDataFrame([("i", q, topics, triples)], G), **k).first()
    r = run("which country is the city located in?", ["city"], t)
    assert r["answers"] == ["country"] and "same.as" not in " ".join(r["atoms"])
    many = [(f"n{i}", f"rel.r{j}", f"n{(i + j) % 7}") for i in range(7) for j in range(1, 4)]
    assert run("rel", ["n0"], many, cap=5)["scored"] <= 5
    assert run("q", ["n0"], [])["atoms"] is None


def test_search_conditions_and_scorer(spark):
    t = [("book", "written.author", "ann"), ("book", "written.author", "bob"), ("ann", "person.city", "oslo"), ("bob", "person.city", "rome")]
    g = spark.createDataFrame([("i", "which author of the book has city", ["book", "oslo"], t)], G)
    both = lambda x: x.count("-->") == 2 and "ANCHOR_1 --[written author]--> ?x" in x and "?x --[person city]--> ANCHOR_2" in x
    r = search.search_programs(g, scorer=lambda q, texts: [(10.0 if "[FINISH]" in x else 5.0) if both(x) else 1.0 for x in texts]).first()
    assert r["answers"] == ["ann"] and r["finished"] and sorted(r["atoms"]) == ["?x person.city oslo", "book written.author ?x"]
    longest = search.search_programs(g, scorer=lambda q, texts: [float(len(x) * ("FINISH" not in x)) for x in texts], max_hops=3).first()
    assert len(longest["atoms"]) == 3 and longest["rounds"] == 3 and not longest["finished"]


def test_search_rows_with_nulls(spark):
    schema = "question_id string, question string, topic_entities array<string>, triples array<struct<head string, relation string, tail string>>, extra string"
    rows = [("a", None, ["x"], [("x", "r", "y"), None, ("x", None, "y")], "e"), ("b", "q", None, None, "e"), ("c", "q", [None], [], "e")]
    got = {r["question_id"]: r["answers"] for r in search.search_programs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ["y"], "b": [], "c": []}


P = "example_id string, path struct<anchor string, anchor_type string, hops array<struct<relation string, direction string, source_type string, target_type string>>, answer_type string, kg string>"


def test_corruptions(spark):
    path = ("B", "book", [("author", "forward", "book", "person"), ("born", "forward", "person", "place")], "place", "k")
    df = spark.createDataFrame([("e", path), ("none", None), ("empty", ("B", "b", [], "p", "k"))], P)
    inv = spark.createDataFrame([("person", "author"), ("person", "editor"), ("place", "born"), ("place", "died"), ("thing", "x"), (None, "y")], "target_type string, relation string")
    got = {r["negative_type"]: r for r in corpus.corruptions(df, inv).collect()}
    assert set(got) == {"wrong_direction", "wrong_relation", "wrong_order", "missing_hop", "wrong_answer_type"}
    assert [h["relation"] for h in got["wrong_order"]["hops"]] == ["born", "author"] and got["wrong_order"]["hops"][1]["source_type"] == "place"
    assert len(got["missing_hop"]["hops"]) == 1 and got["missing_hop"]["hops"][0]["source_type"] == "book"
    assert got["wrong_answer_type"]["answer_type"] in ("person", "thing")


def test_splits_and_slices(spark):
    rows = [(f"e{i}", ("a", "t", [(f"r{i % 10}", "forward", "s", "t")], "t", "k")) for i in range(100)]
    df = spark.createDataFrame(rows, P)
    held = corpus.heldout_relations(df.select(F.explode("path.hops").alias("h")).select("h.relation"))
    split = {r["example_id"]: r["new_split"] for r in corpus.assign_splits(df, held).collect()}
    out = {r["relation"] for r in held.collect()}
    assert out and all((split[f"e{i}"] == "test_unseen_relation") == (f"r{i % 10}" in out) for i in range(100))
    train = spark.createDataFrame([("t", ["a", "b"]), ("u", ["c"])], "example_id string, sequence array<string>")
    ev = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "c"]), ("3", ["z"])], "example_id string, sequence array<string>")
    got = {r[0]: (r[1], r[2]) for r in corpus.generalization(train, ev).collect()}
    assert got == {"1": (False, False), "2": (False, True), "3": (True, False)}


LINES = ["(a,x.y,b)", "(b,x.y,c, d)", "(z,x.y,w)", "(a,x.y,b)"]


def queue_order(question, lines):
    """Brute force: components, their roots, and a queue."""
    triples = [(x[1:-1].split(",")[0], ",".join(x[1:-1].split(",")[2:])) for x in lines]
    adj = {}
    for h, t in triples:
        adj.setdefault(h, set()).add(t)
        adj.setdefault(t, set()).add(h)
    seen, parts = set(), []
    for n in sorted(adj):
        if n not in seen:
            part = set(bfs(adj, n))
            seen |= part
            own = [i for i, (h, _) in enumerate(triples) if h in part]
            named = organize.mentioned(question, sorted(part))
            at = {e: [i for i in own if e in triples[i]] for e in part}
            parts.append(((not named, -len(own), own[0]), named or [min(part, key=lambda e: (-len(at[e]), at[e][0], e))], at))
    out = []
    for _, roots, at in sorted(parts, key=lambda p: p[0]):
        queue, met, used = deque(roots), set(roots), set()
        while queue:
            e = queue.popleft()
            mine = [i for i in at[e] if i not in used]
            used |= set(mine)
            for i in mine:
                o = triples[i][1] if triples[i][0] == e else triples[i][0]
                if o not in met:
                    met.add(o)
                    queue.append(o)
            out += ([f"[{e}]"] if mine else []) + [lines[i] for i in mine]
    return out


def test_organizer_against_a_queue(spark):
    rnd = random.Random(11)
    rows = [("1", "what of b?", LINES), ("2", None, []), ("3", "q", None)]
    for k in range(12):
        names = ["ann", "bob lee", "bob", "cat", "dan", "eve fox", "gil", "hal"]
        rows.append((f"r{k}", rnd.choice(["who knows bob lee and cat?", "what of dan?", None]), [f"({rnd.choice(names)},x.r{rnd.randint(0, 2)},{rnd.choice(names)})" for _ in range(rnd.randint(1, 14))]))
    prompts = spark.createDataFrame(rows, "id string, question string, lines array<string>")
    got = {arm: {r["id"]: r["lines"] for r in organize.organize(prompts, arm).collect()} for arm in organize.ARMS}
    for i, q, lines in rows:
        want = queue_order(q, lines or [])
        assert got["structured"][i] == want
        assert got["reorder"][i] == [x for x in want if not x.startswith("[")]
    back = organize.decode_adjacency(organize.organize(prompts, "adjacency"))
    again = Counter((r["id"], f"({r['head']},{r['relation']},{r['tail']})") for r in back.collect())
    assert again == Counter((i, x) for i, _, lines in rows for x in lines or [])


def test_mentions():
    assert organize.mentioned("the Bob Lee and bob", ["bob", "bob lee", "BOB LEE ", "x"]) == ["BOB LEE ", "bob"]
    assert organize.mentioned(None, ["a"]) == [] and organize.mentioned("a b", ["a"]) == []


def test_prompt_lines(spark):
    line = spark.createDataFrame([("(b,x.y,c, d)",), ("(a,b,c)",), ("a,b,c",), ("(a,b)",), (None,)], "l string").select(organize.parse_triple(F.col("l")).alias("t")).collect()
    assert [r["t"] and tuple(r["t"]) for r in line] == [("b", "x.y", "c, d"), ("a", "b", "c"), None, None, None]
    prompt = "Do.\n\nTriplets:\n(a,x.y,b)\n(c,x.y,d)\n\nQuestion:\nwhich?"
    df = spark.createDataFrame([(prompt,)], "p string")
    assert df.select(organize.evidence_lines(F.col("p")).alias("e")).first()["e"] == ["(a,x.y,b)", "(c,x.y,d)"]
    assert df.select(organize.replace_evidence(F.col("p"), F.array(F.lit("(n)"))).alias("e")).first()["e"] == "Do.\n\nTriplets:\n(n)\n\nQuestion:\nwhich?"


def test_failure_classes(spark):
    schema = "status string, exact boolean, ref array<string>, sel array<string>, prop array<string>, beam boolean, has boolean, same boolean, want string"
    rows = [
        ("partial", False, ["a"], ["a"], ["a"], False, True, False, "evidence_absent"),
        ("exact", True, ["a"], [], [], False, False, False, "correct_answer"),
        ("exact", False, ["a", "b"], ["a"], ["a"], False, True, False, "fragment_never_proposed"),
        ("exact", None, ["a"], ["b"], ["a", "b"], True, True, False, "ranked_below"),
        ("exact", False, ["a", "b"], ["a"], ["a", "b"], False, True, False, "silent_incompleteness"),
        ("exact", False, ["a"], ["a"], ["a"], None, False, True, "execution_normalization"),
        ("exact", False, ["a"], ["b"], ["a", "b"], False, True, None, "fragment_pruned"),
        (None, None, None, None, None, None, None, None, "evidence_absent"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = df.select("want", audit.classify(*[F.col(c) for c in ("status", "exact", "ref", "sel", "prop", "beam", "has", "same")]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_canonical_programs():
    a = audit.canonical("?x", [("m.1", "r", "?x"), ("?x", "s", "?y")])
    assert a == audit.canonical("?b", [("?b", "s", "?a"), ("m.1", "r", "?b")])
    assert a != audit.canonical("?x", [("?x", "r", "m.1"), ("?x", "s", "?y")])
    assert audit.canonical("?x", None) is None
    assert audit.canonical("?0", [(f"?{i}", "r", f"?{i + 1}") for i in range(9)]) is None


def test_walks_are_simple(spark):
    e = graph.edges(spark.createDataFrame(random_graph(random.Random(9), 6, 20), T))
    anchors = spark.createDataFrame([("q", f"n{i}") for i in range(7)], "question_id string, node string")
    for r in corpus.random_walks(e, anchors, 3).collect():
        assert len(set(r["nodes"])) == 4 == len(r["sequence"]) + 1
    assert text.METADATA_PATTERNS


def test_nearest_against_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=5)], "clash") for i in range(60)] + [(60, None, ""), (61, [], ""), (62, [0.0] * 5, ""), (63, [1.0, None, 1.0, 1.0, 1.0], "")]
    rows += [(70, rows[3][1], "")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, cosine string")
    q = df.where("id % 10 = 0")
    v = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows if i < 60 or i == 70}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    want = {(i, k + 1): j for i in v if i % 10 == 0 for k, (_, j) in enumerate(sorted((-cos(v[i], v[j]), j) for j in v if j != i)[:4])}
    for size in (50_000, 7):
        got = similarity.cosine_topk(df, q, 4, part_rows=size, block_queries=3).collect()
        assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    assert similarity.cosine_topk(df.limit(0), q, 4).count() == 0 == similarity.cosine_topk(df, q.limit(0), 4).count()


def test_fractional_ranks_share_near_ties(spark):
    rows = [("g", 1.0), ("g", 1.0 - 5e-13), ("g", 0.5), ("g", 0.5), ("g", 0.5 - 1e-9), ("g", None), ("g", None), ("h", 2.0)]
    got = sorted((r["k"], r["rank"]) for r in ranking.fractional_ranks(spark.createDataFrame(rows, "k string, s double"), ["k"], "s").collect())
    assert got == [("g", 1.5), ("g", 1.5), ("g", 3.5), ("g", 3.5), ("g", 5.0), ("g", 6.5), ("g", 6.5), ("h", 1.0)]
