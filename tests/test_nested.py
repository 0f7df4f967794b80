import json

from hopweave.operators import nested

EX = "example_id string, question string, positive_path struct<anchor string, anchor_type string, hops array<struct<relation string, direction string, source_type string, target_type string>>, answer_type string, kg string>, alternate_positive_paths array<struct<anchor string, anchor_type string, hops array<struct<relation string, direction string, source_type string, target_type string>>, answer_type string, kg string>>, negative_paths array<struct<anchor string, anchor_type string, hops array<struct<relation string, direction string, source_type string, target_type string>>, answer_type string, kg string, negative_type string, question string>>, split string, kg string, record_id string"


def h(r, d="forward"):
    return (r, d, None, None)


def p(hops, *more):
    return ("A", None, hops, "t", "k", *more)


ROWS = [
    ("e1", "q", p([h("a"), None, h("b")]), [None, p([h("a"), None, h("b")])], [p([h("c")], "wrong", None), p(None, "x", None)], "train", "k", "clash"),
    ("e1", "q", p([h("a"), None, h("b")]), [None, p([h("a"), None, h("b")])], [p([h("c")], "wrong", None), p(None, "x", None)], "train", "k", "clash"),
    ("e2", None, None, None, [], None, None, None),
    ("e3", "x" * 100_000, p([]), [], None, "dev", "k", None),
]


def found(t):
    return sorted(tuple(r) for r in nested.occurrences(t).select("record_id", "path_role", "path_index", "hop_index").distinct().collect())


def test_examples_with_nulls_repeats_and_clashing_column(spark):
    t = nested.flatten(nested.from_examples(spark.createDataFrame(ROWS, EX)))
    assert found(t) == [("e1", "alternate", 1, 0), ("e1", "alternate", 1, 2), ("e1", "negative", 0, 0), ("e1", "positive", 0, 0), ("e1", "positive", 0, 2)]
    assert t.records.count() == 3
    # the positive and the alternate path are one object with two occurrences
    same = [r[0] for r in t.record_paths.where("record_id = 'e1' and path_role <> 'negative'").select("path_hash").collect()]
    assert len(same) == 2 and len(set(same)) == 1
    assert t.hops.count() == 3
    assert t.record_paths.join(t.paths, "path_hash", "left_anti").count() == 0
    assert t.path_hops.join(t.hops, "hop_hash", "left_anti").count() == 0


def test_empty_table_and_missing_columns(spark):
    t = nested.flatten(nested.from_examples(spark.createDataFrame([], EX)))
    assert [x.count() for x in (t.records, t.paths, t.hops, t.record_paths, t.path_hops)] == [0] * 5
    t = nested.flatten(nested.from_examples(spark.createDataFrame([("e1",)], "example_id string")))
    assert t.records.count() == 1 and t.record_paths.count() == 0


def test_shapes_of_raw_lines(spark):
    hop = {"relation": "r", "direction": "forward"}
    lines = {
        "list": {"positive_path": {"anchor": "A", "hops": [hop, None, "s::backward"]}},
        "lone": {"positive_path": {"hops": hop}},
        "text": {"positive_path": {"hops": json.dumps([hop, hop])}},
        "path_text": {"positive_path": json.dumps({"hops": [hop]})},
        "wrapped": {"negative_paths": [None, {"path": {"hops": [hop]}, "negative_type": "n", "is_positive": False}]},
        "lone_path": {"negative_paths": {"hops": [hop]}, "alternate_positive_paths": None},
    }
    rows = [(k, json.dumps(v)) for k, v in lines.items()] + [("bad", '{"positive_path": {"hops": ['), ("null", None), ("empty", ""), ("number", "3"), ("nan", '{"positive_path": {"hops": [{"relation": NaN}]}}'), ("surrogate", '{"positive_path": {"hops": ["\\ud800::forward"]}}')]
    t = nested.flatten(nested.from_lines(spark.createDataFrame(rows, "raw_id string, line_text string")))
    assert found(t) == sorted(
        [("list", "positive", 0, 0), ("list", "positive", 0, 2), ("lone", "positive", 0, 0), ("text", "positive", 0, 0), ("text", "positive", 0, 1), ("path_text", "positive", 0, 0)]
        + [("wrapped", "negative", 1, 0), ("lone_path", "negative", 0, 0), ("surrogate", "positive", 0, 0)]
    )
    assert t.records.count() == len(rows)
    assert {(r["relation"], r["direction"]) for r in t.hops.collect()} >= {("s", "backward"), ("r", "forward")}
    extra = t.paths.where("negative_type = 'n'").first()["extra"]
    assert json.loads(extra) == {"is_positive": False}


def test_identity_tells_null_from_empty_and_order():
    import itertools

    assert nested.parse_line("i", '{"positive_path": {"hops": ["a::b::forward"]}}')["paths"][0]["hops"][0]["relation"] == "a"
    assert [*itertools.islice(nested.parse_line("i", "[]")["paths"], 3)] == []


def test_identities_differ(spark):
    rows = [("a", "", p([h("x")]), None, None, None, "k", None), ("b", None, p([h("x"), h("")]), None, None, None, "k", None), ("c", None, p([h("x"), h(None)]), None, None, None, "k", None), ("d", None, p([h(""), h("x")]), None, None, None, "k", None)]
    t = nested.flatten(nested.from_examples(spark.createDataFrame(rows, EX)))
    assert t.records.select("record_hash").distinct().count() == 4
    assert t.paths.count() == 4


def test_origins_stay_apart_and_equal_records_are_stored_once(spark):
    line = json.dumps({"question": "q", "split": "train", "kg": "k", "positive_path": {"anchor": "A", "hops": [{"relation": "a", "direction": "forward"}]}})
    both = nested.from_examples(spark.createDataFrame(ROWS, EX)).unionByName(nested.from_lines(spark.createDataFrame([("e1", line), ("x1", line), ("x2", line)], "raw_id string, line_text string")))
    t = nested.flatten(both)
    assert t.records.where("record_id = 'e1'").count() == 2 and t.record_paths.where("record_id = 'e1' and path_role = 'positive'").count() == 2
    assert t.record_objects.where("question = 'q'").count() == 2 and t.records.count() == 6
    assert t.object_paths.join(t.records.where("record_id = 'x2'"), "record_hash").count() == 1
    assert t.records.join(t.record_objects, "record_hash", "left_anti").count() == 0
