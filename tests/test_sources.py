import json

import pytest

from hopweave.sources import files
from hopweave.streaming import resume


def put(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_json_lines_and_documents(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", [{"id": "1", "n": 2}, "", {"id": "2"}])
    assert [tuple(r) for r in files.read_jsonl(spark, p, "id string, n int").orderBy("id").collect()] == [("1", 2), ("2", None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id string", missing_ok=True).count() == 0
    q = put(tmp_path / "d.json", [json.dumps([{"ID": "a", "v": 1}, {"ID": "a", "v": 2}, {"ID": "b", "v": 3}])])
    assert sorted(tuple(r) for r in files.read_keyed_document(spark, q, None, "ID", "struct<ID string, v int>").collect()) == [("a", 2), ("b", 3)]
    w = put(tmp_path / "w.json", [json.dumps({"Questions": [{"QuestionId": "q"}]}, indent=1)])
    assert files.read_keyed_document(spark, w, "Questions", "QuestionId", "struct<QuestionId string>").count() == 1


def test_coded_graphs(spark, tmp_path):
    e = files.read_names(spark, put(tmp_path / "e.txt", ["m.0", "m.1", "m.2"]))
    r = files.read_names(spark, put(tmp_path / "r.txt", ["born", "lives"]))
    rows = files.read_jsonl(spark, put(tmp_path / "g.jsonl", [{"id": "q", "question": "?", "entities": [2, 0], "answers": [{"kb_id": "m.1"}], "subgraph": {"tuples": [[0, 1, 2], [2, 0, 1]]}}, {"id": "empty", "question": None, "entities": [], "answers": [], "subgraph": {"tuples": []}}]), "id string, question string, entities array<long>, answers array<struct<kb_id string>>, subgraph struct<tuples array<array<long>>>")
    got = {x["question_id"]: x for x in files.decode_graphs(rows, e, r).collect()}
    assert [tuple(t) for t in got["q"]["triples"]] == [("m.0", "lives", "m.2"), ("m.2", "born", "m.1")] and got["q"]["topic_entities"] == ["m.2", "m.0"]
    assert got["empty"]["triples"] == [] and got["empty"]["topic_entities"] == []


def test_knowledge_base(spark):
    e = spark.createDataFrame([("e1", "A", ["c1", "c2"], [("knows", "e2", "forward"), ("made", "e2", "backward"), ("lost", "e9", "forward")]), ("e2", "B", ["c1"], [("made", "e1", "forward")])], "id string, name string, instance_of array<string>, relations array<struct<predicate string, object string, direction string>>")
    c = spark.createDataFrame([("c1", "person"), ("c2", "artist")], "id string, name string")
    t, labels, types = files.knowledge_base(e, c)
    assert sorted(tuple(r) for r in t.collect()) == [("e1", "knows", "e2"), ("e2", "made", "e1")]
    assert {r["node"]: r["type"] for r in types.collect()} == {"e1": "artist / person", "e2": "person"} and labels.count() == 4


def test_results_keep_last_and_tell_bad_lines(spark):
    rows = [("f1", 0, '{"custom_id": "a", "v": 1}'), ("f2", 0, '{"custom_id": "a", "v": 2}'), ("f2", 1, "{broken"), ("f2", 2, '{"v": 3}'), ("f2", 3, None)]
    good, bad = files.parse_results(spark.createDataFrame(rows, "file string, line_no long, value string"), "custom_id string, v int")
    assert [tuple(r) for r in good.collect()] == [("a", 2)] and bad.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", 1.5), ("b|c", None)], "k string, v double")
    assert files.write_jsonl(df, str(tmp_path / "out")) == 2
    assert "| é | 1.5 |" in files.markdown_table(df) and "b\\|c" in files.markdown_table(df)
    files.write_document(df.limit(1), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8"))["v"] == 1.5
    with pytest.raises(ValueError, match="one row"):
        files.write_document(df, str(tmp_path / "m.json"))
    chunks = files.pack_chunks(spark.createDataFrame([(i, n) for i, n in enumerate([4, 5, 3, 9, 1])], "i int, n int"), "n", "i", 9)
    assert [r["chunk"] for r in chunks.orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_resume_batch_and_stream(spark, tmp_path):
    out, src = str(tmp_path / "out"), tmp_path / "in"
    src.mkdir()
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "id string, v string")
    same = lambda x: x
    assert resume.append(df, same, out) == 2 and resume.append(df, same, out) == 0
    put(src / "x.jsonl", [{"id": "b", "v": "2"}, {"id": "c", "v": "3"}])
    for k in range(2):
        resume.follow(spark, str(src), "id string, v string", same, out, str(tmp_path / "cp")).awaitTermination()
        if k == 0:
            put(src / "y.jsonl", [{"id": "c", "v": "3"}, {"id": "d", "v": "4"}])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_chunks_over_parts_are_those_of_one_sequence(spark):
    import random

    rnd = random.Random(9)
    for cap, sizes in ((10, [rnd.choice([0, 0, 1, 2, 3, 7, 15]) for _ in range(300)]), (25, [rnd.randint(1, 9) for _ in range(200)]), (5, [0, 0, 9, 0, 9, 0]), (1000, [1] * 50)):
        rows = [(i, n, "clash") for i, n in enumerate(sizes)]
        got = files.pack_chunks(spark.createDataFrame(rows, "i long, n long, _c string"), "n", "i", cap)
        assert [r["chunk"] for r in got.orderBy("i").collect()] == files._fill(sizes, cap, 0, 0)[0]
    assert files.pack_chunks(spark.createDataFrame([], "i long, n long"), "n", "i", 5).count() == 0
    for _ in range(300):
        sizes, cap = [rnd.choice([0, 1, 2, 5, 12]) for _ in range(rnd.randint(1, 9))], rnd.randint(1, 12)
        ways = files._ways_through(sizes, cap)
        for used in range(0, 2 * cap):
            _, chunk, after = files._fill(sizes, cap, 0, used)
            w = next(x for x in ways if x[0] == 0) if used == 0 else max(x for x in ways if x[0] != 0 and x[0] <= used)
            assert (w[1], w[2] + used if w[0] == -1 else w[2]) == (chunk, after)
