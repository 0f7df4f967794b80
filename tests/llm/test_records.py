import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hopweave.llm import fold, frequency, grouped_split, queries_records


def test_folds(spark):
    rows = [(" NS:Foo.Bar ", "ns:A::B :: Forward ", " Train_x", "Entity-Pages"), (None, None, None, None), ("", "", "", "")]
    df = spark.createDataFrame(rows, "r string, e string, s string, c string")
    got = df.select(fold.relation("r"), fold.element("e"), fold.side("s"), fold.source("c")).collect()
    assert tuple(got[0]) == ("foo.bar", "a::b::forward", "train", "entity_pages")
    assert tuple(got[1]) == (None, None, None, None)
    assert got[2][0] == "" and got[2][2] is None


def brute_counts(rows):
    seen, occ, rec = {(i, tuple(a or ())) for i, a in rows if i is not None}, Counter(), defaultdict(set)
    for i, a in seen:
        for t in a or []:
            if t is not None:
                occ[t] += 1
                rec[t].add(i)
    return {t: (n, len(rec[t])) for t, n in occ.items()}, len({i for i, _ in seen})


def test_term_counts_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"r{i}", [rnd.choice(["hot", "hot", f"t{rnd.randint(0, 60)}", "", None]) for _ in range(rnd.randint(0, 6))]) for i in range(300)]
    rows += rows[:40] + [("nulls", None), (None, ["lost"]), ("long", ["x" * 50_000])]
    rows += [("twice", ["first", "hot"]), ("twice", ["second", "hot"]), ("huge", [f"h{i % 50_000}" for i in range(100_000)])]
    df = spark.createDataFrame([(i, a, "clash") for i, a in rows], "id string, a array<string>, term string")
    counts, total = frequency.term_counts(df, "id", {"f": F.col("a")}, blocks=7, id_range=16)
    want, n = brute_counts(rows)
    got = counts.collect()
    assert total == n and {r["term"]: (r["occurrences"], r["records"]) for r in got} == want
    assert sorted(r["term_id"] for r in got) == list(range(len(want)))
    marks = {r["term"]: r["mark"] for r in frequency.marked(counts, total).collect()}
    assert marks["hot"] == "common" and marks["x" * 50_000] == "rare"


def test_term_counts_of_nothing(spark):
    counts, total = frequency.term_counts(spark.createDataFrame([], "id string, a array<string>"), "id", {"f": F.col("a")})
    assert total == 0 and counts.count() == 0


def brute_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randint(0, 60):02}", f"n{rnd.randint(0, 60):02}") for _ in range(45)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(20)] + [("hub", f"h{i}") for i in range(30)]
    got = {r["node"]: r["component"] for r in grouped_split.components(spark.createDataFrame(links + [(None, "n01"), ("n01", None)], "a string, b string")).collect()}
    assert got == {x: c for x, c in brute_components([x for x in links if x[0] != x[1]]).items()}


def test_hot_members_take_the_same_way(spark):
    links = [("a0", f"m{i:05}") for i in range(3000)] + [("m00000", "z1"), ("q1", "q2")]
    rounds = []
    got = grouped_split.components(spark.createDataFrame(links, "a string, b string"), hot_share=0.01, rounds=rounds)
    assert {r["component"]: r["count"] for r in got.groupBy("component").count().collect()} == {"a0": 3002, "q1": 2} and len(rounds) > 1


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test data")
def test_registered_groups_run_hash_to_min(spark):
    keyed = queries_records._keyed(spark, "/root/testdata/sf0.1")
    links = grouped_split.links_of(keyed, "example_id", F.array("key"), F.col("spelling"))
    rounds = []
    of = grouped_split.components(links, rounds=rounds)
    assert links.count() > 1000 and len(rounds) > 1
    # spellings of one group meet in its component
    assert of.groupBy("component").count().where("count > 2").count() > 10
    given = queries_records._assigned(spark, "/root/testdata/sf0.1").withColumnRenamed("record_id", "example_id")
    torn = keyed.where("key is not null").join(given, "example_id").groupBy("key").agg(F.countDistinct("new_split").alias("n")).where("n > 1")
    assert torn.count() == 0


def test_assignment_keeps_groups_and_shares_under_skew(spark):
    rows = [(f"r{i}", ["hot"] if i % 3 == 0 else [f"k{i % 200}"]) for i in range(3000)] + [("lone", None), ("empty", []), ("nulls", [None]), (None, ["k1"]), ("r0", ["hot"]), ("bridge", ["k1", "k2"])]
    df = spark.createDataFrame([(i, k, "clash") for i, k in rows], "id string, keys array<string>, component string")
    linked = grouped_split.with_components(df, "id", F.col("keys"))
    got = {r["record_id"]: (r["component"], r["new_split"]) for r in grouped_split.assign(linked, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    by = defaultdict(set)
    for i, keys in rows:
        for k in keys or []:
            if i and k:
                by[k].add(got[i][1])
    assert all(len(s) == 1 for s in by.values())
    assert by["k1"] == by["k2"]
    share = Counter(s for _, s in got.values())
    assert abs(share["train"] / len(got) - 0.8) < 0.02 and abs(share["dev"] / len(got) - 0.1) < 0.02


def test_assignment_of_nothing(spark):
    linked = grouped_split.with_components(spark.createDataFrame([], "id string, keys array<string>"), "id", F.col("keys"))
    assert grouped_split.assign(linked, {"train": 1.0}).count() == 0
