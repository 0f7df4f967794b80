import os
import random

import pytest
from pyspark.sql import functions as F

from hopweave.llm import defects, leaks, mixing, normal, queries_text, splitting, tokens

WORDS = [f"word{i}" for i in range(400)]


def prose(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def test_plain_words():
    assert normal.words("CafÃ© <b>the</b> Groory-\n> fane it’s &nbsp;R&#233;né ​x [by](#n) thе １５") == ["cafe", "the", "grooryfane", "its", "rene", "x", "by", "the", "15"]
    assert normal.words("AT THE&NBSP;CLOSE OF &#205;LVO &Nbsp; R&EACUTE;N &nosuch;") == ["at", "the", "close", "of", "ilvo", "ren", "nosuch"]
    long = "u" * 5000
    assert normal.words(f'a <img src="{long}" alt=\'x > y\'/>b [c {long}](http://{long}) <p class="{long}">d</p> 1 <2 e > 3') == ["a", "b", "c", long, "d", "1", "2", "e", "3"]
    assert normal.words(None) == [] == normal.words("  … ")


def test_winnowing_guarantee():
    import numpy as np

    rnd = random.Random(0)
    for _ in range(200):
        shared = prose(rnd, leaks.K + leaks.WINDOW - 1)
        a, b = (prose(rnd, rnd.randint(0, 20)) + shared + prose(rnd, rnd.randint(0, 20)) for _ in range(2))
        kept = []
        for t in (a, b):
            g = leaks.grams(np.array([leaks.word_hash(w) for w in t], np.uint64))
            kept.append(set(g[leaks.winnow(g)].tolist()))
        assert kept[0] & kept[1]


def leak_rows(rnd):
    items = [(i, " ".join(prose(rnd, 60))) for i in range(12)]
    docs, want = [], set()
    for d in range(60):
        body, kind = prose(rnd, 120), d % 6
        item = items[d % 12]
        w = item[1].split()
        if kind == 0:
            part = w[10:40]
        elif kind == 1:  # two of 24 words altered
            part = w[5:29]
            part[8] = part[17] = "altered"
        elif kind == 2:  # too short
            part = w[20:34]
        elif kind == 3:  # a third altered
            part = ["altered" if i % 3 == 0 else x for i, x in enumerate(w[:45])]
        elif kind == 4:
            part = [x.upper() + "," for x in w[20:50]]
        else:
            part = []
        if kind in (0, 1, 4):
            want.add((d, item[0]))
        docs.append((d, " ".join(body[:50] + part + body[50:]), "clash"))
    return docs, items, want


def test_leaks_in_one_shard_and_in_many(spark):
    docs, items, want = leak_rows(random.Random(4))
    extra = [(900, None, "x"), (901, "", "x"), (902, "short", "x"), (0, docs[0][1], "clash"), (903, "noise " * 30_000 + items[3][1], "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    for bound in (leaks.SHARD_FINGERPRINTS, 300):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, i, shard_fingerprints=bound).collect()}
        assert got == want | {(903, 3)}
    assert leaks.find_leaks(d.limit(0), i).count() == 0
    assert leaks.find_leaks(d, i.limit(0)).count() == 0


def test_leaks_with_a_gram_in_every_text(spark):
    rnd = random.Random(8)
    boiler = " all rights reserved by the owner of this page "
    items = [(n, boiler + " ".join(prose(rnd, 24))) for n in range(60)]
    items += [(100, items[0][1].upper())]  # equal words under another id
    docs = [(n, boiler + " ".join(prose(rnd, 30)) + boiler) for n in range(300)] + [(1000, boiler + items[0][1] + boiler)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (leaks.SHARD_FINGERPRINTS, 200):
        assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, i, shard_fingerprints=bound).collect()} == {(1000, 0), (1000, 100)}


def test_split_text_properties():
    rnd = random.Random(2)
    e = tokens.encoder()
    texts = [
        "# A\n\n" + "\n\n".join(" ".join(prose(rnd, 30)) + "." for _ in range(60)) + "\n\n## B\n\n" + "\n".join("- " + " ".join(prose(rnd, 8)) for _ in range(200)),
        " ".join(prose(rnd, 3000)),
        "".join(rnd.choice("abcdefghij") for _ in range(20_000)),
        "é世界" * 3000,
        "\n" * 9000 + "x" * 9000,
    ]
    for t in texts:
        for limit, overlap in ((500, 50), (200, 0)):
            p = splitting.split_text(t, limit, overlap)
            assert p[0][0] == 0 and p[-1][1] == len(t) and p[-1][3] == "end"
            assert all(n <= limit and n == len(e.encode_ordinary(t[a:b])) for a, b, n, _ in p)
            for x, y in zip(p, p[1:], strict=False):
                assert x[0] < y[0] <= x[1] < y[1]
                if not overlap:
                    assert y[0] == x[1]
    sections = splitting.split_text(texts[0], 500, 50)
    assert {k for *_, k in sections} <= {"section", "block", "item", "line", "end"}
    shared = [len(e.encode_ordinary(texts[0][b[0] : a[1]])) for a, b in zip(sections, sections[1:], strict=False)]
    assert all(20 <= n <= 80 for n in shared)
    assert splitting.split_text(None) == [] == splitting.split_text("") == splitting.split_text("short")


def test_tree_of_fences_lists_and_markup():
    text = "Title\n=====\n\nintro\n\n```py\n# no heading\n\n- no item\n```\nafter\n\n- one\n  - deep\n\n    still deep\n- two\n\n" + "x" * 300 + "\n---\n\n<h2>H</h2><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>end</p>"
    places, ranks = splitting.boundaries(text)
    at = {text[p : p + 12].split("\n")[0]: int(r) for p, r in zip(places, ranks, strict=True)}
    assert at["Title"] == 1 and at["intro"] == splitting.BLOCK and at["```py"] == splitting.BLOCK and at["after"] == splitting.BLOCK
    assert at["# no heading"] == at["- no item"] == splitting.LINE
    assert at["- one"] == splitting.BLOCK and at["  - deep"] == splitting.ITEM + 1 and at["    still de"] == splitting.ITEM + 2 and at["- two"] == splitting.ITEM
    assert at["x" * 12] == 2 and at["<h2>H</h2><u"] == 2 and at["<li>c</li></"] == splitting.ITEM + 1 and at["<p>end</p>"] == splitting.BLOCK


def test_fences_and_nested_items_stay_whole():
    rnd = random.Random(6)
    line = lambda n: " ".join(prose(rnd, n))
    fence = "```\n" + "\n\n".join("# " + line(6) for _ in range(12)) + "\n```"
    item = lambda: "- " + line(9) + "\n" + "\n".join("  - " + line(9) for _ in range(3))
    text = "\n\n".join(["# One", line(60), fence, line(60), "\n".join(item() for _ in range(30)), fence, line(90)])
    pieces = splitting.split_text(text, 420, 0)
    assert "".join(text[a:b] for a, b, *_ in pieces) == text
    for a, b, *_ in pieces[:-1]:
        assert text[a:b].count("```") % 2 == 0 and not text[b:].startswith("  - ")


def test_split_oversized_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 5000, 0), (4, "x", 0), (3, "word " * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = splitting.split_oversized(df).collect()
    assert {r["doc_id"] for r in got} == {3} and len(got) % 2 == 0
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_mixing_shares_caps_and_skew(spark):
    rnd = random.Random(5)
    docs = [(i, "a" if i % 3 else "b", rnd.randint(1, 50)) for i in range(2000)] + [(5000 + i, "small", 10) for i in range(10)] + [(9000, None, 100), (9001, "other", 70), (9002, "a", 0), (9003, "a", None)]
    sized = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, source string, n_tokens long, budget string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 4), ("small", 0.1, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(sized, targets)
    total = sum(n or 0 for *_, n in docs)
    by = {r["source"]: r for r in shares.collect()}
    assert set(by) == {"a", "b", "small", "absent"}
    rows = taken.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for s, (share, cap) in {"a": (0.3, 1), "b": (0.5, 4)}.items():
        mine = [r for r in rows if r["source"] == s]
        assert max(r["copies"] for r in mine) <= cap
        assert abs(sum(r["copies"] * r["n_tokens"] for r in mine) - share * total) <= 3 == 3
        assert abs(by[s]["actual_share"] - share) < 1e-3
        assert abs(by[s]["gap_tokens"]) <= 25 and abs(by[s]["gap_tokens"] - (by[s]["target_tokens"] - by[s]["actual_tokens"])) < 1e-6
    twice, _ = mixing.mix(sized.unionByName(sized), targets)  # rows of one id are several documents
    assert abs(twice.where("source = 'b'").agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] - 0.5 * 2 * total) <= 25
    assert {r["copies"] for r in rows if r["source"] == "small"} == {3} and by["small"]["actual_tokens"] == 300
    assert by["absent"]["actual_tokens"] == 0 and by["absent"]["documents"] == 0
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(sized.repartition(3), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_mixing_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(sized, targets)
    assert taken.count() == 0 and shares.first()["actual_tokens"] == 0


def test_token_counts(spark):
    rows = [(1, "hello world", "k"), (2, None, "k"), (3, "", "k"), (4, "<|endoftext|>", "k")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 7}


PROMPT = 'Starting at [ENTITY], which person results when you follow "home harbor" forward to a harbor, then follow "mentor" forward to a person?'


@pytest.mark.parametrize(
    ("response", "defect"),
    [
        (None, "empty"),
        ("", "empty"),
        ("​ \n", "empty"),
        ("(none)", "empty"),
        ("N/A.", "empty"),
        (PROMPT, "copy"),
        ("Sure! " + PROMPT.upper(), "copy"),
        (PROMPT.replace("person results", "person").replace('"', ""), "copy"),
        ("I'm sorry, but I can't help with that.", "refusal"),
        ("As an AI system, I must decline to answer.", "refusal"),
        ("Request declined.", "refusal"),
        ("Wie heißt der Hafenmeister von [ENTITY]?", "other_language"),
        ("¿Quién fundó [ENTITY]?", "other_language"),
        ("[ENTITY]の港長は誰ですか", "other_language"),
        ("Как называется школа [ENTITY]?", "other_language"),
        ("Who is the mentor of the home harbor of [ENTITY]?", None),
        ("Who is the mentor of [ENTITY]", None),
        ('Which harbor is the harbor of [ENTITY] once called "Der alte Hafen"?', None),
        ('Which harbor is [ENTITY] whose clerk wrote "I cannot sign"?', None),
        ("Can you name the harbor of Tamagvik Jorondran that refused the charter?", None),
    ],
)
def test_defects_seen_alone(response, defect):
    assert defects.look(PROMPT, response)[0] == defect


def test_truncation_needs_all_responses(spark):
    full = [f"What is the name of the {a} of {b}?" for a in ("home harbor", "main mentor", "old school") for b in ("[ENTITY]", "[ENTITY] founded in 1600 by Tamagvik Jorondran")]
    cut = ["What is the name of the home har", "What is the name of the main mentor of", "Who is the…", 'What is the name of the "old', "What is the name of the old school of [ENTITY] founded in", '{"question": "What is the']
    fine = ["What is the name of the home harbor of [ENTITY]", "What is the name of the old school of [ENTITY] founded in 1777 by Yareribek Groerinor"]
    rows = [("t", i, PROMPT, r) for i, r in enumerate(full + cut + fine + [None])]
    pairs = spark.createDataFrame(rows + rows[:3], "table_name string, row_key long, prompt string, response string")
    got = {r["row_key"]: r["defect"] for r in defects.find_defects(pairs).collect()}
    want = {len(full) + i: "truncated" for i in range(len(cut))} | {len(rows) - 1: "empty"}
    assert got == want
    assert defects.find_defects(pairs.limit(0)).count() == 0


def test_neighbours_across_partitions(spark):
    forms = [f"{c}{'x' * n}" for c in "abcdefghijkl" for n in range(1, 4)] + ["z", "z y"]
    df = spark.createDataFrame([(t, t == "z", t != "bx") for t in forms] + [(None, True, True)], "form string, finished boolean, opened boolean")
    got = {(r["form"], r["finished"], r["goes_on"]) for r in defects.neighbours(df).collect()}
    assert got == {(t, t == "z", " " if t == "z" else "x" if len(t) < 4 and t != "z y" else None) for t in forms if t != "bx"}
    assert defects.neighbours(df.limit(0)).count() == 0


def test_null_prompt_and_long_text():
    assert defects.look(None, "Who is it?")[0] is None
    assert defects.look("p " * 50_000, "Who is the " + "name of the very " * 20_000 + "old one?")[0] is None


def test_length_limits(spark):
    rows = [(n,) for n in range(30, 60) for _ in range(2)] + [(45,)] * 60 + [(200_000,)] * 40
    assert sorted(r[0] for r in defects.length_limits(spark.createDataFrame(rows, "n_chars int")).collect()) == [45, 200_000]


def test_responses_cut_at_a_limit(spark):
    """Responses of very great length that all end at one limit, some of them at what looks like an end."""
    rnd = random.Random(4)
    rows, want = [], set()
    for i in range(60):
        text = ("Which " + " ".join(rnd.choice(["person", "river", "court", "owner"]) + f" of the old{rnd.randint(0, 9**9)} thing" for _ in range(7000)))[:150_000]
        if i % 6 == 0:
            text = text[:-9] + " ab thing"
        rows.append(("t", i, None, text))
        want.add(i)
    rows += [("t", 100 + i, None, f"Which {w} was the thing of the old ab thing?") for i, w in enumerate(["river", "court"])]
    got = defects.find_defects(spark.createDataFrame(rows, "table_name string, row_key long, prompt string, response string")).collect()
    assert {r["row_key"] for r in got} == want and {r["defect"] for r in got} == {"truncated"} and "limit" in {r["evidence"] for r in got}


@pytest.mark.parametrize(
    ("prompt", "response", "defect"),
    [
        ("Which animal is it?", "blue whale", None),
        ("Which colour is it?", "deep sea green paint", None),
        ("Why is that?", "I do not eat meat because of my health.", None),
        ("Name it", "Name it", "copy"),
        ("Wer ist der Hafenmeister von Kiel?", "Das ist der Mann, der nach dem Hafen benannt wurde.", None),
    ],
)
def test_plain_answers_are_sound(prompt, response, defect):
    assert defects.look(prompt, response, like_prompt=True)[0] == defect


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test data")
def test_most_cut_responses_are_found_by_their_neighbours(spark):
    found = defects.find_defects(queries_text._responses(spark, "/root/testdata/sf0.1")).where("defect = 'truncated'")
    n = {r["evidence"]: r["count"] for r in found.groupBy("evidence").count().collect()}
    assert n["neighbour"] > n["ending"] and sum(n.values()) > 1000
