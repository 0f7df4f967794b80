"""Corpus building over typed paths: negatives, corruptions, splits, labels, slices.

Paths are the nested ``path`` structs of the data. Choices that need chance use hash order,
so they are the same on every run and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ranking


def relation_sequence(hops: Column) -> Column:
    return F.transform(hops, lambda h: text.directed(h["relation"], h["direction"]))


def _flipped(direction: Column) -> Column:
    return F.when(direction == "forward", "backward").otherwise("forward")


def _set_at(hops: Column, i: Column, change) -> Column:  # noqa: ANN001
    return F.transform(hops, lambda h, k: F.when(k == i, change(h)).otherwise(h))


def _chained(hops: Column, anchor_type: Column) -> Column:
    """Source types taken over from the hop before, so that the composition reads on."""
    return F.transform(hops, lambda h, k: h.withField("source_type", F.when(k == 0, anchor_type).otherwise(F.get(hops, k - 1)["target_type"])))


def corruptions(paths: DataFrame, inventory: DataFrame, key: str = "example_id", path: str = "path", seed: str = "17") -> DataFrame:
    """Up to five structural corruptions of each path: ``key, negative_type, hops, answer_type``.

    wrong_direction flips a hop, wrong_relation takes another relation with the same target
    type from ``inventory(target_type, relation)``, wrong_order swaps the first two hops,
    missing_hop drops one, wrong_answer_type states another type. The hop is picked by hash.
    Corruptions equal to the path, or to an earlier one, are left out; so are those that a
    path is too short for. Paths without hops or with null hops give none.
    """
    p = F.col(path)
    base = paths.where(p.isNotNull() & (F.size(p["hops"]) > 0) & ~F.exists(p["hops"], lambda h: h.isNull())).select(
        key, p["hops"].alias("hops"), p["anchor_type"].alias("anchor_type"), p["answer_type"].alias("answer_type"), p["kg"].alias("kg")
    )
    drawn = lambda tag: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(tag), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("long")
    pick = lambda tag: (drawn(tag) % F.size("hops")).cast("int")
    types = inventory.where("target_type is not null").groupBy(F.lower("target_type").alias("type")).agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    i = pick("relation")
    one = base.withColumn("at", i).withColumn("type", F.lower(F.get("hops", F.col("at"))["target_type"])).join(types, "type", "left")
    others = F.filter("relations", lambda r: r != F.get("hops", F.col("at"))["relation"])
    swapped = one.withColumn("others", others).where(F.size("others") > 0)
    new = F.get("others", (drawn("other") % F.size("others")).cast("int"))
    # the new columns get names of their own: one named "hops" would capture the old column's name inside lambdas
    out = lambda df, kind, hops, answer: df.select(key, F.lit(kind).alias("negative_type"), hops.alias("_made"), answer.alias("_made_type"), F.col("hops").alias("_from"), F.col("answer_type").alias("_type"))
    two = base.where(F.size("hops") > 1)
    exchanged = F.concat(F.array(F.get("hops", F.lit(1)), F.get("hops", F.lit(0))), F.slice("hops", F.lit(3), F.greatest(F.size("hops") - 2, F.lit(0))))
    fewer = F.filter("hops", lambda _, k: k != pick("missing"))
    reverse = _set_at(F.col("hops"), pick("direction"), lambda h: h.withField("direction", _flipped(h["direction"])))
    all_types = types.select("type").where("type <> 'entity'").agg(F.array_sort(F.collect_set("type")).alias("types"))
    typed = base.join(F.broadcast(all_types)).withColumn("types", F.filter("types", lambda t: t != F.lower(F.coalesce("answer_type", F.lit(""))))).where(F.size("types") > 0)
    other_type = F.get("types", (drawn("type") % F.size("types")).cast("int"))
    parts = [
        out(base, "wrong_direction", reverse, F.col("answer_type")),
        out(swapped, "wrong_relation", _set_at(F.col("hops"), F.col("at"), lambda h: h.withField("relation", new)), F.col("answer_type")),
        out(two, "wrong_order", _chained(exchanged, F.col("anchor_type")), F.col("answer_type")),
        out(two, "missing_hop", _chained(fewer, F.col("anchor_type")), F.element_at(fewer, -1)["target_type"]),
        out(typed, "wrong_answer_type", _set_at(F.col("hops"), F.size("hops") - 1, lambda h: h.withField("target_type", other_type)), other_type),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    every = every.withColumnsRenamed({"_made": "hops", "_made_type": "answer_type"})
    same = F.to_json(F.struct(F.col("hops").alias("h"), F.col("answer_type").alias("a")))
    every = every.withColumn("_key", same).where(F.col("_key") != F.to_json(F.struct(F.col("_from").alias("h"), F.col("_type").alias("a"))))
    order = F.array_position(F.array(*map(F.lit, ("wrong_direction", "wrong_relation", "wrong_order", "missing_hop", "wrong_answer_type"))), F.col("negative_type"))
    return ranking.keep_first(every, [key, "_key"], [order]).drop("_key", "_from", "_type")


def direction_counterfactuals(paths: DataFrame, glossary: DataFrame, key: str = "example_id", path: str = "path") -> DataFrame:
    """Each path with one hop turned round, for every hop that is not symmetric: ``key, flipped_hop, sequence``."""
    p = F.col(path)
    hops = paths.where(p.isNotNull()).select(key, p["kg"].alias("kg"), p["hops"].alias("hops"), F.posexplode(p["hops"]).alias("flipped_hop", "h")).where("h is not null")
    g = glossary.select(F.col("relation_key").alias("k"), "subject_role", "object_role").dropDuplicates(["k"])
    j = hops.withColumn("k", F.concat_ws("::", "kg", "h.relation")).join(g, "k", "left").where(~text.is_symmetric(F.col("h.relation"), F.col("subject_role"), F.col("object_role")))
    turned = _set_at(F.col("hops"), F.col("flipped_hop"), lambda h: h.withField("direction", _flipped(h["direction"])))
    return j.select(key, "flipped_hop", F.array_join(relation_sequence(turned), "|").alias("sequence"))


def heldout_relations(hops: DataFrame, least: int = 4, buckets: int = 7) -> DataFrame:
    """Relations used often enough whose hash bucket is 0; if there is none, the last eligible one."""
    n = hops.where("relation is not null").groupBy("relation").count().where(F.col("count") >= least)
    out = n.where(text.stable_bucket("relation", buckets) == 0)
    last = n.agg(F.max("relation").alias("relation")).where("relation is not null")
    return out.select("relation").unionByName(last.join(out.agg(F.count("*").alias("k")), F.col("k") == 0).select("relation"))


def assign_splits(examples: DataFrame, held_out: DataFrame, key: str = "example_id", path: str = "path") -> DataFrame:
    """``key, new_split``: held-out relation, then held-out composition, then a tenth by hash to dev, else train."""
    seq = relation_sequence(F.col(path)["hops"])
    e = examples.where(F.col(path).isNotNull()).select(key, seq.alias("sequence"), F.transform(F.col(path)["hops"], lambda h: h["relation"]).alias("relations"))
    bad = e.select(key, F.explode("relations").alias("relation")).join(held_out, "relation", "left_semi").select(key).distinct().withColumn("_held", F.lit(True))
    joined = F.array_join("sequence", "|")
    split = (
        F.when(F.col("_held"), "test_unseen_relation")
        .when((F.size("sequence") > 1) & (text.stable_bucket(joined, 10) == 0), "test_unseen_composition")
        .when(text.stable_bucket(F.col(key).cast("string"), 10) == 0, "dev")
        .otherwise("train")
    )
    return e.join(bad, key, "left").select(key, split.alias("new_split"))


def generalization(train: DataFrame, evaluation: DataFrame, key: str = "example_id", sequence: str = "sequence") -> DataFrame:
    """For each evaluation record: does it use a relation, or a composition of known relations, unseen in training?"""
    seen_rel = train.select(F.explode(sequence).alias("r")).distinct()
    seen_seq = train.select(F.array_join(sequence, "|").alias("s")).distinct()
    e = evaluation.select(key, F.col(sequence).alias("q"), F.array_join(sequence, "|").alias("s"))
    new_rel = e.select(key, F.explode("q").alias("r")).join(seen_rel, "r", "left_anti").select(key).distinct().withColumn("unseen_relation", F.lit(True))
    new_seq = e.join(seen_seq, "s", "left_anti").select(key).distinct().withColumn("_seq", F.lit(True))
    j = e.join(new_rel, key, "left").join(new_seq, key, "left")
    rel = F.coalesce("unseen_relation", F.lit(False))
    return j.select(key, rel.alias("unseen_relation"), (F.coalesce("_seq", F.lit(False)) & ~rel).alias("unseen_composition"))


def label_candidates(candidates: DataFrame, gold: DataFrame, key: str = "question_id") -> DataFrame:
    """Marks candidates by annotated sequence or equal answers: adds ``annotated, denotation, is_gold``.

    ``gold(key, gold_sequences array<string>, gold_answers array<string>)``; candidate
    sequences are joined by ``|``. Empty gold answers are equal to nothing.
    """
    from ..functions import answers as A

    j = candidates.join(gold, key, "left")
    annotated = F.coalesce(F.array_contains("gold_sequences", F.array_join("sequence", "|")), F.lit(False))
    k, g = A.answer_key(F.col("answers")), A.answer_key(F.col("gold_answers"))
    same = (F.size(g) > 0) & (F.array_join(k, "\u0001") == F.array_join(g, "\u0001"))
    return j.withColumn("annotated", annotated).withColumn("denotation", same).withColumn("is_gold", annotated | same).drop("gold_sequences", "gold_answers")


def direction_pairs(rows: DataFrame) -> DataFrame:
    """Best forward and backward record of each one-hop relation that has both.

    ``rows(id, kg, relation, direction, score)``; the best has the highest score, then id.
    """
    best = rows.groupBy("kg", "relation", "direction").agg(F.max(F.struct("score", "id")).alias("b"))
    side = lambda d: best.where(F.col("direction") == d).select("kg", "relation", F.col("b.id").alias(f"{d}_id"))
    j = side("forward").join(side("backward"), ["kg", "relation"])
    return j.withColumn("split", F.when(text.stable_bucket(F.concat_ws("::", "kg", "relation"), 10, 8) == 0, "dev").otherwise("train"))


def random_walks(edge: DataFrame, anchors: DataFrame, depth: int, seed: str = "17") -> DataFrame:
    """One simple walk per anchor and depth, the next edge chosen by hash; no immediate way back, no metadata.

    ``question_id, anchor, sequence, nodes``; a walk that cannot go on is left out.
    """
    step = edge.where(text.is_semantic("relation")).select("question_id", "src", text.directed("relation", "direction").alias("key"), "dst")
    walk = anchors.select("question_id", F.col("node").alias("anchor"), F.array().cast("array<string>").alias("sequence"), F.array("node").alias("nodes"), F.col("node").alias("src")).distinct()
    for k in range(depth):
        j = walk.join(step, ["question_id", "src"]).where(~F.array_contains("nodes", F.col("dst")))
        order = F.sha2(F.concat_ws("|", F.lit(f"{seed}-{k}"), "question_id", "anchor", "key", "dst"), 256)
        one = j.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "anchor").orderBy(order))).where("_n = 1")
        walk = one.select("question_id", "anchor", F.array_append("sequence", F.col("key")).alias("sequence"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("src"))
    return walk.drop("src")


def executable_negatives(families: DataFrame, limit: int = 6) -> DataFrame:
    """Negatives of each gold family among the families that run in the same graph.

    ``families(question_id, anchor, sequence, is_gold)``: a family that is the gold sequence
    without its last hop is ``missing_hop``, with one more ``added_hop``, with a hop turned
    round ``wrong_direction``, with the same length and beginning ``sibling_relation``.
    """
    g = families.where("is_gold").select("question_id", "anchor", F.col("sequence").alias("gold"))
    j = g.join(families.where("not is_gold"), ["question_id", "anchor"])
    n, m = F.size("gold"), F.size("sequence")
    same = lambda k: F.array_join(F.slice("gold", F.lit(1), k), "|") == F.array_join(F.slice("sequence", F.lit(1), k), "|")
    bare = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_replace(x, "::(forward|backward)$", "")), "|")
    kind = (
        F.when((m == n - 1) & same(F.greatest(m, F.lit(0))), "missing_hop")
        .when((m == n + 1) & same(F.greatest(n, F.lit(0))), "added_hop")
        .when((m == n) & (bare("gold") == bare("sequence")), "wrong_direction")
        .when((m == n) & same(F.greatest(n - 1, F.lit(0))), "sibling_relation")
    )
    order = [F.col("negative_type"), F.array_join("sequence", "|")]
    return ranking.top_k(j.withColumn("negative_type", kind).where("negative_type is not null"), ["question_id", "anchor", "gold"], order, limit, "place")
