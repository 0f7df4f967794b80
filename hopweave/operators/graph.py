"""Graph operators over per-question triples, as joins on (question_id, node, relation).

``triples(question_id, head, relation, tail)``; ``edges(question_id, src, relation,
direction, dst)`` holds both directions. Every step joins inside a question, so no key is
hotter than one question's graph; for one global graph give all triples one question_id and
rely on the (src, relation) part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize, materialize_counted

TYPE_RELATION = "common.topic.notable_types"


def edges(triples: DataFrame, distinct: bool = True) -> DataFrame:
    """Both directions of each triple; set semantics unless ``distinct`` is off."""
    t = triples.where("head is not null and relation is not null and tail is not null").select("question_id", "head", "relation", "tail")
    t = t.distinct() if distinct else t
    way = lambda s, d, name: F.struct(F.col(s).alias("src"), F.lit(name).alias("direction"), F.col(d).alias("dst"))
    both = t.select("question_id", "relation", F.explode(F.array(way("head", "tail", "forward"), way("tail", "head", "backward"))).alias("e"))
    return both.select("question_id", "e.src", "relation", "e.direction", "e.dst")


def split_types(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without type edges, and ``types(question_id, node, type)`` from them."""
    typed = (F.col("relation") == TYPE_RELATION) & ~F.col("tail").rlike(r"^[mg]\.")
    types = triples.where(typed).select("question_id", F.col("head").alias("node"), F.col("tail").alias("type")).distinct()
    return triples.where(F.col("relation") != TYPE_RELATION), types


def traverse(edge: DataFrame, sources: DataFrame, relation: str | None = None, direction: str = "forward") -> DataFrame:
    """Distinct targets one hop from ``sources(question_id, node)``: ``question_id, relation, node``."""
    e = edge.where(F.col("direction") == direction)
    if relation is not None:
        e = e.where(F.col("relation") == relation)
    return sources.select("question_id", F.col("node").alias("src")).join(e, ["question_id", "src"]).select("question_id", "relation", F.col("dst").alias("node")).distinct()


def incident_relations(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct relations and directions at ``nodes(question_id, node)``."""
    return nodes.select("question_id", F.col("node").alias("src")).join(edge, ["question_id", "src"]).select("question_id", F.col("src").alias("node"), "relation", "direction").distinct()


def leaves(edge: DataFrame, anchors: DataFrame, hops: list[tuple[str, str]]) -> DataFrame:
    """Endpoints of a relation sequence: ``question_id, anchor, node``; the frontier is a set after each hop."""
    front = anchors.select("question_id", F.col("node").alias("anchor"), "node").distinct()
    for relation, direction in hops:
        e = edge.where((F.col("relation") == relation) & (F.col("direction") == direction)).select("question_id", F.col("src").alias("node"), "dst")
        front = front.join(e, ["question_id", "node"]).select("question_id", "anchor", F.col("dst").alias("node")).distinct()
    return front


def reach(triples: DataFrame, anchors: DataFrame, hops: list[tuple[str, str]]) -> DataFrame:
    """:func:`leaves` straight from triples: each hop reads its relation in its direction only."""
    front = anchors.select("question_id", F.col("node").alias("anchor"), "node").distinct()
    for relation, direction in hops:
        src, dst = ("head", "tail") if direction == "forward" else ("tail", "head")
        e = triples.where(F.col("relation") == relation).select("question_id", F.col(src).alias("node"), F.col(dst).alias("dst")).where("node is not null and dst is not null")
        front = front.join(e, ["question_id", "node"]).select("question_id", "anchor", F.col("dst").alias("node")).distinct()
    return front


def simple_paths(edge: DataFrame, anchors: DataFrame, max_hops: int = 2) -> DataFrame:
    """All paths without a repeated node: ``question_id, anchor, sequence, nodes``."""
    start = anchors.select("question_id", F.col("node").alias("anchor"), F.array().cast("array<string>").alias("sequence"), F.array("node").alias("nodes"), F.col("node").alias("src")).distinct()
    step = edge.select("question_id", "src", text.directed("relation", "direction").alias("key"), "dst")
    level, out = start, None
    for _ in range(max_hops):
        level = (
            level.join(step, ["question_id", "src"])
            .where(~F.array_contains("nodes", F.col("dst")))
            .select("question_id", "anchor", F.array_append("sequence", F.col("key")).alias("sequence"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("src"))
        )
        out = level if out is None else out.unionByName(level)
    return out.drop("src")


def path_families(edge: DataFrame, anchors: DataFrame, max_hops: int = 2) -> DataFrame:
    """Relation sequences with the set of their endpoints: ``question_id, anchor, sequence, answers``."""
    p = simple_paths(edge, anchors, max_hops)
    return p.groupBy("question_id", "anchor", "sequence").agg(F.array_sort(F.collect_set(F.element_at("nodes", -1))).alias("answers"), F.count("*").alias("n_paths"))


def stage_paths(paths: DataFrame) -> tuple[DataFrame, int]:
    """``question_id, path_id, anchor, sequence`` written once, and the length of the longest sequence."""
    p = materialize(paths.select("question_id", "path_id", "anchor", "sequence"), "paths")
    return p, p.agg(F.max(F.size("sequence"))).first()[0] or 0


def frontiers(edge: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Frontier of each hop of many sequences at once, with the triples used.

    ``paths(question_id, path_id, anchor, sequence)`` (keys ``relation::direction``) gives
    ``question_id, path_id, step, node, src``; step 0 is the anchor. ``longest`` is the length of
    the longest sequence, as :func:`stage_paths` gives it. The frontier is written out every
    fourth hop, so long sequences do not make a deep plan. Paths and edges both grow with the
    questions, so they are merged: packed files and shuffles look small enough to broadcast and are not.
    """
    step = edge.select("question_id", "src", text.directed("relation", "direction").alias("key"), "dst")
    front = paths.select("question_id", "path_id", "sequence", F.col("anchor").alias("node"))
    out = front.select("question_id", "path_id", F.lit(0).alias("step"), "node", F.lit(None).cast("string").alias("src"))
    for k in range(longest):
        now = front.where(F.size("sequence") > k).select("question_id", "path_id", "sequence", F.col("node").alias("src"), F.get("sequence", F.lit(k)).alias("key"))
        reached = now.join(step.hint("merge"), ["question_id", "src", "key"])
        if k % 4 == 3:
            reached = materialize(reached, "reached")
        out = out.unionByName(reached.select("question_id", "path_id", F.lit(k + 1).alias("step"), F.col("dst").alias("node"), "src"))
        front = reached.select("question_id", "path_id", "sequence", F.col("dst").alias("node")).distinct()
    return out


def materialize_paths(edge: DataFrame, paths: DataFrame) -> DataFrame:
    """Answers and used triples of sequences of any length: ``question_id, path_id, answers, facts``.

    Facts are in the orientation of the data: ``head<TAB>relation<TAB>tail``, sorted.
    """
    paths, longest = stage_paths(paths)
    f = frontiers(edge, paths, longest)
    keyed = f.where("step > 0").join(paths.select("question_id", "path_id", "sequence"), ["question_id", "path_id"])
    key = text.undirected(F.element_at("sequence", F.col("step")))
    forward = key["direction"] == "forward"
    fact = F.concat_ws("\t", F.when(forward, F.col("src")).otherwise(F.col("node")), key["relation"], F.when(forward, F.col("node")).otherwise(F.col("src")))
    last = F.col("step") == F.size("sequence")
    found = keyed.groupBy("question_id", "path_id").agg(F.array_sort(F.collect_set(F.when(last, F.col("node")))).alias("answers"), F.array_sort(F.collect_set(fact)).alias("facts"))
    return paths.join(found, ["question_id", "path_id"], "left").select(
        "question_id", "path_id", "anchor", "sequence", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts")
    )


def strict_reduce(edge: DataFrame, paths: DataFrame) -> DataFrame:
    """Sequences without the hops that leave the frontier as it was.

    From the hop whose frontier is empty on, all hops are kept.
    """
    paths, longest = stage_paths(paths)
    f = frontiers(edge, paths, longest)
    sets = f.groupBy("question_id", "path_id", "step").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    by = sets.groupBy("question_id", "path_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "nodes"))).alias("front"))
    joined = paths.join(by.hint("merge"), ["question_id", "path_id"], "left")
    empty = F.array().cast("array<string>")
    at = lambda i: F.coalesce(F.try_element_at("front", i), empty)
    kept = F.filter("sequence", lambda _, i: (F.size(at(i + 1)) == 0) | (F.array_join(at(i + 1), "\u0001") != F.array_join(at(i), "\u0001")))
    return joined.select("question_id", "path_id", "anchor", "sequence", kept.alias("reduced"))


def own_edges(triples: Column) -> Column:
    """Both directions of one question's triples, ``array<struct<src, key, dst>>``."""
    way = lambda t, s, d, name: F.struct(t[s].alias("src"), text.directed(t["relation"], F.lit(name)).alias("key"), t[d].alias("dst"))
    return F.flatten(F.transform(triples, lambda t: F.array(way(t, "head", "tail", "forward"), way(t, "tail", "head", "backward"))))


def ends(edge: Column) -> Column:
    """The sorted set of nodes that ``array<struct<src, key, dst>>`` leads to."""
    return F.sort_array(F.array_distinct(F.transform(edge, lambda e: e["dst"])))


def two_hops(edge: Column, anchor: Column, row) -> Column:  # noqa: ANN001
    """``row(sequence, answers)`` of each two-hop sequence from the anchor, over the edges of one question's row."""
    keys = lambda a: F.array_distinct(F.transform(a, lambda e: e["key"]))
    at = lambda a, k: F.filter(a, lambda e: e["key"] == k)

    def second(e: Column, one: Column, k1: Column) -> Column:
        beyond = text.let(ends(at(one, k1)), lambda front: F.filter(e, lambda x: F.array_contains(front, x["src"])))
        return text.let(beyond, lambda two: F.transform(keys(two), lambda k2: row(F.array(k1, k2), ends(at(two, k2)))))

    def first(e: Column) -> Column:
        return text.let(F.filter(e, lambda x: x["src"] == anchor), lambda one: F.flatten(F.transform(keys(one), lambda k1: second(e, one, k1))))

    return text.let(edge, first)


def reduced(edge: Column, anchor: Column, sequence: Column) -> Column:
    """:func:`strict_reduce` of a sequence over the edges of one question's row; ``edge`` is bound by the caller."""

    def step(state: Column, key: Column) -> Column:
        there = ends(F.filter(edge, lambda e: (e["key"] == key) & F.array_contains(state["front"], e["src"])))
        kept = lambda now: F.when((F.size(now) > 0) & (now == state["front"]), state["kept"]).otherwise(F.array_append(state["kept"], key))
        return text.let(there, lambda now: F.struct(now.alias("front"), kept(now).alias("kept")))

    return F.aggregate(sequence, F.struct(F.array(anchor).alias("front"), F.array().cast("array<string>").alias("kept")), step)["kept"]


def dominant_type(counts: DataFrame, keys: list[str], hint: Column | None = None) -> DataFrame:
    """One type per key from ``(*keys, type, n)``: the most frequent, a tie broken by ``hint``, else ``entity``.

    The hint (a column of ``counts``) takes an equal type first, then one that contains it or
    is contained in it, in order of name.
    """
    top = counts.withColumn("_best", F.max("n").over(Window.partitionBy(*keys))).where("n = _best")
    h = F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    name = F.lower("type")
    rank = F.when((h != "") & (name == h), 0).when((h != "") & (F.contains(name, h) | F.contains(h, name)), 1).otherwise(2)
    g = top.withColumn("_rank", rank).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("_rank", "type")).alias("_m"))
    return g.select(*keys, F.when((F.col("_n") == 1) | (F.col("_m._rank") < 2), F.col("_m.type")).otherwise("entity").alias("type"))


def _placed(edge: DataFrame) -> DataFrame:
    """Distinct steps, laid out by (question, source) once for all rounds of an iteration; unpersist when done.

    The lineage is one stage table, so a lost executor costs its part of the layout.
    """
    n = int(edge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(edge.select("question_id", "src", "dst").where("src <> dst").distinct(), "steps").repartition(n, "question_id", "src").persist()


def distances(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """Undirected hop counts from each root: ``question_id, root, node, distance``.

    Breadth first until nothing new is reached. A step from a node at distance d leads to
    d - 1, d or d + 1, so a round only drops the nodes of the last two rounds. Each round is
    written out, so the plan does not grow.
    """
    step = _placed(edge)
    front = materialize(roots.select("question_id", F.col("node").alias("root"), "node").distinct().withColumn("distance", F.lit(0)), "front")
    seen, before = front, None
    while True:
        known = front if before is None else front.unionByName(before)
        reached = front.select("question_id", "root", F.col("node").alias("src"), (F.col("distance") + 1).alias("distance")).join(step, ["question_id", "src"]).select("question_id", "root", F.col("dst").alias("node"), "distance").distinct()
        new, n = materialize_counted(reached.join(known.select("question_id", "root", "node"), ["question_id", "root", "node"], "left_anti"), "front")
        if not n:
            step.unpersist()
            return seen
        seen, before, front = seen.unionByName(new), front, new


def components(edge: DataFrame) -> DataFrame:
    """Connected components inside each question: ``question_id, node, component`` (its smallest node).

    Smallest labels spread along edges from the nodes whose label changed in the last round
    only. From the fifth round on, which only long chains reach, a changed node also takes its
    new label's own label, so the number of rounds follows the logarithm of the longest chain.
    """
    step = _placed(edge)
    alone = edge.where("src = dst").select("question_id", F.col("src").alias("node"))
    label = materialize(step.select("question_id", F.col("src").alias("node")).union(alone).distinct().select("question_id", "node", F.col("node").alias("label"), F.lit(True).alias("changed")), "labels")
    turn = 0
    while True:
        turn += 1
        told = label.where("changed").select("question_id", F.col("node").alias("src"), "label").join(step, ["question_id", "src"]).groupBy("question_id", F.col("dst").alias("node")).agg(F.min("label").alias("told"))
        near = label.select("question_id", "node", "label").join(told, ["question_id", "node"], "left").select("question_id", "node", F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("changed"))
        label, changed = materialize_counted(near, "labels", "changed")
        if not changed:
            step.unpersist()
            return label.select("question_id", "node", F.col("label").alias("component"))
        if turn > 4:
            above = label.where("changed").select("question_id", "node", "label").join(label.select("question_id", F.col("node").alias("label"), F.col("label").alias("above")), ["question_id", "label"]).where("above < label").select("question_id", "node", "above")
            label = materialize(label.join(above, ["question_id", "node"], "left").select("question_id", "node", F.least("label", "above").alias("label"), "changed"), "labels")


def symmetric_relations(triples: DataFrame, least_pairs: int = 10, threshold: float = 0.8) -> DataFrame:
    """Relations whose distinct pairs mostly also stand reversed: ``relation, pairs, share``."""
    pairs = triples.where("head is not null and tail is not null").select("relation", "head", "tail").distinct()
    back = pairs.select("relation", F.col("tail").alias("head"), F.col("head").alias("tail"), F.lit(1).alias("back"))
    g = pairs.join(back, ["relation", "head", "tail"], "left").groupBy("relation").agg(F.count("*").alias("pairs"), F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("share"))
    return g.where((F.col("pairs") >= least_pairs) & (F.col("share") >= threshold))


def assign_branches(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """Each triple to its unique nearest root, else ``connecting`` (a tie) or ``other`` (unreachable).

    ``question_id, src, relation, dst, branch`` for the forward edges of questions with two roots or more.
    """
    d = distances(edge, roots)
    many = roots.select("question_id", "node").distinct().groupBy("question_id").count().where("count >= 2").select("question_id")
    e = edge.where("direction = 'forward'").join(many, "question_id", "left_semi").select("question_id", "src", "relation", "dst")
    ends = e.select("*", F.explode(F.array("src", "dst")).alias("node"))
    near = ends.join(d, ["question_id", "node"], "left").groupBy("question_id", "src", "relation", "dst", "root").agg(F.min("distance").alias("distance"))
    best = near.withColumn("least", F.min("distance").over(Window.partitionBy("question_id", "src", "relation", "dst")))
    own = F.collect_set(F.when(F.col("distance") == F.col("least"), F.col("root")))
    g = best.groupBy("question_id", "src", "relation", "dst").agg(own.alias("owners"))
    return g.select("question_id", "src", "relation", "dst", F.when(F.size("owners") == 0, "other").when(F.size("owners") == 1, F.element_at("owners", 1)).otherwise("connecting").alias("branch"))
