"""Queries of the graph operators over the released question graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, graph, organize, search
from ..plans import programs
from ..session import table
from . import views as v

_JOIN = lambda c: F.array_join(c, "|")


def hop_forward(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(v.triples(spark, d))
    return graph.traverse(e, v.topics(spark, d)).groupBy("question_id", "relation").agg(F.count("*").alias("targets"), F.min("node").alias("first_target"))


def hop_backward(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(v.triples(spark, d))
    return graph.traverse(e, v.gold(spark, d), direction="backward").groupBy("question_id", "relation").agg(F.count("*").alias("sources"), F.min("node").alias("first_source"))


def incident_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.incident_relations(graph.edges(v.triples(spark, d)), v.topics(spark, d))



def multi_hop_leaves(spark: SparkSession, d: str) -> DataFrame:
    t = v.triples(spark, d)
    nodes = t.select("question_id", F.col("head").alias("node")).union(t.select("question_id", "tail"))
    got = graph.leaves(graph.edges(t), nodes, [("skywatch.railway.terminus", "forward"), ("stagework.observatory.first_director", "backward")])
    return got.groupBy("question_id", "anchor").agg(_JOIN(F.array_sort(F.collect_set("node"))).alias("leaves"))


def path_families(spark: SparkSession, d: str) -> DataFrame:
    f = graph.path_families(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2)
    return f.select("question_id", "anchor", _JOIN("sequence").alias("sequence"), _JOIN("answers").alias("answers"), "n_paths")


def _sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = graph.edges(v.triples(spark, d))
    f = graph.path_families(e, v.topics(spark, d), 2)
    return e, f.select("question_id", F.concat_ws("|", "anchor", _JOIN("sequence")).alias("path_id"), "anchor", "sequence")


def path_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Facts that two-hop families use, counted per question and length."""
    e, p = _sequences(spark, d)
    m = graph.materialize_paths(e, p)
    return m.select("question_id", F.size("sequence").alias("hops"), F.explode("facts").alias("fact")).groupBy("question_id", "hops").agg(F.countDistinct("fact").alias("facts"), F.count("*").alias("uses"))


def strict_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Share of executable two-hop walks with a hop that leaves the frontier as it was."""
    t = v.triples(spark, d)
    e = graph.edges(t)
    a = v.topics(spark, d)
    one = a.select("question_id", F.col("node").alias("src")).join(e, ["question_id", "src"]).select("question_id", F.col("src").alias("anchor"), F.concat_ws("::", "relation", "direction").alias("k1"), "dst")
    two = one.withColumnRenamed("dst", "src").join(e, ["question_id", "src"]).select("question_id", "anchor", F.array("k1", F.concat_ws("::", "relation", "direction")).alias("sequence")).distinct()
    r = graph.strict_reduce(e, two.withColumn("path_id", F.concat_ws("|", "anchor", _JOIN("sequence"))))
    return r.groupBy("question_id").agg(F.count("*").alias("walks"), F.count_if(F.size("reduced") < 2).alias("reducible"), F.count_if(F.size("reduced") == 0).alias("no_ops"))


def self_loops(spark: SparkSession, d: str) -> DataFrame:
    return v.triples(spark, d).groupBy("question_id").agg(F.count("*").alias("triples"), F.count_if(F.col("head") == F.col("tail")).alias("loops"))


def bfs_distances(spark: SparkSession, d: str) -> DataFrame:
    got = graph.distances(graph.edges(v.triples(spark, d)), v.topics(spark, d))
    return got.groupBy("question_id", "root", F.col("distance").cast("int").alias("distance")).agg(F.count("*").alias("nodes"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.edges(v.triples(spark, d))).groupBy("question_id", "component").agg(F.count("*").alias("nodes"))


def branch_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Roots: the topic and the gold answers of a question."""
    roots = v.topics(spark, d).union(v.gold(spark, d)).distinct()
    t = v.triples(spark, d)
    inside = t.select("question_id", F.col("head").alias("node")).union(t.select("question_id", "tail")).distinct()
    got = graph.assign_branches(graph.edges(t), roots.join(inside, ["question_id", "node"], "left_semi"))
    return got.groupBy("question_id", "branch").agg(F.count("*").alias("triples"))


def symmetric_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose pairs also stand reversed for a twentieth of them or more."""
    got = graph.symmetric_relations(v.triples(spark, d), 10, 0.05)
    return got.select("relation", "pairs", F.round("share", 9).alias("share"))


def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between the event types of a user, and how often they also go back."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next")).where("next is not null")
    pairs = e.groupBy("event_type", "next").agg(F.count("*").alias("n"))
    back = pairs.select(F.col("next").alias("event_type"), F.col("event_type").alias("next"), F.col("n").alias("n_back"))
    return pairs.join(back, ["event_type", "next"], "left").select(F.col("event_type").alias("from_type"), F.col("next").alias("to_type"), "n", F.coalesce("n_back", F.lit(0)).alias("n_back"))


def dominant_anchor_type(spark: SparkSession, d: str) -> DataFrame:
    """One type per anchor from the types its paths state, a tie broken by the first relation's type."""
    x = v.examples(spark, d).where("positive_path.anchor is not null")
    t = x.select(F.col("positive_path.anchor").alias("anchor"), F.col("positive_path.anchor_type").alias("type"))
    return graph.dominant_type(t.where("type is not null").groupBy("anchor", "type").agg(F.count("*").alias("n")), ["anchor"])


def relation_inventory(spark: SparkSession, d: str) -> DataFrame:
    h = v.examples(spark, d).select(F.explode("positive_path.hops").alias("h")).where("h is not null")
    return h.groupBy(F.lower("h.target_type").alias("target_type")).agg(F.countDistinct(v.fold("h.relation")).alias("relations"), F.min(v.fold("h.relation")).alias("first_relation"))


def graph_answer_availability(spark: SparkSession, d: str) -> DataFrame:
    """Is a gold answer among the endpoints of some family of at most two hops?"""
    e = graph.edges(v.triples(spark, d))
    ends = graph.simple_paths(e, v.topics(spark, d), 2).select("question_id", F.element_at("nodes", -1).alias("node")).distinct()
    g = v.gold(spark, d)
    hit = g.join(ends, ["question_id", "node"], "left_semi").select("question_id").distinct().withColumn("hit", F.lit(True))
    return g.select("question_id").distinct().join(hit, "question_id", "left").agg(F.count("*").alias("questions"), F.count_if("hit").alias("available"))


def batched_programs(spark: SparkSession, d: str) -> DataFrame:
    """Every two-hop family run as a program of its question, all in one plan."""
    _, p = _sequences(spark, d)
    got = programs.run_programs(v.triples(spark, d), p.select("question_id", F.col("path_id").alias("program_id"), F.col("anchor").alias("topic"), "sequence"))
    return got.groupBy("question_id").agg(F.count("*").alias("programs"), F.sum(F.size("answers")).alias("answers"), F.count_if("identity").alias("identity"))


def program_batch_chain(spark: SparkSession, d: str) -> DataFrame:
    """One chain run in every question's graph from its topics."""
    chain = programs.Chain(programs.TOPIC, (("stagework.observatory.first_director", "forward"), ("schooling.settlement.market_court", "backward")))
    return programs.run_chain(v.triples(spark, d), chain, v.topics(spark, d).withColumnRenamed("node", "topic"), unique=True).answers


def program_batch_conjunction(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that reach the topic by one relation and something by another, in every graph."""
    p = programs.Conjunctive("?x", (programs.Atom("?x", "stagework.observatory.first_director", "?y"), programs.Atom("?x", "skywatch.railway.terminus", programs.TOPIC)), exclusions=(("?x", programs.TOPIC),))
    return programs.run_conjunctive(v.triples(spark, d), p, v.topics(spark, d).withColumnRenamed("node", "topic"), unique=True).answers


def identity_traversals(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose topic has a self-loop by some relation, by way of the executor's identity flag."""
    p = programs.Chain(programs.TOPIC, (("stagework.observatory.first_director", "forward"),))
    return programs.run_chain(v.triples(spark, d), p, v.topics(spark, d).withColumnRenamed("node", "topic"), unique=True).identity


def beam_search(spark: SparkSession, d: str) -> DataFrame:
    got = search.search_programs(v.graphs(spark, d))
    return got.select("question_id", "select", _JOIN("atoms").alias("atoms"), _JOIN("answers").alias("answers"), F.round("score", 9).alias("score"), "scored", "rounds", "finished")


def random_walks(spark: SparkSession, d: str) -> DataFrame:
    w = corpus.random_walks(graph.edges(v.triples(spark, d)), v.topics(spark, d), 2)
    return w.select("question_id", "anchor", _JOIN("sequence").alias("sequence"), _JOIN("nodes").alias("nodes"))


def executable_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Gold families are those that end exactly in the gold answers."""
    e = graph.edges(v.triples(spark, d))
    g = v.gold(spark, d).groupBy("question_id").agg(_JOIN(F.array_sort(F.collect_set("node"))).alias("gold_key"))
    f = graph.path_families(e, v.topics(spark, d), 2).join(g, "question_id").withColumn("is_gold", _JOIN("answers") == F.col("gold_key"))
    got = corpus.executable_negatives(f.select("question_id", "anchor", "sequence", "is_gold"))
    return got.select("question_id", "anchor", _JOIN("gold").alias("gold"), _JOIN("sequence").alias("sequence"), "negative_type")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    g = v.graphs(spark, d).where("triples is not null")
    line = F.transform(F.filter("triples", lambda t: t.isNotNull() & t["head"].isNotNull() & t["relation"].isNotNull() & t["tail"].isNotNull() & t["relation"].contains(".")), lambda t: F.concat(F.lit("("), t["head"], F.lit(","), t["relation"], F.lit(","), t["tail"], F.lit(")")))
    return g.select(F.col("question_id").alias("id"), "question", line.alias("lines"))


def organized_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Groups of evidence after breadth-first re-ordering; every line is kept."""
    got = organize.organize(_prompts(spark, d), "structured")
    heads = F.filter("lines", lambda x: x.startswith("["))
    return got.select(F.col("id").alias("question_id"), F.size(heads).alias("groups"), (F.size("lines") - F.size(heads)).alias("n_lines"))


def adjacency_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Evidence written as adjacency blocks: blocks and edges of each question."""
    got = organize.organize(_prompts(spark, d), "adjacency")
    return got.select(F.col("id").alias("question_id"), F.size(F.filter("lines", lambda x: x.startswith("["))).alias("heads"), F.size(F.filter("lines", lambda x: x.startswith("> "))).alias("edges"))


def parse_prompt_triples(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines put into a prompt, taken out again and parsed."""
    prompt = F.concat(F.lit("Task.\n\n" + organize.BEGIN), F.array_join("lines", "\n"), F.lit(organize.END), F.coalesce("question", F.lit("")))
    back = _prompts(spark, d).where("size(lines) > 0").select("id", F.explode(organize.evidence_lines(prompt)).alias("line"))
    return back.select(organize.parse_triple(F.col("line")).alias("t")).groupBy("t.relation").agg(F.count("*").alias("lines"), F.countDistinct("t.head").alias("heads"), F.countDistinct("t.tail").alias("tails"))


QUERIES = {
    f.__name__: f
    for f in (
        hop_forward, hop_backward, incident_relations, multi_hop_leaves, path_families, path_provenance, strict_reduction, self_loops, bfs_distances, components, branch_assignment,
        symmetric_relations, event_transitions, dominant_anchor_type, relation_inventory, graph_answer_availability, batched_programs, program_batch_chain, program_batch_conjunction,
        identity_traversals, beam_search, random_walks, executable_negatives, organized_evidence, adjacency_roundtrip, parse_prompt_triples,
    )
}

_WALKS = f"""{v.EDGES}, {v.TOPICS},
    w AS (SELECT DISTINCT a.question_id, a.node AS anchor, e1.relation AS r1, e1.direction AS d1, e2.relation AS r2, e2.direction AS d2
          FROM a JOIN e e1 ON e1.question_id = a.question_id AND e1.src = a.node JOIN e e2 ON e2.question_id = a.question_id AND e2.src = e1.dst),
    f1 AS (SELECT w.*, list_sort(list(DISTINCT e.dst)) AS s1 FROM w JOIN e ON e.question_id = w.question_id AND e.src = w.anchor AND e.relation = w.r1 AND e.direction = w.d1 GROUP BY ALL),
    f2 AS (SELECT f1.question_id, f1.anchor, f1.r1, f1.d1, f1.r2, f1.d2, f1.s1, list_sort(list(DISTINCT e.dst)) AS s2
           FROM (SELECT *, unnest(s1) AS n FROM f1) f1 JOIN e ON e.question_id = f1.question_id AND e.src = f1.n AND e.relation = f1.r2 AND e.direction = f1.d2 GROUP BY f1.question_id, f1.anchor, f1.r1, f1.d1, f1.r2, f1.d2, f1.s1)"""
_LINES = f"""l AS (SELECT question_id, t.head AS head, {v.sql_fold('t.relation')} AS relation, t.tail AS tail
    FROM (SELECT question_id, unnest(triples) AS t FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id) AS n FROM question_graphs) WHERE n = 1))
    WHERE t.head IS NOT NULL AND t.tail IS NOT NULL AND contains({v.sql_fold('t.relation')}, '.'))"""

SQL = {
    "hop_forward": f"WITH {v.EDGES}, {v.TOPICS} SELECT question_id, relation, CAST(count(DISTINCT dst) AS BIGINT) AS targets, min(dst) AS first_target FROM a JOIN e USING (question_id) WHERE e.src = a.node AND direction = 'forward' GROUP BY ALL",
    "hop_backward": f"WITH {v.EDGES}, {v.GOLD} SELECT question_id, relation, CAST(count(DISTINCT dst) AS BIGINT) AS sources, min(dst) AS first_source FROM g JOIN e USING (question_id) WHERE e.src = g.node AND direction = 'backward' GROUP BY ALL",
    "incident_relations": f"WITH {v.EDGES}, {v.TOPICS} SELECT DISTINCT question_id, node, relation, direction FROM a JOIN e USING (question_id) WHERE e.src = a.node",
    "multi_hop_leaves": f"""WITH {v.EDGES} SELECT e1.question_id, e1.src AS anchor, array_to_string(list_sort(list(DISTINCT e2.dst)), '|') AS leaves FROM e e1 JOIN e e2 ON e1.question_id = e2.question_id AND e1.dst = e2.src
        WHERE e1.relation = 'skywatch.railway.terminus' AND e1.direction = 'forward' AND e2.relation = 'stagework.observatory.first_director' AND e2.direction = 'backward' GROUP BY ALL""",
    "path_families": f"WITH {v.PATHS} SELECT * FROM f",
    "path_provenance": f"""WITH {v.PATHS}, s AS (SELECT DISTINCT question_id, anchor, seq FROM p),
        h1 AS (SELECT s.*, e.src AS s1, e.dst AS d1, e.relation AS r1, e.direction AS w1 FROM s JOIN e ON e.question_id = s.question_id AND e.src = s.anchor AND e.relation || '::' || e.direction = s.seq[1]),
        h2 AS (SELECT h1.*, e.src AS s2, e.dst AS d2, e.relation AS r2, e.direction AS w2 FROM h1 JOIN e ON e.question_id = h1.question_id AND e.src = h1.d1 AND e.relation || '::' || e.direction = h1.seq[2] WHERE len(seq) = 2),
        u AS (SELECT DISTINCT question_id, anchor, seq, CASE WHEN w1 = 'forward' THEN s1 ELSE d1 END AS h, r1 AS r, CASE WHEN w1 = 'forward' THEN d1 ELSE s1 END AS t FROM h1
              UNION SELECT DISTINCT question_id, anchor, seq, CASE WHEN w2 = 'forward' THEN s2 ELSE d2 END, r2, CASE WHEN w2 = 'forward' THEN d2 ELSE s2 END FROM h2)
        SELECT question_id, CAST(len(seq) AS INT) AS hops, CAST(count(DISTINCT (h, r, t)) AS BIGINT) AS facts, CAST(count(*) AS BIGINT) AS uses FROM u GROUP BY ALL""",
    "strict_reduction": f"""WITH {_WALKS} SELECT question_id, CAST(count(*) AS BIGINT) AS walks, CAST(count(*) FILTER (s1 = [anchor] OR s2 = s1) AS BIGINT) AS reducible, CAST(count(*) FILTER (s1 = [anchor] AND s2 = s1) AS BIGINT) AS no_ops FROM f2 GROUP BY ALL""",
    "self_loops": f"WITH {v.TRIPLES} SELECT question_id, CAST(count(*) AS BIGINT) AS triples, CAST(count(*) FILTER (head = tail) AS BIGINT) AS loops FROM t GROUP BY ALL",
    "bfs_distances": f"""WITH RECURSIVE {v.EDGES}, {v.TOPICS},
        r AS (SELECT question_id, node AS root, node, 0 AS distance FROM a UNION SELECT r.question_id, r.root, e.dst, r.distance + 1 FROM r JOIN e ON e.question_id = r.question_id AND e.src = r.node WHERE r.distance < 12),
        m AS (SELECT question_id, root, node, min(distance) AS distance FROM r GROUP BY ALL)
        SELECT question_id, root, CAST(distance AS INT) AS distance, CAST(count(*) AS BIGINT) AS nodes FROM m GROUP BY ALL""",
    "components": f"""WITH RECURSIVE {v.EDGES}, r AS (SELECT DISTINCT question_id, src AS node, src AS seen FROM e UNION SELECT r.question_id, r.node, e.dst FROM r JOIN e ON e.question_id = r.question_id AND e.src = r.seen),
        m AS (SELECT question_id, node, min(seen) AS component FROM r GROUP BY ALL) SELECT question_id, component, CAST(count(*) AS BIGINT) AS nodes FROM m GROUP BY ALL""",
    "branch_assignment": f"""WITH RECURSIVE {v.EDGES}, {v.TOPICS}, {v.GOLD}, roots AS (SELECT DISTINCT o.question_id, o.node FROM (SELECT * FROM a UNION SELECT * FROM g) o JOIN e ON e.question_id = o.question_id AND e.src = o.node),
        r AS (SELECT question_id, node AS root, node, 0 AS distance FROM roots UNION SELECT r.question_id, r.root, e.dst, r.distance + 1 FROM r JOIN e ON e.question_id = r.question_id AND e.src = r.node WHERE r.distance < 12),
        m AS (SELECT question_id, root, node, min(distance) AS distance FROM r GROUP BY ALL),
        n AS (SELECT t.question_id, t.head, t.relation, t.tail, m.root, min(m.distance) AS distance FROM t LEFT JOIN m ON m.question_id = t.question_id AND m.node IN (t.head, t.tail) WHERE t.question_id IN (SELECT question_id FROM roots GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL),
        k AS (SELECT question_id, head, relation, tail, min(distance) AS least FROM n GROUP BY ALL),
        o AS (SELECT k.question_id, k.head, k.relation, k.tail, count(n.root) AS owners, min(n.root) AS owner FROM k LEFT JOIN n ON n.question_id = k.question_id AND n.head = k.head AND n.relation = k.relation AND n.tail = k.tail AND n.distance = k.least GROUP BY ALL)
        SELECT question_id, CASE WHEN owners = 0 THEN 'other' WHEN owners = 1 THEN owner ELSE 'connecting' END AS branch, CAST(count(*) AS BIGINT) AS triples FROM o GROUP BY ALL""",
    "symmetric_relations": f"""WITH {v.TRIPLES}, u AS (SELECT DISTINCT relation, head, tail FROM t)
        SELECT u.relation, CAST(count(*) AS BIGINT) AS pairs, round(avg(CASE WHEN b.relation IS NULL THEN 0.0 ELSE 1.0 END), 9) AS share FROM u LEFT JOIN u b ON b.relation = u.relation AND b.head = u.tail AND b.tail = u.head GROUP BY 1 HAVING count(*) >= 10 AND avg(CASE WHEN b.relation IS NULL THEN 0.0 ELSE 1.0 END) >= 0.05""",
    "event_transitions": """WITH n AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), p AS (SELECT event_type AS f, nx AS t, CAST(count(*) AS BIGINT) AS n FROM n WHERE nx IS NOT NULL GROUP BY ALL)
        SELECT p.f AS from_type, p.t AS to_type, p.n, coalesce(b.n, 0) AS n_back FROM p LEFT JOIN p b ON b.f = p.t AND b.t = p.f""",
    "dominant_anchor_type": f"""WITH {v.EXAMPLES}, n AS (SELECT positive_path.anchor AS anchor, positive_path.anchor_type AS type, count(*) AS n FROM x WHERE positive_path.anchor IS NOT NULL AND positive_path.anchor_type IS NOT NULL GROUP BY ALL),
        m AS (SELECT *, max(n) OVER (PARTITION BY anchor) AS best FROM n) SELECT anchor, CASE WHEN count(*) = 1 THEN min(type) ELSE 'entity' END AS type FROM m WHERE n = best GROUP BY 1""",
    "relation_inventory": f"""WITH {v.EXAMPLES}, h AS (SELECT unnest(positive_path.hops) AS h FROM x) SELECT lower(h.target_type) AS target_type, CAST(count(DISTINCT {v.sql_fold('h.relation')}) AS BIGINT) AS relations, min({v.sql_fold('h.relation')}) AS first_relation FROM h WHERE h IS NOT NULL GROUP BY 1""",
    "graph_answer_availability": f"WITH {v.PATHS}, {v.GOLD}, o AS (SELECT DISTINCT question_id, nodes[len(nodes)] AS node FROM p) SELECT CAST(count(DISTINCT g.question_id) AS BIGINT) AS questions, CAST(count(DISTINCT o.question_id) AS BIGINT) AS available FROM g LEFT JOIN o ON o.question_id = g.question_id AND o.node = g.node WHERE g.node IS NOT NULL",
    "batched_programs": f"""WITH {v.PATHS}, s AS (SELECT DISTINCT question_id, anchor, seq FROM p),
        h1 AS (SELECT s.*, e.dst AS d1, e.src = e.dst AS i1 FROM s JOIN e ON e.question_id = s.question_id AND e.src = s.anchor AND e.relation || '::' || e.direction = s.seq[1]),
        h2 AS (SELECT h1.*, e.dst AS d2, e.src = e.dst AS i2 FROM h1 JOIN e ON e.question_id = h1.question_id AND e.src = h1.d1 AND e.relation || '::' || e.direction = h1.seq[2]),
        u AS (SELECT question_id, anchor, seq, CASE WHEN len(seq) = 1 THEN d1 END AS o, i1 AS i FROM h1 UNION ALL SELECT question_id, anchor, seq, d2, i2 FROM h2),
        k AS (SELECT question_id, anchor, seq, count(DISTINCT o) AS n, bool_or(i) AS i FROM u GROUP BY ALL)
        SELECT question_id, CAST(count(*) AS BIGINT) AS programs, CAST(sum(n) AS BIGINT) AS answers, CAST(count(*) FILTER (i) AS BIGINT) AS identity FROM k GROUP BY 1""",
    "program_batch_chain": f"""WITH {v.TRIPLES}, {v.TOPICS} SELECT DISTINCT a.question_id, a.node AS topic, t2.head AS answer FROM a JOIN t t1 ON t1.question_id = a.question_id AND t1.head = a.node AND t1.relation = 'stagework.observatory.first_director'
        JOIN t t2 ON t2.question_id = a.question_id AND t2.tail = t1.tail AND t2.relation = 'schooling.settlement.market_court' WHERE t2.head <> a.node""",
    "program_batch_conjunction": f"""WITH {v.TRIPLES}, {v.TOPICS} SELECT DISTINCT a.question_id, a.node AS topic, t1.head AS answer FROM a JOIN t t1 ON t1.question_id = a.question_id AND t1.tail = a.node AND t1.relation = 'skywatch.railway.terminus'
        JOIN t t2 ON t2.question_id = a.question_id AND t2.head = t1.head AND t2.relation = 'stagework.observatory.first_director' WHERE t1.head <> a.node""",
    "identity_traversals": f"WITH {v.TRIPLES}, {v.TOPICS} SELECT DISTINCT a.question_id FROM a JOIN t ON t.question_id = a.question_id AND t.head = a.node AND t.tail = a.node AND relation = 'stagework.observatory.first_director'",
    "executable_negatives": f"""WITH {v.PATHS}, {v.GOLD}, k AS (SELECT question_id, array_to_string(list_sort(list(DISTINCT node)), '|') AS gold_key FROM g WHERE node IS NOT NULL GROUP BY 1),
        z AS (SELECT f.question_id, f.anchor, f.sequence, f.answers = k.gold_key AS is_gold, string_split(f.sequence, '|') AS s FROM f JOIN k USING (question_id)),
        j AS (SELECT q.question_id, q.anchor, q.sequence AS gold, w.sequence, CASE WHEN len(w.s) = len(q.s) - 1 AND q.s[1:len(w.s)] = w.s THEN 'missing_hop' WHEN len(w.s) = len(q.s) + 1 AND w.s[1:len(q.s)] = q.s THEN 'added_hop'
              WHEN len(w.s) = len(q.s) AND regexp_replace(q.sequence, '::(forward|backward)', '', 'g') = regexp_replace(w.sequence, '::(forward|backward)', '', 'g') THEN 'wrong_direction'
              WHEN len(w.s) = len(q.s) AND q.s[1:len(q.s) - 1] = w.s[1:len(q.s) - 1] THEN 'sibling_relation' END AS negative_type
              FROM z q JOIN z w ON w.question_id = q.question_id AND w.anchor = q.anchor AND NOT w.is_gold WHERE q.is_gold)
        SELECT question_id, anchor, gold, sequence, negative_type FROM (SELECT *, row_number() OVER (PARTITION BY question_id, anchor, gold ORDER BY negative_type, sequence) AS n FROM j WHERE negative_type IS NOT NULL) WHERE n <= 6""",
    "adjacency_roundtrip": f"""WITH q AS (SELECT DISTINCT question_id FROM question_graphs WHERE triples IS NOT NULL), {_LINES} SELECT q.question_id, CAST(count(DISTINCT l.head) AS INT) AS heads, CAST(count(l.head) AS INT) AS edges FROM q LEFT JOIN l USING (question_id) GROUP BY 1""",
    "parse_prompt_triples": f"WITH {_LINES} SELECT relation, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT head) AS BIGINT) AS heads, CAST(count(DISTINCT tail) AS BIGINT) AS tails FROM l GROUP BY 1",
}

_META = " OR ".join(f"contains(lower(e.relation), '{x}')" for x in text.METADATA_PATTERNS)
SQL["random_walks"] = f"""WITH {v.EDGES}, {v.TOPICS},
    w1 AS (SELECT question_id, node AS anchor, e.relation || '::' || e.direction AS k1, e.dst AS n1, row_number() OVER (PARTITION BY question_id, node ORDER BY sha256('17-0|' || question_id || '|' || node || '|' || e.relation || '::' || e.direction || '|' || e.dst)) AS n
           FROM a JOIN e USING (question_id) WHERE e.src = a.node AND e.dst <> a.node AND NOT ({_META})),
    w2 AS (SELECT w1.question_id, anchor, k1, n1, e.relation || '::' || e.direction AS k2, e.dst AS n2, row_number() OVER (PARTITION BY w1.question_id, anchor ORDER BY sha256('17-1|' || w1.question_id || '|' || anchor || '|' || e.relation || '::' || e.direction || '|' || e.dst)) AS n
           FROM w1 JOIN e ON e.question_id = w1.question_id AND e.src = n1 WHERE w1.n = 1 AND e.dst <> anchor AND e.dst <> n1 AND NOT ({_META}))
    SELECT question_id, anchor, k1 || '|' || k2 AS sequence, anchor || '|' || n1 || '|' || n2 AS nodes FROM w2 WHERE n = 1"""
