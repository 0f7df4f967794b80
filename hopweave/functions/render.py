"""Paths as explicit queries and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Which sections of a candidate's text each input mode shows.
MODES = {
    "question": (),
    "question_path": ("path",),
    "question_generated_path": ("generated", "path"),
    "question_answer_type": ("generated", "type"),
    "question_answer_count": ("generated", "type", "count"),
    "question_answer_labels": ("generated", "type", "count", "labels"),
}
SAMPLE = 8


def _or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(default))


def triples_of(hops: Column) -> Column:
    """Hops as facts over variables ``v0, v1, ...``: subject, predicate, object and the types in fact orientation.

    A hop without a direction, and a null hop, give a null fact.
    """

    def fact(h: Column, i: Column) -> Column:
        here, there = F.concat(F.lit("v"), i.cast("string")), F.concat(F.lit("v"), (i + 1).cast("string"))
        forward = h["direction"] == "forward"
        s, t = _or(h["source_type"], "entity"), _or(h["target_type"], "entity")
        pick = lambda a, b: F.when(forward, a).otherwise(b)
        return F.when(
            h["direction"].isin("forward", "backward"),
            F.struct(pick(here, there).alias("subject"), h["relation"].alias("predicate"), pick(there, here).alias("object"), pick(s, t).alias("subject_type"), pick(t, s).alias("object_type"), there.alias("reached")),
        )

    return F.transform(hops, fact)


def logical_form(hops: Column) -> Column:
    """``predicate(subject, object)`` of each fact joined by `` AND ``, with the answer variable."""
    facts = F.transform(triples_of(hops), lambda t: F.concat(t["predicate"], F.lit("("), t["subject"], F.lit(", "), t["object"], F.lit(")")))
    return F.concat(F.array_join(facts, " AND "), F.lit(" -> v"), F.size(hops).cast("string"))


def shared_records(hops: Column) -> Column:
    """Middle variables of two neighbouring facts that share a subject of one domain and type (a likely record node)."""
    facts = triples_of(hops)

    def pair(a: Column, b: Column) -> Column:
        x, y = text.relation_schema(a["predicate"]), text.relation_schema(b["predicate"])
        same = (x["domain"] == y["domain"]) & (x["type"] == y["type"])
        return F.when(same & (a["subject"] == a["reached"]) & (b["subject"] == a["reached"]), a["reached"])

    n = F.greatest(F.size(facts) - 1, F.lit(0))
    return F.array_compact(F.zip_with(F.slice(facts, F.lit(1), n), F.slice(facts, F.lit(2), n), pair))


def represent_query(hops: Column) -> Column:
    """A path as an explicit query: variables with types, facts, likely record nodes, logical form and answer.

    A path without hops, or with a hop that is null or has no direction, is an error.
    """
    sound = (F.size(hops) > 0) & F.forall(hops, lambda h: F.coalesce(h["direction"].isin("forward", "backward"), F.lit(False)))
    sure = F.when(sound, hops).otherwise(F.raise_error(F.lit("a path without hops or with a hop that has no direction")).cast("array<struct<relation:string,direction:string,source_type:string,target_type:string>>"))
    kind = lambda c: _or(c, "entity")
    later = F.transform(sure, lambda h, i: F.struct(F.concat(F.lit("v"), (i + 1).cast("string")).alias("id"), kind(h["target_type"]).alias("type")))
    variables = F.concat(F.array(F.struct(F.lit("v0").alias("id"), kind(F.get(sure, F.lit(0))["source_type"]).alias("type"))), later)
    answer = F.element_at(variables, -1)
    return F.struct(variables.alias("variables"), triples_of(sure).alias("facts"), shared_records(sure).alias("records"), logical_form(sure).alias("form"), answer["id"].alias("answer"), answer["type"].alias("answer_type"))


def fact_statement(fact: Column, meaning: Column, template: Column) -> Column:
    """A fact in its relation's template; a template with other fields gives way to the meaning, a lacking one is empty."""
    side = lambda n: F.concat(fact[n], F.lit(" (type: "), fact[f"{n}_type"], F.lit(")"))
    t = F.coalesce(template, F.lit(""))
    odd = F.replace(F.replace(t, F.lit("{subject}")), F.lit("{object}")).rlike(r"[{}]")
    plain = F.concat(side("subject"), F.lit(" -- "), F.coalesce(meaning, F.lit("unknown")), F.lit(" --> "), side("object"))
    return F.when(odd, plain).otherwise(F.replace(F.replace(t, F.lit("{subject}"), side("subject")), F.lit("{object}"), side("object")))


def canonical_question(hops: Column, answer_type: Column, style: Column | int = 0) -> Column:
    """A controlled question that states every hop, in one of three wordings."""
    step = F.transform(hops, lambda h: F.concat(F.lit('follow "'), text.relation_words(h["relation"]), F.lit('" '), h["direction"], F.lit(" to a "), _or(h["target_type"], "entity")))
    chain, kind = F.array_join(step, ", then "), _or(answer_type, "entity")
    s = F.pmod(style if isinstance(style, Column) else F.lit(style), F.lit(3))
    return (
        F.when(s == 0, F.concat(F.lit("What "), kind, F.lit(" do you reach from [ENTITY] if you "), chain, F.lit("?")))
        .when(s == 1, F.concat(F.lit("Starting at [ENTITY], which "), kind, F.lit(" results when you "), chain, F.lit("?")))
        .otherwise(F.concat(F.lit("Which "), kind, F.lit(" is connected to [ENTITY] by this traversal: "), chain, F.lit("?")))
    )


def covers(question: Column, hops: Column) -> Column:
    """Does a question state every hop's relation words and direction?"""
    q = F.lower(question)
    return F.forall(hops, lambda h: F.contains(q, F.lower(text.relation_words(h["relation"]))) & F.contains(q, F.lower(h["direction"])))


def answer_evidence(answers: Column, answer_type: Column) -> Column:
    """Type, number and a sample of a candidate's labelled answers, and how many are bare ids."""
    named = F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return F.struct(_or(answer_type, "entity").alias("type"), F.size(named).alias("count"), text.unlabeled_count(named).alias("unlabeled"), F.slice(named, 1, SAMPLE).alias("labels"))


def candidate_text(question: Column, generated: Column, path: Column, evidence: Column, mode: str) -> Column:
    """Sections of a candidate as one text, as far as the mode shows them."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    show = MODES[mode]
    part = lambda title, body: F.concat(F.lit(f"[{title}]\n"), body)
    out = [part("ORIGINAL QUESTION", F.coalesce(question, F.lit("")))]
    if "generated" in show:
        out.append(part("GENERATED QUESTION", F.coalesce(generated, F.lit(""))))
    if "path" in show:
        out.append(part("CANDIDATE PATH", F.coalesce(path, F.lit(""))))
    lines = []
    if "type" in show:
        lines.append(F.concat(F.lit("type: "), evidence["type"]))
    if "count" in show:
        n = evidence["count"].cast("string")
        lines += [F.concat(F.lit("count: "), n), F.concat(F.lit("unlabeled ids: "), evidence["unlabeled"].cast("string"), F.lit(" of "), n)]
    if "labels" in show:
        lines.append(F.concat(F.lit("sample: "), F.when(F.size(evidence["labels"]) > 0, F.array_join(evidence["labels"], "; ")).otherwise("none")))
    if lines:
        out.append(part("CANDIDATE ANSWERS", F.concat_ws("\n", *lines)))
    return F.concat_ws("\n\n", *out)


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of columns as JSON."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def sparql_relations(query: Column) -> Column:
    """Predicates of the triples of a query text, in order."""
    return F.regexp_extract_all(query, F.lit(r"(?m)^\s*\S+\s+ns:([A-Za-z0-9_.]+)\s+\S+\s*\.\s*$"), 1)
