"""First-failing-reason gates for generated questions and relation descriptions; null means accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

PLACEHOLDER = "[ENTITY]"
# Wording that describes the procedure instead of asking.
PROCEDURAL = (
    "forward relation", "backward relation", "knowledge graph", "graph traversal", "first hop", "second hop", "third hop", "follow the", "traverse", "points to", "resulting entity", "relation sequence",
)
# Wording that says too little.
VAGUE = ("associated with", "related to", "linked to", "connected to")


def _has(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def question_form(question: Column) -> Column:
    """One placeholder, a question mark at the end, no procedural wording."""
    q = F.trim(F.coalesce(question, F.lit("")))
    count = (F.length(q) - F.length(F.replace(q, F.lit(PLACEHOLDER), F.lit("")))) / len(PLACEHOLDER)
    return F.when(count != 1, "entity_placeholder_count").when(~q.endswith("?"), "not_a_question").when(_has(F.lower(q), PROCEDURAL), "procedural_language")


def item_rejection(status: Column, question: Column) -> Column:
    """Of a returned item: missing, marked opaque, or its question's form."""
    return F.when(status.isNull() & question.isNull(), "missing_output").when(~F.coalesce(status == "valid", F.lit(False)), "model_marked_opaque").otherwise(question_form(question))


def notation(question: Column) -> Column:
    """Internal notation or vague wording in a question."""
    q = F.lower(F.coalesce(question, F.lit("")))
    inner = q.rlike(r"\bv\d+\b") | F.contains(q, F.lit("type:")) | q.rlike(r"[()]")
    return F.when(inner, "internal_notation_in_question").when(_has(q, VAGUE), "vague_question_wording")


def pair_rejection(positive: Column, negative: Column, canonical_positive: Column, canonical_negative: Column, first_relation: Column) -> Column:
    """Of a positive and a negative question that should differ only in direction."""
    form = lambda q: F.coalesce(question_form(q).isin("entity_placeholder_count", "not_a_question"), F.lit(False))
    graph_words = r"\b(forward|backward|graph|hop)\b|reverse direction|through the relation"
    p, n = F.lower(F.trim(F.coalesce(positive, F.lit("")))), F.lower(F.trim(F.coalesce(negative, F.lit(""))))
    symmetric = text.normalized_words(first_relation).isin(*text.SYMMETRIC_WHOLE)
    return (
        F.when(symmetric, "symmetric_relation_pair")
        .when(form(positive) | form(negative), "invalid_question_form")
        .when(p.rlike(graph_words) | n.rlike(graph_words), "exposes_graph_notation")
        .when(p == n, "directions_have_identical_question")
        .when(positive == canonical_positive, "positive_naturalization_fallback")
        .when(negative == canonical_negative, "negative_naturalization_fallback")
    )


def glossary_status(relation: Column, status: Column, template: Column, confidence: Column, least: float = 0.6) -> Column:
    """Status of a relation's description: metadata by pattern, opaque where missing, without both roles or unsure."""
    whole = F.contains(F.lower(F.coalesce(template, F.lit(""))), F.lit("subject")) & F.contains(F.lower(F.coalesce(template, F.lit(""))), F.lit("object"))
    sound = whole & (F.coalesce(confidence, F.lit(0.0)) >= least)
    return F.when(~text.is_semantic(relation), "metadata").when(status.isNull(), "opaque").when(status.isin("semantic", "valid") & ~sound, "opaque").otherwise(status)
