"""All registered queries of the graph-path operators and the SQL that checks them."""

from __future__ import annotations

from .catalogue import assembly, building, business, graph, metrics, studies, texts

_MODULES = [business, graph, metrics, texts, building, studies, assembly]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
