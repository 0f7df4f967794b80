"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import queries_overlap, queries_records, queries_text

QUERIES = queries_overlap.QUERIES | queries_records.QUERIES | queries_text.QUERIES
SQL = queries_overlap.SQL | queries_records.SQL | queries_text.SQL
