"""Queries and SQL of this subpackage."""

from . import capping, history, leaks, looks, neardup, packing, spans, topn

QUERIES = {k: f for m in (capping, history, topn, neardup, looks, packing, leaks, spans) for k, f in m.QUERIES.items()}
