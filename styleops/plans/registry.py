"""All registered queries and their SQL twins."""

from __future__ import annotations

from styleops.plans import lexicon_queries, metric_queries, model_queries

_PARTS = [lexicon_queries, metric_queries, model_queries]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
