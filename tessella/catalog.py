"""The registry of queries and of their SQL."""

from __future__ import annotations

from tessella.queries import metrics, splits

_MODULES = (metrics, splits)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
