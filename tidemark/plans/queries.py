"""Registered queries of the library's own operators, with the DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans.registry import alignment, documents, kernels, lifecycle, live, returns, staged

_FAMILIES = (kernels, alignment, returns, documents, lifecycle, live, staged)
QUERIES: dict[str, Callable] = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
FLAGSHIP = "agg_metrics"
