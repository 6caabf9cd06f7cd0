"""All registered graph queries and their SQL."""

from __future__ import annotations

from . import catalog_build, catalog_files, catalog_graph, catalog_query, catalog_stores, catalog_text

MODULES = (catalog_query, catalog_graph, catalog_build, catalog_text, catalog_files, catalog_stores)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
