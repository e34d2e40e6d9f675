"""The register that the plan modules fill."""

from __future__ import annotations

from collections.abc import Callable

from litsieve.sources.adapters import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of (spark, sf_dir); sql is its DuckDB counterpart over the named views."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return f

    return add
