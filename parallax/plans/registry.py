"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: list[tuple[str, str]] | None = None,
             recursive: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle (DuckDB) query over the test tables; fixture views
    it mentions are added as CTEs.  Leave it out for operators that have no
    SQL equivalent (model plug-ins); those get a rows-only check.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = with_fixtures(sql, ctes, recursive)
        return fn
    return deco


def load_all() -> None:
    """Import every query suite (each registers itself on import)."""
    from . import (suite_cleaning, suite_corpus, suite_io, suite_workflows,  # noqa: F401
                   suite_runs, suite_scoring, suite_text)
