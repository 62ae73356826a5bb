"""Query registry: ``QUERIES[id] = fn(spark, sf_dir) -> DataFrame`` and
``ORACLE[id] = DuckDB SQL`` for the ids that SQL can express. Every query
reads the fixture tables (or data Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from quarry.plans import queries_data, queries_eval, queries_models  # noqa: F401
