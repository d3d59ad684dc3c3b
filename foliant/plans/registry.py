"""All queries of the catalogue, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (query, DuckDB SQL or None)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name."""

    def add(f):
        if name in _ALL:
            raise ValueError(f"two queries are named {name}")
        _ALL[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from foliant.plans import catalog_queries, check_queries, layout_queries, reader_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
