"""Query registry: ``QUERIES[name](spark, sf_dir)`` and ``ORACLES[name]`` SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name`` with its DuckDB oracle text."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_ctes(fragments: Iterable[str], select: str) -> str:
    """``WITH`` + de-duplicated CTE fragments (order kept) + final select."""
    seen, parts = set(), []
    for f in fragments:
        f = f.strip().strip(",")
        if f and f not in seen:
            seen.add(f)
            parts.append(f)
    return "WITH " + ",\n".join(parts) + "\n" + select
