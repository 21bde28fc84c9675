"""Joins on keys where NULL is a key like any other, as ``group_by`` has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all ``keys`` are the same,
    NULL the same as NULL. Planned as a hash or sort-merge join like a plain one.
    The key columns are those of ``left``."""
    own = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    cond = [left[k].eqNullSafe(own[f"_same_{k}"]) for k in keys]
    return left.join(own, cond, how).drop(*[f"_same_{k}" for k in keys])
