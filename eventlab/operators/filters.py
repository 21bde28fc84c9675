"""Filters, exclusion/inclusion lists, de-duplication and lookups.

Broadcast is used only for tables whose size is bounded by construction
(literal lists written in code, checked against ``MAX_BROADCAST_ROWS``).
Data-derived lookups are joined without a hint: AQE turns the join into a
broadcast at run time only when the measured size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MAX_BROADCAST_ROWS = 100_000


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A small DataFrame from literal rows, broadcast (size checked)."""
    if len(rows) > MAX_BROADCAST_ROWS:
        raise ValueError(f"literal table of {len(rows)} rows exceeds {MAX_BROADCAST_ROWS}")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def where_all(df: DataFrame, *conds: Column) -> DataFrame:
    """Keep rows where every predicate is true (NULL drops, like WHERE)."""
    out = df
    for c in conds:
        out = out.where(c)
    return out


def exclude(df: DataFrame, rows: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """Remove rows matching any exclusion row (tuples aligned with
    ``keys``); ``None`` in a cell is a wildcard. One broadcast anti join per
    wildcard pattern (at most 2^k, usually 1-2), each on plain equi keys, so
    the large side is never shuffled."""
    patterns: dict[tuple, list] = {}
    for row in rows:
        mask = tuple(k for k, v in zip(keys, row) if v is not None)
        patterns.setdefault(mask, []).append(tuple(v for v in row if v is not None))
    out = df
    for mask, values in patterns.items():
        if not mask:
            return df.limit(0)
        schema = StructType([df.schema[k] for k in mask])
        out = out.join(literal_table(df.sparkSession, values, schema), list(mask), "left_anti")
    return out


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Inclusion list as a left semi join (EXISTS). Broadcast is left to
    AQE's measured-size rule unless ``ids`` is a ``literal_table``."""
    return df.join(ids, key, "left_semi")


def above(df: DataFrame, col: str, threshold: float | None) -> DataFrame:
    """Keep rows with col > threshold (no-op when threshold is None)."""
    return df if threshold is None else df.where(F.col(col) > F.lit(threshold))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove rows with NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


def distinct_rows(df: DataFrame) -> DataFrame:
    """C7."""
    return df.distinct()


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C8."""
    return df.select(*keys).distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row in ``order`` per key, all columns (R's
    ``!duplicated``). Ascending order; remaining columns break ties so the
    result is deterministic.

    Planned as ``min(struct(order..., rest...))`` per key. A struct is no
    mutable buffer, so this is a sort aggregate: each task sorts its rows by
    key, but its partial minima still reduce a key with a third of all rows
    before the shuffle (a row_number window would sort that key in one task).
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.o{i}").alias(c) for i, c in enumerate(order)],
                       *[F.col(f"_first.{c}") for c in rest]).select(*df.columns)


def attach(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Lookup join of dimension attributes on ``keys``."""
    return df.join(dim, list(keys), how)


def apply_overrides(df: DataFrame, rows: Sequence[tuple], keys: Sequence[str],
                    cols: Sequence[str]) -> DataFrame:
    """Hand edits as data: ``rows`` are (keys..., new values for ``cols``...);
    a matching row takes the new non-NULL values, other rows are unchanged.
    The edit list is a literal (size-checked broadcast), joined on equi keys."""
    if not rows:
        return df
    schema = StructType([df.schema[k] for k in keys] +
                        [StructField(f"_new_{c}", df.schema[c].dataType, True) for c in cols])
    edits = literal_table(df.sparkSession, list(rows), schema)
    joined = df.join(edits, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols
                           else F.col(c) for c in df.columns])
