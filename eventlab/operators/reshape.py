"""Reshape, ordering, set operations, completion and order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.operators.keys import join_same

MAX_LEVELS = 10_000


def pivot_wider(df: DataFrame, by: Sequence[str], key: str, value: str,
                values: Sequence) -> DataFrame:
    """G1: long -> wide. ``values`` is given, so Spark needs no extra scan to
    find the pivot levels. (key, by) must be unique, as in ``spread``."""
    return df.groupBy(*by).pivot(key, list(values)).agg(F.first(value))


def pivot_longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str,
                 values_to: str) -> DataFrame:
    """Wide -> long (``gather``)."""
    return df.unpivot(list(ids), list(cols), names_to, values_to)


def sort_by(df: DataFrame, *cols) -> DataFrame:
    """Global sort (range-partitioned, distributed)."""
    return df.orderBy(*cols)


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows by column name; missing columns become NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


def levels_of(df: DataFrame, col: str) -> list:
    """Distinct levels of a factor column, sorted (a bounded list: errors
    above ``MAX_LEVELS`` rather than pulling data to the driver)."""
    rows = df.select(col).distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels; not a factor")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v))


def complete_cells(df: DataFrame, factors: Mapping[str, Sequence | None],
                   fill: Mapping[str, object] | None = None) -> DataFrame:
    """Every combination of factor levels present, NULL (or ``fill``)
    where absent. The spine is built by exploding literal level arrays (no
    join between factors); the data are then left-joined to it, NULL being a
    level like any other."""
    spark = df.sparkSession
    levels = {f: (list(v) if v is not None else levels_of(df, f)) for f, v in factors.items()}
    spine = spark.range(1).select(F.lit(1).alias("_one"))
    for f, lv in levels.items():
        dtype = df.schema[f].dataType
        spine = spine.withColumn(f, F.explode(F.array(*[F.lit(v).cast(dtype) for v in lv])))
    out = join_same(spine.drop("_one"), df, list(levels), "left")
    return out.fillna(dict(fill)) if fill else out


#: Bits of a value's key that one pass settles.
RADIX_BITS = 16


def order_key(x: Column) -> Column:
    """A long that orders like the double ``x`` and is equal for equal values only:
    the bits of its size, exponent first, with its sign. NaN comes last."""
    endless = F.isnan(x) | (F.abs(x) == float("inf"))
    size = F.when(endless, 1.0).otherwise(F.abs(x))
    tiny = F.lit(2.0**-1022)
    near = F.floor(F.log2(F.greatest(F.least(size, F.lit(1.7e308)), tiny))).cast("int")
    fits = size / F.pow(F.lit(2.0), near)      # log2 may be one off next to a power of two
    exponent = near + F.when(fits >= 2, 1).when(fits < 1, -1).otherwise(0)
    share = size / F.pow(F.lit(2.0), exponent) - 1
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + (share * F.lit(2.0**52)).cast("long")
    bits = (F.when(endless, F.lit(2047 << 52))
            .when(size < tiny, (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).otherwise(normal))
    return F.when(F.isnan(x), F.lit(2**63 - 1)).when(x < 0, -bits).otherwise(bits)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, _x, _c, _k): how often each value occurs in each group and its order
    key, staged. The count is pre-added in every task, so a value that most rows
    share is one row; everything below works on this table."""
    from eventlab.sources.files import stage
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counts = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    return stage(counts.withColumn("_k", order_key(F.col("_x"))), "value-counts")


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], probs: Sequence[float], prefix: str = "q") -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics, R's
    default type 7) per group of a ``value_counts`` table, by radix selection.

    Each pass settles the next ``RADIX_BITS`` bits of the keys that hold a wanted
    rank: rows whose key begins with a wanted prefix are counted by the next bits
    (at most 2^16 cells of a prefix, pre-added in every task), and running counts
    tell which cells go on. After 64 bits a cell is one value. The number of
    passes is fixed, no row is compared with a list of bounds, and a group with
    most of the rows is spread over its cells."""
    from eventlab.sources.files import stage
    by = list(by)
    position = [(F.col("n") - 1) * F.lit(float(p)) + 1 for p in probs]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in position for f in (F.floor, F.ceil)]))
    wanted = counts.groupBy(*by).agg(F.sum("_c").alias("n")).select(
        *by, F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_before"), "n", ranks.alias("_ranks"))
    for settled in range(RADIX_BITS, 64 + 1, RADIX_BITS):
        held = F.lit(0).cast("long") if settled == RADIX_BITS else F.shiftright("_k", 64 - settled + RADIX_BITS)
        rows = counts.select(*by, "_x", "_c", held.alias("_cell"), F.shiftright("_k", 64 - settled).alias("_next"))
        # the same rows per (group, prefix) all the way: counts are added before they meet the wanted ranks
        cells = rows if settled == RADIX_BITS else join_same(rows, wanted.select(*by, "_cell"), [*by, "_cell"], "left_semi")
        cells = cells.groupBy(*by, "_cell", "_next").agg(F.sum("_c").alias("_rows"), F.min("_x").alias("_x"))
        in_order = Window.partitionBy(*by, "_cell").orderBy("_next")
        cells = cells.withColumn("_run", F.sum("_rows").over(in_order) - F.col("_rows"))
        cells = join_same(cells, wanted.drop("_x"), [*by, "_cell"]).withColumn("_before", F.col("_before") + F.col("_run"))
        here = F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_rows")))
        wanted = cells.withColumn("_ranks", here).where(F.size("_ranks") > 0).select(
            *by, F.col("_next").alias("_cell"), "_before", "n", "_ranks", "_x")
        wanted = stage(wanted, "quantile-cells")
    found = wanted.select(*by, "n", F.explode("_ranks").alias("_rank"), "_x").groupBy(*by, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    outs = []
    for i, h in enumerate(position):
        lo, hi = (F.element_at("_at", f(h).cast("long")) for f in (F.floor, F.ceil))
        outs.append((lo + (h - F.floor(h)) * (hi - lo)).alias(f"{prefix}{i}"))
    return found.select(*by, "n", *outs)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    pieces: int | None = None, prefix: str = "q") -> DataFrame:
    """Exact quantiles per group (NULL is a group); NULL values don't count.
    ``pieces`` is accepted for older callers and has no effect."""
    return quantiles_of_counts(value_counts(df, by, value), by, probs, prefix)


def box_stats(df: DataFrame, by: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """Boxplot summary per group: quartiles (linear interpolation, as R's
    default quantile), IQR, whiskers (most extreme values within 1.5 IQR of
    the box) and the number of outliers. One pass over the rows counts the
    values; quartiles and whiskers both come from the counts. ``pieces`` is
    accepted for older callers and has no effect."""
    by = list(by)
    counts = value_counts(df, by, value)
    x, c = F.col("_x"), F.col("_c")
    q = (quantiles_of_counts(counts, by, [0.25, 0.5, 0.75])
         .select(*by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                 F.col("q2").alias("q3"))
         .withColumn("iqr", F.col("q3") - F.col("q1")))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    stats = [*q.columns[len(by):]]
    return (join_same(counts, q, by).groupBy(*by, *stats)
            .agg(F.min(x).alias("min"), F.max(x).alias("max"),
                 F.min(F.when(x >= lo, x)).alias("lower_whisker"),
                 F.max(F.when(x <= hi, x)).alias("upper_whisker"),
                 F.sum(F.when((x < lo) | (x > hi), c).otherwise(0)).alias("n_outliers")))
