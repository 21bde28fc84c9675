"""Interval joins: points inside intervals (D4) and interval overlap.

A plain ``keys + BETWEEN`` join hashes on the keys only, so every point of a
key is compared with every interval of that key -- quadratic for a hot key.
Here the equi key is ``(keys, time bucket)``: an interval is exploded over
the coarse buckets it covers (a few per interval), a point has exactly one
bucket, and the range test is a residual on the bucket's candidates only.
The bucket also spreads a hot key over time, which is the salt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.functions.columns import time_bucket_index
from eventlab.operators.keys import join_same
from eventlab.sources.files import stage

DAY = 86_400


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_time: str,
                  start: str, end: str, bucket_seconds: int = DAY, how: str = "inner"
                  ) -> DataFrame:
    """``bucket_seconds`` also spreads a hot key over time: size it so that one
    key's rows of one bucket fit a task. Rows of ``points`` whose ``point_time`` lies in [start, end] (both ends
    inclusive) of an interval with equal ``keys``. ``how`` is inner or left
    (left keeps unmatched points with NULL interval columns). Each (point,
    interval) pair appears once. Non-key column names must not clash."""
    iv = intervals.withColumn("_b", F.explode(F.sequence(
        time_bucket_index(start, bucket_seconds), time_bucket_index(end, bucket_seconds))))
    pt = points.withColumn("_b", time_bucket_index(point_time, bucket_seconds))
    p, i = pt.alias("_p"), iv.alias("_i")
    cond = [F.col(f"_p.{k}") == F.col(f"_i.{k}") for k in [*keys, "_b"]]
    cond.append(F.col(f"_p.{point_time}").between(F.col(f"_i.{start}"), F.col(f"_i.{end}")))
    joined = p.join(i, cond, how)
    cols = [F.col(f"_p.{c}") for c in points.columns]
    cols += [F.col(f"_i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*cols)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_start: str, a_end: str,
                 b_start: str, b_end: str, bucket_seconds: int = DAY) -> DataFrame:
    """Pairs of intervals with equal keys that overlap
    (a.start <= b.end and b.start <= a.end). Both sides are exploded over
    their buckets; a pair is kept only in the first bucket both cover
    (max of the two start buckets), so it is emitted exactly once."""
    ea = a.withColumn("_b", F.explode(F.sequence(time_bucket_index(a_start, bucket_seconds),
                                                 time_bucket_index(a_end, bucket_seconds))))
    eb = b.withColumn("_b", F.explode(F.sequence(time_bucket_index(b_start, bucket_seconds),
                                                 time_bucket_index(b_end, bucket_seconds))))
    x, y = ea.alias("_a"), eb.alias("_c")
    cond = [F.col(f"_a.{k}") == F.col(f"_c.{k}") for k in [*keys, "_b"]]
    cond += [F.col(f"_a.{a_start}") <= F.col(f"_c.{b_end}"),
             F.col(f"_c.{b_start}") <= F.col(f"_a.{a_end}"),
             F.col("_a._b") == F.greatest(time_bucket_index(F.col(f"_a.{a_start}"), bucket_seconds),
                                          time_bucket_index(F.col(f"_c.{b_start}"), bucket_seconds))]
    joined = x.join(y, cond, "inner")
    cols = [F.col(f"_a.{c}") for c in a.columns]
    cols += [F.col(f"_c.{c}") for c in b.columns if c not in keys]
    return joined.select(*cols)


def overlap_summary(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: Sequence[str],
                    a_start: str, a_end: str, b_start: str, b_end: str,
                    aggs: Sequence, bucket_seconds: int = DAY,
                    materialize: bool = False) -> DataFrame:
    """For each interval of ``a``, aggregates over the overlapping
    intervals of ``b`` (count/sum ...). Intervals without partners keep
    count 0 / NULL sums through a left join of the aggregate back to ``a``.
    ``a`` is used twice; with ``materialize`` it is staged once in the
    shared folder (for an ``a`` that is expensive to recompute)."""
    if materialize:
        a = stage(a, "overlap-left")
    pairs = overlap_join(a.select(*keys, *a_id, a_start, a_end), b, keys,
                         a_start, a_end, b_start, b_end, bucket_seconds)
    per = pairs.groupBy(*keys, *a_id).agg(*aggs)
    return a.join(per, [*keys, *a_id], "left")


def overlap_totals(a: DataFrame, b: DataFrame, keys: Sequence[str], a_start: str, a_end: str, b_start: str,
                   b_end: str, sums: Mapping[str, str], count_out: str, bucket_seconds: int = DAY) -> DataFrame:
    """D5 without pairs: for each interval of ``a`` (a_start <= a_end), how many
    intervals of ``b`` with equal keys overlap it, and the sums (output name ->
    column) over them; NULL sums where there are none.

    An interval that doesn't overlap either starts after the end or ends before
    the start, so every total is a difference of two running totals: those of
    the starts up to ``a_end`` and of the ends before ``a_start``. Running totals
    are taken per (keys, time bucket), plus the totals of the buckets before. Each
    input is read once, an interval giving a row for each of its ends; these rows
    are staged, as the buckets and the running totals both need them."""
    names = list(sums)
    n = len(names) + 1
    zero = [F.lit(0).cast("long"), *[F.lit(0.0)] * len(names)]
    one = [F.lit(1).cast("long"), *[F.coalesce(F.col(sums[c]).cast("double"), F.lit(0.0)) for c in names]]

    def mark(t: str, order: int, which: str | None, starts: Sequence[Column], ends: Sequence[Column]) -> Column:
        return F.struct(F.col(t).alias("_t"), F.lit(order).alias("_o"), F.lit(which).cast("string").alias("_which"),
                        *[c.alias(f"_{k}{i}") for k, cells in (("s", starts), ("e", ends)) for i, c in enumerate(cells)])

    # at equal times: starts count for an interval's end, ends don't for its start
    steps = b.select(*keys, F.explode(F.array(mark(b_start, 0, None, one, zero), mark(b_end, 2, None, zero, one))).alias("_m"))
    asked = a.withColumn("_id", F.monotonically_increasing_id()).select(
        *keys, F.explode(F.array(mark(a_end, 1, "end", zero, zero), mark(a_start, 1, "start", zero, zero))).alias("_m"),
        "_id", *[F.col(c).alias(f"_a_{c}") for c in a.columns])
    rows = steps.unionByName(asked, allowMissingColumns=True)
    rows = stage(rows.select(*keys, "_m.*", *asked.columns[len(keys) + 1:]).withColumn("_b", time_bucket_index("_t", bucket_seconds)),
                 "overlap-marks")
    cells = [f"_{k}{i}" for k in "se" for i in range(n)]
    per = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_p{c}") for c in cells])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_p{c}").over(earlier), F.lit(0)).alias(f"_p{c}") for c in cells])
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    run = (join_same(rows, per, [*keys, "_b"]).withColumns({f"_r{c}": F.sum(c).over(inside) + F.col(f"_p{c}") for c in cells})
           .where(F.col("_which").isNotNull()))

    def total(i: int) -> Column:
        at_end = F.max(F.when(F.col("_which") == "end", F.col(f"_r_s{i}")))
        return at_end - F.max(F.when(F.col("_which") == "start", F.col(f"_r_e{i}")))

    own = [F.first(f"_a_{c}").alias(c) for c in a.columns]
    out = run.groupBy("_id").agg(*own, total(0).alias(count_out), *[total(i + 1).alias(c) for i, c in enumerate(names)]).drop("_id")
    return out.withColumns({c: F.when(F.col(count_out) > 0, F.col(c)) for c in names})
