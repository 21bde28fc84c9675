"""D4 as a sweep: points inside intervals of any length.

``interval_join`` writes an interval once for every time bucket that it covers, so
month-long intervals cost a row a day. Here points and interval starts are range
partitioned and sorted by (keys, time) together, each row once. A task sweeps its
partition in order with the set of intervals that are open; an interval that is
still open where its partition ends is carried to the later partitions that it
reaches, which the partitions' first places tell. A hot key is split over time
like any other stretch of rows.

Inside a task marks are taken in blocks. An interval that is open from a block's
first point to its last meets every point of it, so some points and some of these
intervals leave the task as two lists of one row; those that begin or end within the
block are compared with its points, and each point leaves with its list. The pairs,
which may be as many as points times intervals, are made by Spark from the lists and
never pass through Python. Spark's generated code holds all pairs of a row before it
hands on the first, so a row's lists are kept short.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlab.sources.files import stage

#: Marks that are compared with the open intervals at once.
BLOCK = 512
#: Points or intervals of one list at most (a row makes at most the square in pairs), and
#: intervals of one batch of lists or pairs of one batch of compared intervals.
LIST_ROWS, OUT_ROWS = 1 << 6, 1 << 16


def _marks(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_time: str, start: str, end: str) -> DataFrame:
    """Points and interval starts as rows of one table: two hashes of the keys, time
    in microseconds, kind (starts before points), end, and the row itself."""
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))

    def known(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64(F.lit(1), *keys).alias("_k1"), F.xxhash64(*keys, F.lit(2)).alias("_k2"))

    p = known(points).select("_k1", "_k2", micros(point_time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_e"),
                             F.struct(*points.columns).alias("_p"), F.lit(None).cast(_struct(intervals, keys)).alias("_i"))
    i = known(intervals.dropna(subset=[*keys, start, end])).select(
        "_k1", "_k2", micros(start).alias("_t"), F.lit(0).alias("_kind"), micros(end).alias("_e"),
        F.lit(None).cast(points.schema.simpleString()).alias("_p"), F.struct(*[c for c in intervals.columns if c not in keys]).alias("_i"))
    return p.unionByName(i.where("_e >= _t"))


def _struct(intervals: DataFrame, keys: Sequence[str]) -> str:
    return intervals.drop(*keys).schema.simpleString()


def sweep_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_time: str, start: str, end: str,
               how: str = "inner") -> DataFrame:
    """Rows of ``points`` whose ``point_time`` lies in [start, end] (both ends
    inclusive, TIMESTAMP_NTZ) of an interval with equal ``keys``; the columns and the
    rows are those of ``interval_join``. ``how`` is inner or left (points without an
    interval, a time or a key stay, with NULL interval columns)."""
    spark = points.sparkSession
    keys = list(keys)
    asked = points if how == "left" else points.dropna(subset=[*keys, point_time])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["_k1", "_k2", "_t", "_kind"]
    marks = _marks(asked, intervals, keys, point_time, start, end)
    # equal marks may be split over partitions too: a hash of the row is the last key
    ranged = marks.withColumn("_h", F.xxhash64("_p", "_i")).repartitionByRange(parts, *order, "_h").drop("_h")
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "sweep-marks")

    place = F.struct(*order)
    first = stage(ranged.groupBy("_part").agg(F.min(place).alias("a")).select(
        F.col("_part").alias("_to"), F.col("a._k1").alias("_k1"), F.col("a._k2").alias("_k2"), F.col("a._t").alias("_from")), "sweep-firsts")
    # what is open where a later partition of the same key begins; of a key only the partitions after its first begin with it
    carried = (ranged.where("_kind = 0").join(F.broadcast(first), ["_k1", "_k2"]).where("_to > _part and _from <= _e")
               .drop("_part", "_from").withColumnRenamed("_to", "_part"))
    every = ranged.unionByName(carried.select(*ranged.columns))
    # by range: hashes of as many numbers as partitions would meet in some and leave others empty
    swept = every.repartitionByRange(parts, "_part").sortWithinPartitions("_part", *order)

    names = [*points.columns, *[c for c in intervals.columns if c not in keys]]
    left, n_points = how == "left", len(points.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_rows, ends = None, None, np.zeros(0, np.int64)
        for batch in batches:
            k1, k2, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 7))
            t, e = (batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in (2, 4))
            timed = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            is_point = batch.column(3).to_numpy(zero_copy_only=False) == 1
            new = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (part[1:] != part[:-1]))) if len(t) else []
            for lo, hi in zip(new, [*new[1:], len(t)]):
                if (k1[lo], k2[lo], part[lo]) != key:
                    key, open_rows, ends = (k1[lo], k2[lo], part[lo]), None, np.zeros(0, np.int64)
                for a in range(lo, hi, BLOCK):
                    z = min(hi, a + BLOCK)
                    begun = np.flatnonzero(~is_point[a:z]) + a
                    if len(begun):
                        rows = batch.column(6).take(pa.array(begun))
                        open_rows = rows if open_rows is None else pa.concat_arrays([open_rows, rows])
                        starts = np.append(np.full(len(ends), np.iinfo(np.int64).min), t[begun])
                        ends = np.append(ends, e[begun])
                    else:
                        starts = np.full(len(ends), np.iinfo(np.int64).min)
                    asked_at = np.flatnonzero(is_point[a:z]) + a
                    if len(asked_at):
                        yield from meet(batch, asked_at, timed[asked_at], t[asked_at], starts, ends, open_rows)
                    keep = ends >= t[z - 1]
                    if len(ends) and not keep.all():
                        open_rows, ends = open_rows.take(pa.array(np.flatnonzero(keep))), ends[keep]

    def meet(batch: pa.RecordBatch, asked_at: np.ndarray, timed: np.ndarray, t: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             open_rows) -> Iterator[pa.RecordBatch]:
        points, met = batch.column(5).take(pa.array(asked_at)), np.zeros(len(asked_at), bool)
        times = t[timed]
        if len(times) and len(ends):
            through = (starts <= times.min()) & (ends >= times.max())
            whole, some = np.flatnonzero(through), np.flatnonzero(~through & (starts <= times.max()) & (ends >= times.min()))
            with_time = points.filter(pa.array(timed))
            for j in range(0, len(whole), OUT_ROWS):
                yield from tiles(with_time, open_rows.take(pa.array(whole[j:j + OUT_ROWS])))
            met |= timed & bool(len(whole))
            for j in range(0, len(some), LIST_ROWS ** 2):
                near = some[j:j + LIST_ROWS ** 2]
                step = max(1, OUT_ROWS // len(near))
                for k in range(0, len(t), step):
                    inside = (starts[near][None] <= t[k:k + step, None]) & (t[k:k + step, None] <= ends[near][None]) & timed[k:k + step, None]
                    found = inside.sum(1)
                    which = np.flatnonzero(found)
                    met[k + which] = True
                    if len(which):
                        rows = open_rows.take(pa.array(near[np.nonzero(inside)[1]]))
                        yield lists(points.take(pa.array(k + which)), np.arange(len(which) + 1), rows, np.append(0, np.cumsum(found[which])))
        if left and not met.all():
            alone = points.filter(pa.array(~met))
            yield lists(alone, [0, len(alone)], pa.nulls(1, batch.column(6).type), [0, 1])

    def tiles(points, intervals) -> Iterator[pa.RecordBatch]:
        cuts = np.append(np.arange(0, len(intervals), LIST_ROWS), len(intervals))
        for k in range(0, len(points), LIST_ROWS):
            some = np.arange(k, min(k + LIST_ROWS, len(points)))
            yield lists(points.take(pa.array(np.tile(some, len(cuts) - 1))), len(some) * np.arange(len(cuts)), intervals, cuts)

    def lists(points, point_offsets, intervals, interval_offsets) -> pa.RecordBatch:
        columns = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((point_offsets, points), (interval_offsets, intervals))]
        return pa.record_batch(columns, names=["_p", "_i"])

    cols = ["_k1", "_k2", "_t", "_kind", "_e", "_p", "_i", "_part"]
    kinds = f"_p array<{points.schema.simpleString()}>, _i array<{_struct(intervals, keys)}>"
    pairs = swept.select(*cols).mapInArrow(run, kinds).select(F.explode("_p").alias("_p"), "_i")
    # a point's fields are read once, not for each of its pairs
    pairs = pairs.select(*[F.col("_p")[c].alias(f"_p{n}") for n, c in enumerate(points.columns)], "_i").select("*", F.explode("_i").alias("_j"))
    return pairs.select(*[F.col(f"_p{n}").alias(c) for n, c in enumerate(points.columns)], *[F.col("_j")[c].alias(c) for c in names[n_points:]])
