"""Event segmentation on run tables (E3-E6, E15 without a grid).

A regular series that is mostly dry needs no row for each dry step: a dry run
is the difference of two step numbers. The data structure is the run table, one
row for each run of the event flag: (keys, eventid, eventflag, run_start,
n_steps, total). It equals segmentation of the zero-filled grid, run for run,
and its size follows the wet steps, however long the dry ones are.

``occupied_steps`` reduces raw rows to sums per step (a partial aggregate).
Every wet or missing step then looks back to the wet or missing step before it;
the dry run between them is cut where the leading rows end (those are never
bridged) and flagged by its length. So a step knows the runs that it closes and
opens, and a running count numbers them: one window sort per series.

Series without a period reset give ``chunk_steps``: windows then hold one chunk of
a series, and what crosses a chunk's edge (the first step, the last wet step and
the number of runs before) comes from a table with one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.functions.columns import duration_minutes, time_bucket_index
from eventlab.operators.keys import join_same
from eventlab.sources.files import stage

STEP = "_step"


def occupied_steps(df: DataFrame, keys: Sequence[str], time_col: str, values: Mapping[str, Column],
                   step_seconds: int, missing: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each step of a series that has raw rows: its number since the
    epoch (``_step``) and the sum of each value, 0 where the step has no reading
    of it, NULL where a row satisfies its ``missing`` condition."""

    def total(name: str, x: Column) -> Column:
        known = F.coalesce(F.sum(x), F.lit(0.0))
        if name not in (missing or {}):
            return known.alias(name)
        lost = F.max(F.coalesce(missing[name], F.lit(False)))
        return F.when(~lost, known).alias(name)

    step = time_bucket_index(time_col, step_seconds).alias(STEP)
    return df.groupBy(*keys, step).agg(*[total(n, x) for n, x in values.items()])


def step_time(step: str | Column, step_seconds: int) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", (F.col(step) if isinstance(step, str) else step) * step_seconds, epoch)


def _linked(steps: DataFrame, keys: Sequence[str], chunk_steps: int | None) -> DataFrame:
    """The wet, missing and last steps of every series, with the first step of the
    series (_t0), the wet or missing step before (_before: step, flag) and, for
    chunked series, the chunk."""
    s = F.col(STEP)
    marked = F.when(F.col("_f") != 0, F.struct(s.alias("step"), F.col("_f").alias("flag")))
    if chunk_steps is None:
        w = Window.partitionBy(*keys).orderBy(STEP)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = steps.withColumns({"_t0": F.first(STEP).over(w), "_last": F.lead(STEP).over(w).isNull(),
                                  "_before": F.last(marked, ignorenulls=True).over(earlier)})
    else:
        steps = steps.withColumn("_chunk", F.floor(s / chunk_steps))
        w = Window.partitionBy(*keys, "_chunk").orderBy(STEP)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        per = steps.groupBy(*keys, "_chunk").agg(F.min(STEP).alias("_first"), F.max(marked).alias("_m"))
        c = Window.partitionBy(*keys).orderBy("_chunk")
        per = per.select(*keys, "_chunk", F.first("_first").over(c).alias("_t0"), F.lead("_chunk").over(c).isNull().alias("_end"),
                         F.last("_m", ignorenulls=True).over(c.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        rows = steps.withColumns({"_last": F.lead(STEP).over(w).isNull(), "_before": F.last(marked, ignorenulls=True).over(earlier)})
        rows = join_same(rows, per, [*keys, "_chunk"]).withColumns(
            {"_before": F.coalesce("_before", "_carried"), "_last": F.col("_last") & F.col("_end")}).drop("_carried", "_end")
    return rows.where((F.col("_f") != 0) | F.col("_last"))


def run_table(steps: DataFrame, keys: Sequence[str], value: str, step_seconds: int, min_gap: int,
              chunk_steps: int | None = None, trim: bool = False, events_only: bool = False) -> DataFrame:
    """The runs of the event flag of every series: (keys, eventid, eventflag,
    run_start, n_steps, total). The rules are those of ``segment_events`` on the
    zero-filled grid from the first to the last occupied step: wet steps are 1,
    missing ones NULL (each a run of its own), a dry run shorter than ``min_gap``
    steps is 1, but dry steps among the first ``min_gap - 1`` of the series are 0;
    ``trim`` leaves a trailing dry run out. ``events_only`` keeps the runs that are
    1 (their numbers stay those among all runs)."""
    keys = list(keys)
    x = F.col(value)
    flagged = steps.select(*keys, STEP, x.cast("double").alias("_x"),
                           F.when(x.isNull(), -1).when(x > 0, 1).otherwise(0).alias("_f"))
    if chunk_steps is not None:
        flagged = stage(flagged, "run-steps")
    rows = _linked(flagged, keys, chunk_steps)

    own = F.col("_f") != 0
    begin = F.coalesce(F.col("_before.step") + 1, F.col("_t0"))
    length = F.when(own, F.col(STEP) - 1).otherwise(F.col(STEP)) - begin + 1
    rows = rows.withColumns({"_begin": begin, "_dry": length, "_p": F.coalesce(F.col("_before.flag"), F.lit(-2))})
    lead = F.greatest(F.lit(0), F.least(F.col("_dry"), F.lit(min_gap - 1) - (F.col("_begin") - F.col("_t0"))))
    bridged = (F.col("_dry") < min_gap) & (own if trim else F.lit(True))
    rows = rows.withColumns({"_lead": lead, "_g": F.when(bridged, 1).otherwise(0)})
    rows = rows.withColumn("_rest", F.col("_dry") - F.col("_lead"))
    # how many runs begin with the unbridged leading steps, the other dry steps and the step itself
    before_rest = F.when(F.col("_lead") > 0, 0).otherwise(F.col("_p"))
    before_own = F.when(F.col("_rest") > 0, F.col("_g")).otherwise(before_rest)
    rows = rows.withColumns({
        "_n0": (F.col("_lead") > 0).cast("long"),
        "_n1": ((F.col("_rest") > 0) & (F.col("_g") != before_rest)).cast("long"),
        "_n2": (own & ((F.col("_f") == -1) | (F.col("_f") != before_own))).cast("long")})
    begun = F.col("_n0") + F.col("_n1") + F.col("_n2")

    if chunk_steps is None:
        w = Window.partitionBy(*keys).orderBy(STEP).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_id", F.sum(begun).over(w))
    else:
        rows = stage(rows.drop("_before"), "run-links")
        w = Window.partitionBy(*keys, "_chunk").orderBy(STEP).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        per = rows.groupBy(*keys, "_chunk").agg(F.sum(begun).alias("_k"))
        per = per.select(*keys, "_chunk", F.coalesce(F.sum("_k").over(c), F.lit(0)).alias("_offset"))
        rows = join_same(rows.withColumn("_id", F.sum(begun).over(w)), per, [*keys, "_chunk"])
        rows = rows.withColumn("_id", F.col("_id") + F.col("_offset"))

    def piece(eventid: Column, flag: Column, at: Column, n: Column, total: Column) -> Column:
        return F.struct(eventid.alias("eventid"), flag.cast("int").alias("flag"), at.alias("at"), n.cast("long").alias("n"), total.alias("x"))

    last = F.col("_id")
    pieces = F.array(piece(last - F.col("_n1") - F.col("_n2"), F.lit(0), F.col("_begin"), F.col("_lead"), F.lit(0.0)),
                     piece(last - F.col("_n2"), F.col("_g"), F.col("_begin") + F.col("_lead"), F.col("_rest"), F.lit(0.0)),
                     piece(last, F.col("_f"), F.col(STEP), own.cast("int"), F.col("_x")))
    wanted = (lambda p: (p["n"] > 0) & (p["flag"] == 1)) if events_only else (lambda p: p["n"] > 0)
    parts = rows.select(*keys, F.explode(F.filter(pieces, wanted)).alias("_p"))
    runs = parts.groupBy(*keys, F.col("_p.eventid").alias("eventid")).agg(
        F.max("_p.flag").alias("_flag"), F.min("_p.at").alias("_at"), F.sum("_p.n").alias("n_steps"), F.sum("_p.x").alias("total"))
    return runs.select(*keys, "eventid", F.when(F.col("_flag") >= 0, F.col("_flag")).alias("eventflag"),
                       step_time("_at", step_seconds).alias("run_start"), "n_steps", "total")


def run_events(runs: DataFrame, keys: Sequence[str], step_seconds: int, total_name: str, duration_name: str,
               plus_minutes: float = 1.0) -> DataFrame:
    """E6 on a run table: total, first and last time and inclusive duration of every
    event (runs of flag 1)."""
    ev = runs.where(F.col("eventflag") == 1)
    end = F.timestamp_add("SECOND", (F.col("n_steps") - 1) * step_seconds, F.col("run_start"))
    return ev.select(*keys, "eventid", F.col("total").alias(total_name), F.col("run_start").alias("eventStart"),
                     end.alias("eventEnd")).withColumn(duration_name, duration_minutes("eventStart", "eventEnd", plus_minutes))
