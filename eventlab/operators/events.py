"""Time-series and event operators.

Spark has no row order, so every operator takes an explicit total order
(``order``) inside each series (``keys``). Windows that share
``partitionBy(keys).orderBy(order)`` are evaluated by one sort; the run-length
window partitions by ``keys + run id`` and is satisfied by the same hash
partitioning (a sub-clustering), so it adds a sort but no shuffle.

Scale note: the windows hold one *series period* per task (e.g. one site and
one week of a regular grid). The grid bounds that size: a period of P seconds
at step s has at most P/s rows, whatever the raw volume. Raw rows are reduced
to the grid by a partial (map-side) aggregate first, so a hot key with a third
of all raw rows still produces bounded window partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.functions.columns import duration_minutes, floor_time, time_bucket_index
from eventlab.operators.keys import join_same


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def change_start(flag: Column, w) -> Column:
    """1 where a new run begins. As in R's ``rle``: every NULL is its own run
    and a NULL neighbour breaks a run."""
    prev = F.lag(flag).over(w)
    return F.when(flag.isNull() | prev.isNull() | (flag != prev), 1).otherwise(0)


def run_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str,
            out: str = "run_id") -> DataFrame:
    """Number the runs of equal values from 1 within each series."""
    w = _w(keys, order)
    return df.withColumn(out, F.sum(change_start(F.col(flag), w))
                         .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str,
                out: str = "run_length", run_col: str = "run_id") -> DataFrame:
    """Length of the run each row is in."""
    with_ids = df if run_col in df.columns else run_ids(df, keys, order, flag, run_col)
    return with_ids.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys, run_col)))


def segment_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   min_gap: int, flag_out: str = "eventflag", id_out: str = "eventid",
                   keep_helpers: bool = False, trim: bool = False) -> DataFrame:
    """wet/dry event segmentation with a minimum dry gap of ``min_gap`` rows.

    * wet flag: value > 0 (NULL stays NULL, and is its own run);
    * a dry run shorter than ``min_gap`` rows is bridged into the event (E3);
    * dry rows among the first ``min_gap - 1`` of the series are never bridged
      (E4, no event starts from the leading rows);
    * ``eventid`` numbers the runs of the event flag (wet and dry runs share
      one numbering, from 1 per series).
    A trailing dry run shorter than ``min_gap`` stays inside the last event,
    as in the study; ``trim=True`` leaves it out (flag 0).
    """
    w = _w(keys, order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wet = (F.col(value) > 0).cast("int")
    step1 = (df.withColumn("_wet", wet)
             .withColumn("_rn", F.row_number().over(w))
             .withColumn("_run", F.sum(change_start(F.col("_wet"), w)).over(running)))
    step2 = step1.withColumn("_runlen", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    flag = (F.when(F.col("_wet").isNull(), F.lit(None).cast("int"))
            .when((F.col("_rn") < min_gap) & (F.col("_wet") == 0), F.lit(0))
            .when(F.col("_wet") == 1, F.lit(1))
            .when(F.col("_runlen") < min_gap, F.lit(1))
            .otherwise(F.lit(0)))
    if trim:
        last_run = F.max("_run").over(Window.partitionBy(*keys))
        flag = F.when((F.col("_wet") == 0) & (F.col("_run") == last_run), F.lit(0)).otherwise(flag)
    step3 = step2.withColumn(flag_out, flag)
    out = step3.withColumn(id_out, F.sum(change_start(F.col(flag_out), w)).over(running))
    if not keep_helpers:
        out = out.drop("_wet", "_rn", "_run", "_runlen")
    return out


def strict_sum(c: str | Column) -> Column:
    """sum() that is NULL when any input is NULL (R's sum without na.rm)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.count_if(x.isNull()) > 0, F.lit(None)).otherwise(F.sum(x))


def summarize_events(flags: DataFrame, keys: Sequence[str], value: str, time_col: str,
                     total_name: str, duration_name: str, flag_col: str = "eventflag",
                     id_col: str = "eventid", na: str = "propagate",
                     plus_minutes: float = 1.0) -> DataFrame:
    """One row per event: total, first and last time, inclusive duration."""
    total = strict_sum(value) if na == "propagate" else F.sum(value)
    return (flags.where(F.col(flag_col) == 1)
            .groupBy(*keys, id_col)
            .agg(total.alias(total_name),
                 F.min(time_col).alias("eventStart"),
                 F.max(time_col).alias("eventEnd"))
            .withColumn(duration_name, duration_minutes("eventStart", "eventEnd", plus_minutes)))


def number_events(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  out: str) -> DataFrame:
    """Renumber kept events 1..n per group in ``order``."""
    return df.withColumn(out, F.row_number().over(_w(keys, order)))


def _gap_buckets(df: DataFrame, keys: Sequence[str], time_col: str, gap_minutes: float,
                 aggs: Sequence[Column] = ()) -> DataFrame:
    """Rows reduced to (keys, bucket of width ``gap``) with first/last time
    (map-side partial aggregate), then numbered into gap events by a window
    over the buckets. Rows inside one bucket are closer than the gap, so
    they always share an event; only bucket edges need the gap test."""
    width = max(1, int(gap_minutes * 60))
    b = (df.withColumn("_gb", time_bucket_index(time_col, width))
         .groupBy(*keys, "_gb")
         .agg(F.min(time_col).alias("_t0"), F.max(time_col).alias("_t1"), *aggs))
    w = Window.partitionBy(*keys).orderBy("_gb")
    gap = F.timestamp_diff("MICROSECOND", F.lag("_t1").over(w), F.col("_t0")) / F.lit(60_000_000.0)
    new = F.when(gap > gap_minutes, 1).otherwise(0)
    return b.withColumn("_ev", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding,
                                                             Window.currentRow)))


def gap_events(df: DataFrame, keys: Sequence[str], time_col: str, gap_minutes: float,
               out: str = "event", tiebreak: Sequence[str] = ()) -> DataFrame:
    """``c(0, cumsum(diff(t) > gap))`` on every row -- a new event when
    the time since the previous row exceeds ``gap_minutes`` (a gap of
    exactly ``gap`` stays). The window runs over gap-width buckets, not raw
    rows (bounded per series however hot the key); rows get their event
    from their bucket by an equi join on (keys, bucket)."""
    width = max(1, int(gap_minutes * 60))
    ev = _gap_buckets(df, keys, time_col, gap_minutes).select(*keys, "_gb", F.col("_ev").alias(out))
    return (df.withColumn("_gb", time_bucket_index(time_col, width))
            .transform(join_same, ev, [*keys, "_gb"]).drop("_gb"))


def gap_event_summary(df: DataFrame, keys: Sequence[str], time_col: str, gap_minutes: float,
                      value: str, out: str = "event") -> DataFrame:
    """E8 summary: per gap event, row count, total, first and last time --
    computed from bucket statistics only (no row-level window or join)."""
    b = _gap_buckets(df, keys, time_col, gap_minutes,
                     [F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s")])
    return (b.groupBy(*keys, F.col("_ev").alias(out))
            .agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"),
                 F.min("_t0").alias("eventStart"), F.max("_t1").alias("eventEnd")))


def session_events(df: DataFrame, keys: Sequence[str], time_col: str, gap_minutes: int,
                   aggs: Sequence[Column]) -> DataFrame:
    """E8 summary form with the built-in ``session_window`` (gap g keeps rows
    whose distance is <= g in one session)."""
    sw = F.session_window(F.col(time_col).cast("timestamp"), f"{int(gap_minutes)} minutes")
    return df.groupBy(*keys, sw.alias("session")).agg(*aggs)


def threshold_sweep(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                    thresholds: Sequence[int], k_col: str = "K") -> DataFrame:
    """The same segmentation for several gap thresholds in one plan.

    Wet flags, run ids and run lengths do not depend on the threshold, so they
    are computed once per series; only then is each row emitted once per
    threshold (``explode`` of a bounded literal list, no join). The final
    window partitions by (keys, K), which the hash partitioning on keys
    already satisfies: no second shuffle.
    """
    w = _w(keys, order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (df.withColumn("_wet", (F.col(value) > 0).cast("int"))
         .withColumn("_rn", F.row_number().over(w))
         .withColumn("_run", F.sum(change_start(F.col("_wet"), w)).over(running)))
    s = s.withColumn("_runlen", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    s = s.withColumn(k_col, F.explode(F.array(*[F.lit(int(k)) for k in thresholds])))
    K = F.col(k_col)
    flag = (F.when(F.col("_wet").isNull(), F.lit(None).cast("int"))
            .when((F.col("_rn") < K) & (F.col("_wet") == 0), F.lit(0))
            .when(F.col("_wet") == 1, F.lit(1))
            .when(F.col("_runlen") < K, F.lit(1))
            .otherwise(F.lit(0)))
    s = s.withColumn("eventflag", flag)
    wk = _w([*keys, k_col], order)
    s = s.withColumn("eventid", F.sum(change_start(F.col("eventflag"), wk))
                     .over(wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.drop("_wet", "_rn", "_run", "_runlen")


def expand_grid(df: DataFrame, start: str, end: str, step_seconds: int = 60,
                out: str = "date_time") -> DataFrame:
    """One row per step from start to end inclusive (``seq(by='mins')``)."""
    return df.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end),
                                                   F.make_dt_interval(secs=F.lit(step_seconds)))))


def window_per_key(df: DataFrame, keys: Sequence[str], time_col: str, value: str,
                   total_name: str = "precipitation", duration_name: str = "rain_time",
                   na: str = "propagate") -> DataFrame:
    """first/last timestamp, total and inclusive duration per key."""
    total = strict_sum(value) if na == "propagate" else F.sum(value)
    return (df.groupBy(*keys)
            .agg(F.min(time_col).alias("sampStart"), F.max(time_col).alias("sampEnd"),
                 total.alias(total_name))
            .withColumn(duration_name, duration_minutes("sampStart", "sampEnd")))


def daily_totals(df: DataFrame, keys: Sequence[str], time_col: str, value: str,
                 scale: float = 1.0, out: str = "daily") -> DataFrame:
    """Per key, year and day of year, the scaled sum."""
    return (df.groupBy(*keys, F.year(time_col).alias("year"),
                       F.dayofyear(time_col).alias("doy"))
            .agg((F.sum(value) * F.lit(scale)).alias(out)))


def total_on_rows(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Group total repeated on every row (no collapse). The total is a
    partial aggregate joined back, so a hot group is not one task's window; AQE
    splits its rows in the join. NULL keys form a group, as in a window."""
    return join_same(df, df.groupBy(*keys).agg(F.sum(value).alias(out)), keys)


def regular_grid(df: DataFrame, keys: Sequence[str], time_col: str,
                 values: dict[str, Column], step_seconds: int,
                 out_time: str = "date_time", chunk_seconds: int | None = None,
                 missing: dict[str, Column] | None = None) -> DataFrame:
    """Make an irregular series regular, zero-filling empty steps.

    1. floor times to the step and sum each value per (keys, step): a hash
       aggregate with map-side partial sums, so hot keys are pre-reduced;
    2. per series, ``lead`` gives the next occupied step, and each occupied
       step emits itself plus zero rows up to the next one (``sequence``).
    One scan, no join and no spine table: the only shuffles are the
    aggregate's and one of the (compact) step sums by series key -- the same
    partitioning the segmentation windows need afterwards.
    ``values`` maps output names to per-row value expressions (e.g. a
    ``when(type in ..., value)``); a step without readings of it is 0.
    ``missing`` maps output names to a per-row condition that marks a missing
    reading; a step with such a row keeps NULL (a run of its own, which splits
    events), whatever else it holds.
    With ``chunk_seconds`` the gap-filling window runs per (keys, chunk),
    for series without a period reset; the step sums are then staged once in
    the shared folder (they feed two branches).
    """
    step = F.make_dt_interval(secs=F.lit(step_seconds))
    binned = (df.withColumn(out_time, floor_time(time_col, step_seconds))
              .groupBy(*keys, out_time)
              .agg(*[F.sum(expr).alias(name) for name, expr in values.items()],
                   *[F.max(F.coalesce(cond, F.lit(False))).alias(f"_missing_{name}")
                     for name, cond in (missing or {}).items()]))
    if chunk_seconds is None:
        w = Window.partitionBy(*keys).orderBy(out_time)
        nxt = binned.withColumn("_next", F.lead(out_time).over(w))
    else:
        # long series: next occupied step inside the chunk, else the first
        # step of the next non-empty chunk (from a one-row-per-chunk table)
        # the step sums feed two branches (rows and the chunk table); stage
        # them once (compact) so the raw table is scanned once
        from eventlab.sources.files import stage
        binned = stage(binned, "grid-steps").withColumn(
            "_chunk", time_bucket_index(out_time, chunk_seconds))
        w = Window.partitionBy(*keys, "_chunk").orderBy(out_time)
        firsts = binned.groupBy(*keys, "_chunk").agg(F.min(out_time).alias("_first"))
        firsts = firsts.withColumn("_next_chunk", F.lead("_first").over(
            Window.partitionBy(*keys).orderBy("_chunk"))).drop("_first")
        nxt = (binned.withColumn("_next", F.lead(out_time).over(w))
               .transform(join_same, firsts, [*keys, "_chunk"])
               .withColumn("_next", F.coalesce("_next", "_next_chunk"))
               .drop("_chunk", "_next_chunk"))
    last = F.coalesce(F.timestamp_add("SECOND", F.lit(-step_seconds), F.col("_next")),
                      F.col(out_time))
    spread = nxt.withColumn("_t", F.explode(F.sequence(F.col(out_time), last, step)))
    first = F.col("_t") == F.col(out_time)

    def at_step(name: str) -> Column:
        known = F.when(first, F.coalesce(F.col(name), F.lit(0.0))).otherwise(F.lit(0.0))
        if name not in (missing or {}):
            return known.alias(name)
        return F.when(first & F.col(f"_missing_{name}"), F.lit(None)).otherwise(known).alias(name)

    return spread.select(*keys, F.col("_t").alias(out_time), *[at_step(n) for n in values])


def _chunk_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str,
                prefix: str) -> tuple[DataFrame, DataFrame]:
    """Local runs of ``flag`` inside each (keys, _chunk) and the per-chunk
    summary: row count, run count, first/last flag and run lengths."""
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = F.col(flag)
    loc = (rows.withColumn(f"{prefix}rn", F.row_number().over(w))
           .withColumn(f"{prefix}run", F.sum(change_start(f, w)).over(running)))
    loc = loc.withColumn(f"{prefix}len", F.count(F.lit(1)).over(
        Window.partitionBy(*keys, "_chunk", f"{prefix}run")))
    rn, run, ln = F.col(f"{prefix}rn"), F.col(f"{prefix}run"), F.col(f"{prefix}len")
    summary = loc.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias(f"{prefix}cnt"), F.max(run).alias(f"{prefix}nruns"),
        F.min_by(f, rn).alias(f"{prefix}first"), F.max_by(f, rn).alias(f"{prefix}last"),
        F.min_by(ln, rn).alias(f"{prefix}first_len"), F.max_by(ln, rn).alias(f"{prefix}last_len"))
    return loc, summary


def _stitch(summary: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Per chunk (a small table): rows before it, whether its first run
    continues the previous chunk's last run, and the number of global runs
    that start before it."""
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first, prev_last = F.col(f"{prefix}first"), F.lag(f"{prefix}last").over(w)
    cont = F.when(first.isNotNull() & prev_last.isNotNull() & (first == prev_last), 1).otherwise(0)
    s = summary.withColumn(f"{prefix}cont", cont)
    return (s.withColumn(f"{prefix}offset", F.coalesce(F.sum(f"{prefix}cnt").over(before), F.lit(0)))
            .withColumn(f"{prefix}runs_before", F.coalesce(
                F.sum(F.col(f"{prefix}nruns") - F.col(f"{prefix}cont")).over(before), F.lit(0))))


def segment_events_chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                           min_gap: int, chunk: Column, flag_out: str = "eventflag",
                           id_out: str = "eventid") -> DataFrame:
    """E3-E5 exactly as ``segment_events``, for series too long for one task.

    ``chunk`` is a non-decreasing function of the order (e.g. the day of the
    timestamp). Windows run per (keys, chunk) only; runs that cross chunk
    edges are stitched through per-chunk summaries (one row per chunk:
    counts, first/last flag, continuation), so a series holding a third of
    all rows is spread over its chunks. Global row numbers, run lengths and
    event ids equal the unchunked ones (tested against it)."""
    base = df.withColumn("_chunk", chunk).withColumn("_wet", (F.col(value) > 0).cast("int"))
    loc, summ = _chunk_runs(base, keys, order, "_wet", "w_")
    st = _stitch(summ, keys, "w_")
    # global ids of the first and last local run of each chunk, and the
    # pieces of runs that touch chunk edges (head / tail), summed per run
    head = F.col("w_runs_before") + 1 - F.col("w_cont")
    tail = F.col("w_runs_before") + F.col("w_nruns") - F.col("w_cont")
    pieces = st.select(*keys, "_chunk", head.alias("_gid"), F.col("w_first_len").alias("_len")).unionByName(
        st.where(F.col("w_nruns") > 1).select(*keys, "_chunk", tail.alias("_gid"),
                                              F.col("w_last_len").alias("_len")))
    totals = pieces.groupBy(*keys, "_gid").agg(F.sum("_len").alias("_total"))
    st = (st.withColumn("_hg", head).withColumn("_tg", tail)
          .transform(join_same, totals.select(*keys, F.col("_gid").alias("_hg"), F.col("_total").alias("_head_total")),
                     [*keys, "_hg"], "left")
          .transform(join_same, totals.select(*keys, F.col("_gid").alias("_tg"), F.col("_total").alias("_tail_total")),
                     [*keys, "_tg"], "left")
          .select(*keys, "_chunk", "w_offset", "w_nruns", "_head_total", "_tail_total"))
    rows = join_same(loc, st, [*keys, "_chunk"])
    runlen = (F.when(F.col("w_run") == 1, F.col("_head_total"))
              .when(F.col("w_run") == F.col("w_nruns"), F.col("_tail_total"))
              .otherwise(F.col("w_len")))
    grn = F.col("w_offset") + F.col("w_rn")
    flag = (F.when(F.col("_wet").isNull(), F.lit(None).cast("int"))
            .when((grn < min_gap) & (F.col("_wet") == 0), F.lit(0))
            .when(F.col("_wet") == 1, F.lit(1))
            .when(runlen < min_gap, F.lit(1))
            .otherwise(F.lit(0)))
    rows = rows.withColumn(flag_out, flag).select(*df.columns, "_chunk", flag_out)
    floc, fsumm = _chunk_runs(rows, keys, order, flag_out, "f_")
    fst = _stitch(fsumm, keys, "f_").select(*keys, "_chunk", "f_runs_before", "f_cont")
    out = join_same(floc, fst, [*keys, "_chunk"]).withColumn(
        id_out, (F.col("f_runs_before") + F.col("f_run") - F.col("f_cont")).cast("long"))
    return out.select(*df.columns, flag_out, id_out)


def window_primitives(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      value: str) -> DataFrame:
    """Row number, difference to the previous row, running sum, and the
    first / last value of the series, on one shared window sort."""
    w = _w(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(value)
    return df.withColumns({
        "rn": F.row_number().over(w).cast("long"),
        "diff": x - F.lag(x).over(w),
        "cumsum": F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "first": F.first(x).over(whole),
        "last": F.last(x).over(whole),
    })


def assert_total_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
    """Raise if ``order`` is not a total order inside each series (ties would
    make run numbering depend on the physical order). One aggregate pass."""
    dup = (df.groupBy(*keys, *order).count().where(F.col("count") > 1).limit(1).collect())
    if dup:
        raise ValueError(f"order {list(order)} has ties within {list(keys)}: {dup[0].asDict()}")
