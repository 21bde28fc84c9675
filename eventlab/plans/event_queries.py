"""Event queries on the ``events`` table (E, D, F1/F7, C4/C5, B6/B7).

Shapes: see ``shapes.py``. Series keys are (SiteID, Treatment, Year); the
grid step is 15 minutes, so K steps of dry weather end an event.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.functions.columns import M_TO_MM, rate
from eventlab.functions.distributions import t_quantile_975_sql
from eventlab.operators.events import (
    daily_totals,
    expand_grid,
    gap_event_summary,
    gap_events,
    number_events,
    regular_grid,
    run_lengths,
    segment_events,
    segment_events_chunked,
    summarize_events,
    threshold_sweep,
    total_on_rows,
    window_primitives,
    window_per_key,
)
from eventlab.operators.filters import above, apply_overrides, keep_first
from eventlab.operators.joins import interval_join, overlap_totals
from eventlab.operators.runs import occupied_steps, run_events, run_table
from eventlab.operators.summary import mean_ci
from eventlab.operators.sweep import sweep_join
from eventlab.plans.registry import register, with_ctes
from eventlab.sources.files import stage
from eventlab.plans.shapes import (
    GRID_SECONDS,
    RAIN_TYPES,
    SQL_GRID,
    SQL_KEYED,
    SQL_SAMPLES,
    keyed_events,
    samples,
    segment_sql,
    series_grid,
    series_steps,
    sql_grid,
)
from eventlab.functions.columns import time_bucket_index

# Fixed study parameters, re-expressed for the 15-minute driver grid.
SERIES_KEYS = ["SiteID", "Treatment", "Year"]
KEYS_SQL = "SiteID, Treatment, Year"
RAIN_GAP_STEPS = 4          # dry steps that end a rain event (1 h at 15 min)
FLOW_GAP_STEPS = 8          # dry steps that end a runoff event (2 h)
SWEEP_STEPS = (2, 4, 8, 12)  # sensitivity sweep of the rain gap
RAIN_MIN_DEPTH = 0.00254    # events with less total rain are dropped
DETECTION_LIMIT = 3.977139e-6
GAP_MINUTES = 60            # gap-based events: a new event after > 60 min
# Hand edits of runoff events: (SiteID, Year, ro_event) -> new flow_time.
RUNOFF_OVERRIDES = [("S1", datetime(2024, 1, 8), 3, 240.0), ("S2", datetime(2024, 1, 15), 1, 60.0)]
# Exclusion list (SiteID, Year week); None is a wildcard.
EXCLUSIONS = [("S7", None), ("S5", datetime(2024, 1, 8)), ("S6", datetime(2024, 1, 1))]
EXCLUSIONS_SQL = ("NOT (SiteID = 'S7') AND NOT (SiteID = 'S5' AND Year = TIMESTAMP '2024-01-08')"
                  " AND NOT (SiteID = 'S6' AND Year = TIMESTAMP '2024-01-01')")
DURATION_SQL = "date_diff('microsecond', {a}, {b}) / 60000000.0 + 1.0"


def ci_sql(src: str, by: str, value: str) -> list[str]:
    """DuckDB CTEs of ``summary.mean_ci``; final rows in ``ci1``."""
    q = t_quantile_975_sql("(n - 1)")
    return [f"ci0 AS (SELECT {by}, count({value}) AS n, avg({value}) AS mean, "
            f"stddev_samp({value}) AS sd FROM {src} GROUP BY {by})",
            f"ci1 AS (SELECT *, sd / sqrt(n) AS se, {q} AS _q FROM ci0)"]


CI_SELECT = "SELECT {by}, n, mean, sd, se, mean - _q * se AS lb, mean + _q * se AS ub FROM ci1"


# ------------------------------------------------------------------ builders

def rain_grid(spark, sf_dir, grid: DataFrame | None = None) -> DataFrame:
    g = grid if grid is not None else series_grid(spark, sf_dir, exclusions=EXCLUSIONS)
    return g.select(*SERIES_KEYS, "date_time", "rain")


def event_steps(spark, sf_dir, steps: DataFrame | None = None, exclusions=EXCLUSIONS) -> DataFrame:
    return steps if steps is not None else series_steps(spark, sf_dir, exclusions=exclusions)


def shared_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Occupied steps and samples staged once in the shared folder for queries
    that use both the rain and the runoff branch: the raw table is scanned once
    per input instead of once per branch (column pruning makes the branches
    differ, so Spark could not reuse their exchanges)."""
    return stage(event_steps(spark, sf_dir), "steps"), stage(samples(spark, sf_dir), "samples")


def rain_events_df(spark: SparkSession, sf_dir: str, gap: int = RAIN_GAP_STEPS,
                   steps: DataFrame | None = None, exclusions=EXCLUSIONS) -> DataFrame:
    """Rain events: run table (E5), summary (E6), exclusion list (C2, on
    partition keys, so applied before the windows), minimum depth (C4),
    numbering per site-period (E7), units and rate (B6, B7)."""
    runs = run_table(event_steps(spark, sf_dir, steps, exclusions), SERIES_KEYS, "rain", GRID_SECONDS, gap, events_only=True)
    ev = run_events(runs, SERIES_KEYS, GRID_SECONDS, "precipitation", "rain_time")
    ev = above(ev, "precipitation", RAIN_MIN_DEPTH)
    ev = number_events(ev, ["SiteID", "Year"], ["eventStart", "eventEnd", "Treatment"], "rf_event")
    return ev.select(
        "Year", "SiteID", "Treatment", F.col("rf_event").cast("long").alias("rf_event"),
        (F.col("precipitation") * M_TO_MM).alias("rain_mm"),
        (F.col("rain_time") / 60).alias("rain_hr"),
        rate(F.col("precipitation") * M_TO_MM, F.col("rain_time") / 60).alias("rf_rate"),
        "eventStart", "eventEnd")


def rain_ctes(gap: int = RAIN_GAP_STEPS, exclusions: str = EXCLUSIONS_SQL) -> list[str]:
    return [SQL_GRID,
            f"src AS (SELECT SiteID, Treatment, Year, date_time, rain FROM grid WHERE {exclusions})",
            segment_sql("src", KEYS_SQL, "date_time", "rain", gap, "g"),
            "rev AS (SELECT SiteID, Treatment, Year, eventid, sum(rain) AS precipitation, "
            "min(date_time) AS eventStart, max(date_time) AS eventEnd "
            "FROM g6 WHERE eventflag = 1 GROUP BY ALL)",
            f"kept AS (SELECT *, {DURATION_SQL.format(a='eventStart', b='eventEnd')} AS rain_time "
            f"FROM rev WHERE precipitation > {RAIN_MIN_DEPTH})",
            """rain_events AS (
  SELECT Year, SiteID, Treatment,
         row_number() OVER (PARTITION BY SiteID, Year ORDER BY eventStart, eventEnd, Treatment)
           AS rf_event,
         precipitation * 1000.0 AS rain_mm, rain_time / 60 AS rain_hr,
         (precipitation * 1000.0) / (rain_time / 60) AS rf_rate, eventStart, eventEnd
  FROM kept)"""]


def runoff_events_df(spark: SparkSession, sf_dir: str, gap: int = FLOW_GAP_STEPS,
                     steps: DataFrame | None = None) -> DataFrame:
    """Runoff events per series (E5 on flow, K = 8 steps), with duration."""
    runs = run_table(event_steps(spark, sf_dir, steps), SERIES_KEYS, "flow", GRID_SECONDS, gap, events_only=True)
    ev = run_events(runs, SERIES_KEYS, GRID_SECONDS, "flow", "flow_time")
    return ev.select("Year", "SiteID", "Treatment", F.col("eventid").alias("ro_event"),
                     "flow", "flow_time", "eventStart", "eventEnd")


def runoff_ctes(gap: int = FLOW_GAP_STEPS) -> list[str]:
    return [SQL_GRID,
            f"fsrc AS (SELECT SiteID, Treatment, Year, date_time, flow FROM grid WHERE {EXCLUSIONS_SQL})",
            segment_sql("fsrc", KEYS_SQL, "date_time", "flow", gap, "h"),
            "fev AS (SELECT SiteID, Treatment, Year, eventid, sum(flow) AS flow, "
            "min(date_time) AS eventStart, max(date_time) AS eventEnd "
            "FROM h6 WHERE eventflag = 1 GROUP BY ALL)",
            f"runoff_events AS (SELECT Year, SiteID, Treatment, eventid AS ro_event, flow, "
            f"{DURATION_SQL.format(a='eventStart', b='eventEnd')} AS flow_time, eventStart, eventEnd "
            f"FROM fev)"]


def rain_samples_df(spark, sf_dir, steps: DataFrame | None = None,
                    smp: DataFrame | None = None) -> DataFrame:
    """D4 + D2: samples inside rain events (same site and treatment, sample
    step within [start, end]). Each (event, sample) pair is emitted once by
    the interval join, so the reference's ``distinct`` is not needed."""
    smp = (smp if smp is not None else samples(spark, sf_dir)).select(
        "SiteID", "Treatment", "sampleID", "step_time")
    j = interval_join(smp, rain_events_df(spark, sf_dir, steps=steps), ["SiteID", "Treatment"],
                      "step_time", "eventStart", "eventEnd")
    return j.select("Year", "SiteID", "Treatment", "rf_event", "sampleID",
                    "rain_mm", "rain_hr", "rf_rate")


RAIN_SAMPLES_CTE = """rain_samples AS (
  SELECT r.Year, r.SiteID, r.Treatment, r.rf_event, s.sampleID, r.rain_mm, r.rain_hr, r.rf_rate
  FROM samples s JOIN rain_events r ON s.SiteID = r.SiteID AND s.Treatment = r.Treatment
   AND s.step_time BETWEEN r.eventStart AND r.eventEnd)"""


def runoff_samples_df(spark, sf_dir, steps: DataFrame | None = None,
                      smp: DataFrame | None = None) -> DataFrame:
    """D4 + F7 + C5: load per (runoff event, sample), then per sample the
    roll-up over its events (tss_sum, flow_sum, flow_min, ro_count), above
    the detection limit."""
    smp = (smp if smp is not None else samples(spark, sf_dir)).select(
        "SiteID", "Treatment", "sampleID", "step_time", "tss_kg_ha")
    j = interval_join(smp, runoff_events_df(spark, sf_dir, steps=steps), ["SiteID", "Treatment"],
                      "step_time", "eventStart", "eventEnd")
    per_event = (j.groupBy("Year", "SiteID", "Treatment", "sampleID", "ro_event", "flow", "flow_time")
                 .agg(F.sum("tss_kg_ha").alias("tss_sum")))
    per_sample = (per_event.groupBy("Year", "SiteID", "Treatment", "sampleID")
                  .agg(F.sum("tss_sum").alias("tss_sum"), F.sum("flow").alias("flow_sum"),
                       F.sum("flow_time").alias("flow_min"), F.count(F.lit(1)).alias("ro_count")))
    return above(per_sample, "tss_sum", DETECTION_LIMIT)


RUNOFF_SAMPLES_CTES = [
    """ro_pe AS (
  SELECT r.Year, r.SiteID, r.Treatment, s.sampleID, r.ro_event, r.flow, r.flow_time,
         sum(s.tss_kg_ha) AS tss_sum
  FROM samples s JOIN runoff_events r ON s.SiteID = r.SiteID AND s.Treatment = r.Treatment
   AND s.step_time BETWEEN r.eventStart AND r.eventEnd GROUP BY ALL)""",
    f"""runoff_samples AS (
  SELECT Year, SiteID, Treatment, sampleID, sum(tss_sum) AS tss_sum, sum(flow) AS flow_sum,
         sum(flow_time) AS flow_min, count(*) AS ro_count
  FROM ro_pe GROUP BY ALL HAVING sum(tss_sum) > {DETECTION_LIMIT})"""]


def rain_runoff_samples_df(spark, sf_dir) -> DataFrame:
    """Runoff totals per sample joined to every rain event of the sample
    (1:n), on (SiteID, sampleID); Year and Treatment from the runoff side."""
    steps, smp = shared_inputs(spark, sf_dir)
    ro = runoff_samples_df(spark, sf_dir, steps, smp)
    rf = rain_samples_df(spark, sf_dir, steps, smp).select("SiteID", "sampleID", "rf_event",
                                                          "rain_mm", "rain_hr", "rf_rate")
    return (ro.join(rf, ["SiteID", "sampleID"], "inner")
            .select("SiteID", "Year", "Treatment", "sampleID", "tss_sum", "ro_count", "flow_sum",
                    "flow_min", "rf_event", "rain_mm", "rain_hr", "rf_rate"))


RRS_CTE = """rain_runoff_samples AS (
  SELECT o.SiteID, o.Year, o.Treatment, o.sampleID, o.tss_sum, o.ro_count, o.flow_sum, o.flow_min,
         f.rf_event, f.rain_mm, f.rain_hr, f.rf_rate
  FROM runoff_samples o JOIN rain_samples f ON o.SiteID = f.SiteID AND o.sampleID = f.sampleID)"""

ALL_EVENT_CTES = rain_ctes() + runoff_ctes() + [SQL_SAMPLES, RAIN_SAMPLES_CTE,
                                                *RUNOFF_SAMPLES_CTES, RRS_CTE]


# ----------------------------------------------------------------- queries

@register("events_flagship", with_ctes(rain_ctes() + ci_sql("rain_events", "Treatment", "rf_rate"),
                                       CI_SELECT.format(by="Treatment")))
def q_events_flagship(spark, sf_dir):
    """Flagship: occupied steps (E15) -> run table (E5) -> event summary (E6) ->
    rate (B7) -> t-interval of the rain rate per treatment (F4)."""
    return mean_ci(rain_events_df(spark, sf_dir), ["Treatment"], "rf_rate")


@register("series_grid", with_ctes([SQL_GRID], "SELECT * FROM grid"))
def q_series_grid(spark, sf_dir):
    """Zero-filled regular grid of rain and flow per series."""
    return series_grid(spark, sf_dir)


@register("rain_runs", with_ctes([SQL_GRID, """r1 AS (SELECT SiteID, Treatment, Year, date_time,
  CAST(rain > 0 AS INTEGER) AS wet FROM grid)""", """r2 AS (SELECT *, lag(wet) OVER
  (PARTITION BY SiteID, Treatment, Year ORDER BY date_time) AS pw FROM r1)""",
    """r3 AS (SELECT SiteID, Treatment, Year, date_time, wet, CAST(sum(CASE WHEN wet IS NULL OR
  pw IS NULL OR wet <> pw THEN 1 ELSE 0 END) OVER (PARTITION BY SiteID, Treatment, Year
  ORDER BY date_time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM r2)"""],
    "SELECT *, count(*) OVER (PARTITION BY SiteID, Treatment, Year, run_id) AS run_length FROM r3"))
def q_rain_runs(spark, sf_dir):
    """E1 + E2 + B5: wet flag, run id and run length on every grid row."""
    g = series_grid(spark, sf_dir).select(*SERIES_KEYS, "date_time",
                                          (F.col("rain") > 0).cast("int").alias("wet"))
    return run_lengths(g, SERIES_KEYS, ["date_time"], "wet")


@register("rain_event_flags", with_ctes(
    [SQL_GRID, f"src AS (SELECT SiteID, Treatment, Year, date_time, rain FROM grid)",
     segment_sql("src", KEYS_SQL, "date_time", "rain", RAIN_GAP_STEPS, "g")],
    "SELECT SiteID, Treatment, Year, date_time, rain, eventflag, eventid FROM g6"))
def q_rain_event_flags(spark, sf_dir):
    """E3 + E4 + E5: bridged event flag and event id on every grid row."""
    return segment_events(rain_grid(spark, sf_dir, series_grid(spark, sf_dir)), SERIES_KEYS, ["date_time"], "rain",
                          RAIN_GAP_STEPS)


@register("rain_events", with_ctes(rain_ctes(), "SELECT * FROM rain_events"))
def q_rain_events(spark, sf_dir):
    """Rain events with depth, duration and rate."""
    return rain_events_df(spark, sf_dir)


@register("runoff_events", with_ctes(runoff_ctes(), "SELECT * FROM runoff_events"))
def q_runoff_events(spark, sf_dir):
    """E5 + E6 on flow: runoff events with total flow and duration."""
    return runoff_events_df(spark, sf_dir)


@register("sample_load", with_ctes([SQL_SAMPLES], f"""SELECT Year, SiteID, Treatment, sampleID,
  sum(tss_kg_ha) AS tss_sum FROM samples GROUP BY ALL HAVING sum(tss_kg_ha) > {DETECTION_LIMIT}"""))
def q_sample_load(spark, sf_dir):
    """F1 + C5 + B6: load per sample (lb/ac -> kg/ha), above detection limit."""
    s = samples(spark, sf_dir)
    per = s.groupBy("Year", "SiteID", "Treatment", "sampleID").agg(F.sum("tss_kg_ha").alias("tss_sum"))
    return above(per, "tss_sum", DETECTION_LIMIT)


@register("rain_samples", with_ctes(rain_ctes() + [SQL_SAMPLES, RAIN_SAMPLES_CTE],
                                    "SELECT * FROM rain_samples"))
def q_rain_samples(spark, sf_dir):
    """D4 + D2: rain event x sample pairs."""
    return rain_samples_df(spark, sf_dir)


@register("runoff_samples", with_ctes(runoff_ctes() + [SQL_SAMPLES, *RUNOFF_SAMPLES_CTES],
                                      "SELECT * FROM runoff_samples"))
def q_runoff_samples(spark, sf_dir):
    """D4 + F7 + C5: runoff totals per sample."""
    return runoff_samples_df(spark, sf_dir)


@register("rain_runoff_samples", with_ctes(ALL_EVENT_CTES, "SELECT * FROM rain_runoff_samples"))
def q_rain_runoff_samples(spark, sf_dir):
    """Rain x runoff x sample."""
    return rain_runoff_samples_df(spark, sf_dir)


@register("event_rates", with_ctes(ALL_EVENT_CTES + ["""firsts AS (
  SELECT *, row_number() OVER (PARTITION BY SiteID, sampleID ORDER BY rf_event, Year, Treatment,
         tss_sum, ro_count, flow_sum, flow_min, rain_mm, rain_hr, rf_rate) AS _k
  FROM rain_runoff_samples)"""], """SELECT SiteID, sampleID, Year, Treatment, rf_event,
  coalesce(tss_sum / (flow_min / 60), 0.0) AS load_rate, coalesce(rf_rate, 0.0) AS rain_rate
  FROM firsts WHERE _k = 1"""))
def q_event_rates(spark, sf_dir):
    """E14 = C9 + B7 + B8: first rain event per sample, load rate
    (tss / flow hours) and rain rate, missing rates filled with 0."""
    rrs = rain_runoff_samples_df(spark, sf_dir)
    first = keep_first(rrs, ["SiteID", "sampleID"], ["rf_event"])
    out = first.select("SiteID", "sampleID", "Year", "Treatment", "rf_event",
                       rate("tss_sum", F.col("flow_min") / 60).alias("load_rate"),
                       F.col("rf_rate").alias("rain_rate"))
    return out.fillna(0.0, subset=["load_rate", "rain_rate"])


@register("rain_threshold_sweep", with_ctes(
    [SQL_GRID, f"src AS (SELECT SiteID, Treatment, Year, date_time, rain FROM grid)"]
    + [segment_sql(f"src, (SELECT CAST({k} AS BIGINT) AS K) kk", KEYS_SQL + ", K", "date_time", "rain", k,
                   f"s{k}_") for k in SWEEP_STEPS]
    + ["sweep AS (" + " UNION ALL ".join(
        f"SELECT SiteID, Treatment, Year, K, eventid, rain, date_time FROM s{k}_6 WHERE eventflag = 1"
        for k in SWEEP_STEPS) + ")"],
    f"""SELECT K, SiteID, Treatment, Year, eventid, sum(rain) AS precipitation,
  min(date_time) AS eventStart, max(date_time) AS eventEnd,
  {DURATION_SQL.format(a='min(date_time)', b='max(date_time)')} AS rain_time
  FROM sweep GROUP BY ALL"""))
def q_rain_threshold_sweep(spark, sf_dir):
    """Rain events for K = 2, 4, 8, 12 steps in one plan."""
    flags = threshold_sweep(rain_grid(spark, sf_dir, series_grid(spark, sf_dir)), SERIES_KEYS, ["date_time"], "rain",
                            SWEEP_STEPS)
    flags = flags.withColumn("K", F.col("K").cast("long"))
    return summarize_events(flags, ["K", *SERIES_KEYS], "rain", "date_time", "precipitation",
                            "rain_time")


@register("gap_events", with_ctes([f"""ge0 AS ({SQL_KEYED} WHERE event_type IN ('click','view'))""",
    """ge1 AS (SELECT *, lag(ts) OVER (PARTITION BY SiteID, Treatment, Year ORDER BY ts, event_id)
        AS prev FROM ge0)""",
    f"""ge2 AS (SELECT *, CAST(sum(CASE WHEN date_diff('microsecond', prev, ts) / 60000000.0 >
        {GAP_MINUTES} THEN 1 ELSE 0 END) OVER (PARTITION BY SiteID, Treatment, Year
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM ge1)"""],
    """SELECT SiteID, Treatment, Year, event, count(*) AS n, sum(value) AS total,
  min(ts) AS eventStart, max(ts) AS eventEnd FROM ge2 GROUP BY ALL"""))
def q_gap_events(spark, sf_dir):
    """E8 + G6: events by time gap (> 60 min starts a new one) on raw rain
    rows, numbered from 0 per series, with count, total, start and end
    (windows over 60-minute buckets, not raw rows)."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES)
    return gap_event_summary(ev, SERIES_KEYS, "ts", GAP_MINUTES, "value", "event")


@register("gap_event_rows", with_ctes([f"""ge0 AS ({SQL_KEYED} WHERE event_type IN ('click','view'))""",
    """ge1 AS (SELECT *, lag(ts) OVER (PARTITION BY SiteID, Treatment, Year ORDER BY ts, event_id)
        AS prev FROM ge0)""",
    f"""ge2 AS (SELECT *, CAST(sum(CASE WHEN date_diff('microsecond', prev, ts) / 60000000.0 >
        {GAP_MINUTES} THEN 1 ELSE 0 END) OVER (PARTITION BY SiteID, Treatment, Year
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM ge1)"""],
    "SELECT SiteID, Treatment, Year, event_id, ts, event FROM ge2"))
def q_gap_event_rows(spark, sf_dir):
    """E8, row form: the number of its time-gap event on every raw rain row."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES).select(*SERIES_KEYS, "event_id", "ts")
    return gap_events(ev, SERIES_KEYS, "ts", GAP_MINUTES, "event").select(*SERIES_KEYS, "event_id", "ts", "event")


MISSING_SQL = f"""
mv AS (SELECT SiteID, Treatment, Year, ts, CASE WHEN event_id % 40 <> 0 THEN value END AS value
  FROM ({SQL_KEYED}) k WHERE event_type IN ('click','view')),
mb AS (SELECT SiteID, Treatment, Year, time_bucket(INTERVAL '15 minutes', ts) AS date_time,
  CASE WHEN bool_or(value IS NULL) THEN NULL ELSE sum(value) END AS rain FROM mv GROUP BY ALL),
mr AS (SELECT SiteID, Treatment, Year, min(date_time) AS t0, max(date_time) AS t1 FROM mb GROUP BY ALL),
ms AS (SELECT SiteID, Treatment, Year, unnest(generate_series(t0, t1, INTERVAL '15 minutes')) AS date_time FROM mr),
mg AS (SELECT ms.*, CASE WHEN mb.date_time IS NULL THEN 0.0 ELSE mb.rain END AS rain
  FROM ms LEFT JOIN mb USING (SiteID, Treatment, Year, date_time))"""


def _grid_with_missing(spark, sf_dir):
    """The rain grid when every fortieth reading is missing (NULL)."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES)
    reading = F.when(F.col("event_id") % 40 != 0, F.col("value"))
    return regular_grid(ev, SERIES_KEYS, "ts", {"rain": reading}, GRID_SECONDS, missing={"rain": reading.isNull()})


@register("grid_missing_readings", with_ctes([MISSING_SQL], "SELECT * FROM mg"))
def q_grid_missing_readings(spark, sf_dir):
    """E15 with missing readings: NULL at their steps, 0 at empty steps."""
    return _grid_with_missing(spark, sf_dir)


@register("missing_rain_flags", with_ctes([MISSING_SQL, segment_sql("mg", "SiteID, Treatment, Year", "date_time", "rain", 4)],
    "SELECT SiteID, Treatment, Year, date_time, rain, CAST(eventflag AS VARCHAR) AS eventflag, eventid FROM g6"))
def q_missing_rain_flags(spark, sf_dir):
    """E3-E5 over missing readings: each is a run of its own and splits events."""
    flags = segment_events(_grid_with_missing(spark, sf_dir), SERIES_KEYS, ["date_time"], "rain", 4)
    return flags.select(*SERIES_KEYS, "date_time", "rain", F.col("eventflag").cast("string").alias("eventflag"), "eventid")


@register("rain_event_steps", with_ctes(rain_ctes(exclusions="true"), """SELECT Year, SiteID, Treatment, rf_event,
  unnest(generate_series(eventStart, eventEnd, INTERVAL '15 minutes')) AS date_time
  FROM rain_events"""))
def q_rain_event_steps(spark, sf_dir):
    """Every rain event expanded to its grid steps (``seq(by=...)``)."""
    ev = rain_events_df(spark, sf_dir, exclusions=None).select("Year", "SiteID", "Treatment", "rf_event",
                                                               "eventStart", "eventEnd")
    return expand_grid(ev, "eventStart", "eventEnd", GRID_SECONDS).drop("eventStart", "eventEnd")


@register("sample_windows", with_ctes([f"sw0 AS ({SQL_KEYED} WHERE event_type = 'error')"],
    f"""SELECT SiteID, Treatment, Year, CAST(user_id AS VARCHAR) AS sampleID,
  min(ts) AS sampStart, max(ts) AS sampEnd, sum(value) AS precipitation,
  {DURATION_SQL.format(a='min(ts)', b='max(ts)')} AS rain_time
  FROM sw0 GROUP BY SiteID, Treatment, Year, user_id"""))
def q_sample_windows(spark, sf_dir):
    """Per sampler (user) and period: first/last time, total, duration."""
    ev = keyed_events(spark, sf_dir, ("error",)).withColumn(
        "sampleID", F.col("user_id").cast("string"))
    return window_per_key(ev, ["SiteID", "Treatment", "Year", "sampleID"], "ts", "value")


@register("daily_rain", with_ctes([f"d0 AS ({SQL_KEYED} WHERE event_type IN ('click','view'))"],
    """SELECT SiteID, Treatment, year(ts) AS year, dayofyear(ts) AS doy,
  sum(value) * 1000.0 AS daily FROM d0 GROUP BY ALL"""))
def q_daily_rain(spark, sf_dir):
    """Daily rain totals (x 1000, m -> mm) per site and treatment."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES)
    out = daily_totals(ev, ["SiteID", "Treatment"], "ts", "value", M_TO_MM)
    return out.withColumns({"year": F.col("year").cast("long"), "doy": F.col("doy").cast("long")})


@register("rain_event_rows", with_ctes(
    [SQL_GRID, f"src AS (SELECT SiteID, Treatment, Year, date_time, rain FROM grid)",
     segment_sql("src", KEYS_SQL, "date_time", "rain", RAIN_GAP_STEPS, "g")],
    """SELECT SiteID, Treatment, Year, eventid, date_time, rain,
  sum(rain) OVER (PARTITION BY SiteID, Treatment, Year, eventid) AS event_rain
  FROM g6 WHERE eventflag = 1"""))
def q_rain_event_rows(spark, sf_dir):
    """Event total repeated on every row of the event (no collapse)."""
    flags = segment_events(rain_grid(spark, sf_dir, series_grid(spark, sf_dir)), SERIES_KEYS, ["date_time"], "rain",
                           RAIN_GAP_STEPS).where(F.col("eventflag") == 1)
    return total_on_rows(flags, [*SERIES_KEYS, "eventid"], "rain", "event_rain").select(
        *SERIES_KEYS, "eventid", "date_time", "rain", "event_rain")


@register("sample_rain_overlap", with_ctes(rain_ctes(exclusions="true") + [
    f"sw0 AS ({SQL_KEYED} WHERE event_type = 'error')",
    """sw AS (SELECT SiteID, Treatment, Year AS sYear, CAST(user_id AS VARCHAR) AS sampleID,
         min(ts) AS sampStart, max(ts) AS sampEnd FROM sw0 GROUP BY SiteID, Treatment, Year, user_id)"""],
    """SELECT w.SiteID, w.Treatment, w.sYear, w.sampleID, w.sampStart, w.sampEnd,
  count(r.rf_event) AS num_rf, sum(r.rain_mm) AS rf_sum, sum(r.rain_hr) AS rf_time
  FROM sw w LEFT JOIN rain_events r ON w.SiteID = r.SiteID AND w.Treatment = r.Treatment
   AND w.sampStart <= r.eventEnd AND r.eventStart <= w.sampEnd
  GROUP BY ALL"""))
def q_sample_rain_overlap(spark, sf_dir):
    """Per sample window, count and totals of the rain events that
    overlap it (num_rf, rf_sum, rf_time); windows without rain keep 0."""
    ev = keyed_events(spark, sf_dir, ("error",))
    win = (ev.groupBy("SiteID", "Treatment", F.col("Year").alias("sYear"),
                      F.col("user_id").cast("string").alias("sampleID"))
           .agg(F.min("ts").alias("sampStart"), F.max("ts").alias("sampEnd")))
    rain = rain_events_df(spark, sf_dir, exclusions=None).select("SiteID", "Treatment", "rain_mm", "rain_hr",
                                                                 "eventStart", "eventEnd")
    return overlap_totals(win, rain, ["SiteID", "Treatment"], "sampStart", "sampEnd", "eventStart", "eventEnd",
                          {"rf_sum": "rain_mm", "rf_time": "rain_hr"}, "num_rf")


@register("span_samples", with_ctes([SQL_SAMPLES, f"sp0 AS ({SQL_KEYED} WHERE event_type IN ('click','view'))",
    """sp AS (SELECT SiteID, Treatment, user_id, min(ts) AS spanStart, max(ts) AS spanEnd FROM sp0 GROUP BY ALL)"""],
    """SELECT s.SiteID, s.Treatment, s.sampleID, s.date_time, p.user_id, p.spanStart, p.spanEnd
  FROM samples s JOIN sp p ON s.SiteID = p.SiteID AND s.Treatment = p.Treatment AND s.date_time BETWEEN p.spanStart AND p.spanEnd"""))
def q_span_samples(spark, sf_dir):
    """D4 by a sweep: samples inside the spans of the site's gauges, which are
    weeks long and nested, so no bucket of time suits them."""
    spans = (keyed_events(spark, sf_dir, RAIN_TYPES).groupBy("SiteID", "Treatment", "user_id")
             .agg(F.min("ts").alias("spanStart"), F.max("ts").alias("spanEnd")))
    smp = samples(spark, sf_dir).select("SiteID", "Treatment", "sampleID", "date_time")
    return sweep_join(smp, spans, ["SiteID", "Treatment"], "date_time", "spanStart", "spanEnd")


@register("runoff_overrides", with_ctes(runoff_ctes(), """SELECT r.Year, r.SiteID, r.Treatment,
  r.ro_event, r.flow, coalesce(o.ft, r.flow_time) AS flow_time, r.eventStart, r.eventEnd
  FROM runoff_events r LEFT JOIN (VALUES ('S1', TIMESTAMP '2024-01-08', 3, 240.0),
    ('S2', TIMESTAMP '2024-01-15', 1, 60.0)) o(SiteID, Year, ro_event, ft)
  ON r.SiteID = o.SiteID AND r.Year = o.Year AND r.ro_event = o.ro_event"""))
def q_runoff_overrides(spark, sf_dir):
    """Hand edits between steps, re-aimed as an override table joined in
    (new flow_time for listed runoff events; every other row unchanged)."""
    return apply_overrides(runoff_events_df(spark, sf_dir), RUNOFF_OVERRIDES,
                           ["SiteID", "Year", "ro_event"], ["flow_time"])


DAY_SECONDS = 86_400


@register("rain_events_long", with_ctes(
    [sql_grid("SiteID, Treatment", "lgrid", "l_"),
     "lsrc AS (SELECT SiteID, Treatment, date_time, rain FROM lgrid)",
     segment_sql("lsrc", "SiteID, Treatment", "date_time", "rain", RAIN_GAP_STEPS, "m")],
    f"""SELECT SiteID, Treatment, eventid, sum(rain) AS precipitation, min(date_time) AS eventStart,
  max(date_time) AS eventEnd, {DURATION_SQL.format(a='min(date_time)', b='max(date_time)')} AS rain_time
  FROM m6 WHERE eventflag = 1 GROUP BY ALL"""))
def q_rain_events_long(spark, sf_dir):
    """E5 + E6 + E15 on series WITHOUT a period reset (the whole span per
    site and treatment): the run table's windows hold a day of a series, and
    what crosses midnight is carried from day to day."""
    keys = ["SiteID", "Treatment"]
    steps = series_steps(spark, sf_dir, keys=keys)
    runs = run_table(steps, keys, "rain", GRID_SECONDS, RAIN_GAP_STEPS, chunk_steps=DAY_SECONDS // GRID_SECONDS, events_only=True)
    return run_events(runs, keys, GRID_SECONDS, "precipitation", "rain_time")


@register("rain_flags_long", with_ctes(
    [sql_grid("SiteID, Treatment", "lgrid", "l_"),
     "lsrc AS (SELECT SiteID, Treatment, date_time, rain FROM lgrid)",
     segment_sql("lsrc", "SiteID, Treatment", "date_time", "rain", RAIN_GAP_STEPS, "m")],
    "SELECT SiteID, Treatment, date_time, rain, eventflag, eventid FROM m6"))
def q_rain_flags_long(spark, sf_dir):
    """E5, row form, on series without a period reset: grid and segmentation run
    per (series, day) chunk and are stitched, so no task holds a whole series."""
    keys = ["SiteID", "Treatment"]
    grid = series_grid(spark, sf_dir, keys=keys, chunk_seconds=DAY_SECONDS).select(*keys, "date_time", "rain")
    return segment_events_chunked(grid, keys, ["date_time"], "rain", RAIN_GAP_STEPS, time_bucket_index("date_time", DAY_SECONDS))


@register("missing_rain_runs", with_ctes([MISSING_SQL, segment_sql("mg", "SiteID, Treatment, Year", "date_time", "rain", 4)],
    """SELECT SiteID, Treatment, Year, eventid, CAST(eventflag AS VARCHAR) AS eventflag, min(date_time) AS run_start,
  count(*) AS n_steps, sum(rain) AS total FROM g6 GROUP BY ALL"""))
def q_missing_rain_runs(spark, sf_dir):
    """E5 + E15 as a run table: every run of the event flag, dry, wet and missing."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES)
    reading = F.when(F.col("event_id") % 40 != 0, F.col("value"))
    steps = occupied_steps(ev, SERIES_KEYS, "ts", {"rain": reading}, GRID_SECONDS, {"rain": reading.isNull()})
    runs = run_table(steps, SERIES_KEYS, "rain", GRID_SECONDS, 4)
    return runs.select(*SERIES_KEYS, "eventid", F.col("eventflag").cast("string").alias("eventflag"), "run_start", "n_steps", "total")


KEYLESS = "SELECT * REPLACE (CASE WHEN SiteID <> 'S3' THEN SiteID END AS SiteID)"


def keyless(ev: DataFrame) -> DataFrame:
    """The same rows where one site is not known (NULL)."""
    return ev.withColumn("SiteID", F.nullif("SiteID", F.lit("S3")))


@register("unknown_site_gap_rows", with_ctes([f"ge0 AS ({KEYLESS} FROM ({SQL_KEYED}) k WHERE event_type IN ('click','view'))",
    """ge1 AS (SELECT *, lag(ts) OVER (PARTITION BY SiteID, Treatment, Year ORDER BY ts, event_id)
        AS prev FROM ge0)""",
    f"""ge2 AS (SELECT *, CAST(sum(CASE WHEN date_diff('microsecond', prev, ts) / 60000000.0 >
        {GAP_MINUTES} THEN 1 ELSE 0 END) OVER (PARTITION BY SiteID, Treatment, Year
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM ge1)"""],
    "SELECT SiteID, Treatment, Year, event_id, ts, event FROM ge2"))
def q_unknown_site_gap_rows(spark, sf_dir):
    """E8, row form, where a key is NULL: its rows are a series like any other."""
    ev = keyless(keyed_events(spark, sf_dir, RAIN_TYPES)).select(*SERIES_KEYS, "event_id", "ts")
    return gap_events(ev, SERIES_KEYS, "ts", GAP_MINUTES, "event").select(*SERIES_KEYS, "event_id", "ts", "event")


@register("grid_window_primitives", with_ctes([SQL_GRID], """SELECT SiteID, Treatment, Year, date_time, rain,
  row_number() OVER w AS rn, rain - lag(rain) OVER w AS diff,
  sum(rain) OVER (w ROWS UNBOUNDED PRECEDING) AS cumsum,
  first_value(rain) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first,
  last_value(rain) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
  FROM grid WINDOW w AS (PARTITION BY SiteID, Treatment, Year ORDER BY date_time)"""))
def q_grid_window_primitives(spark, sf_dir):
    """row_number, diff, cumsum, first, last per series on the grid
    (bounded series periods, one sort)."""
    g = series_grid(spark, sf_dir).select(*SERIES_KEYS, "date_time", "rain")
    return window_primitives(g, SERIES_KEYS, ["date_time"], "rain")
