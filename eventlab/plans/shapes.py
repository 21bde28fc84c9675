"""The driver tables mapped onto the study's shapes.

| Shape      | Built from                                                        |
|------------|-------------------------------------------------------------------|
| SiteID     | 'S' || (user_id % 8)                                              |
| Treatment  | strips when floor(user_id / 8) is even, else control              |
| Year       | date_trunc('week', ts)  (the partition reset of each series)      |
| rain       | click/view values summed on a zero-filled 15-minute grid          |
| flow       | purchase/signup values, same grid                                 |
| samples    | error rows: sampleID = event_id, date_time = ts, load = value     |
| model      | lineitem ⋈ orders ⋈ customer ⋈ nation                             |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.functions.columns import LB_AC_TO_KG_HA, floor_time
from eventlab.operators.events import regular_grid
from eventlab.operators.filters import exclude
from eventlab.operators.runs import occupied_steps
from eventlab.sources.files import read_table

GRID_SECONDS = 900
RAIN_TYPES = ("click", "view")
FLOW_TYPES = ("purchase", "signup")
SAMPLE_TYPE = "error"


def site_col(user_id: str = "user_id"):
    return F.concat(F.lit("S"), (F.col(user_id) % 8).cast("string"))


def treatment_col(user_id: str = "user_id"):
    return F.when(F.floor(F.col(user_id) / 8) % 2 == 0, F.lit("strips")).otherwise(F.lit("control"))


def period_col(ts: str = "ts"):
    return F.date_trunc("week", F.col(ts)).cast("timestamp_ntz")


def keyed_events(spark: SparkSession, sf_dir: str, types) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type").isin(*types))
    return ev.select(site_col().alias("SiteID"), treatment_col().alias("Treatment"),
                     period_col().alias("Year"), "ts", "event_type", "value", "event_id", "user_id")


def series_grid(spark: SparkSession, sf_dir: str, step: int = GRID_SECONDS,
                exclusions=None, keys=("SiteID", "Treatment", "Year"),
                chunk_seconds: int | None = None) -> DataFrame:
    """Regular rain/flow series per (SiteID, Treatment, Year), zero-filled.
    ``exclusions`` (SiteID, Year) rows are removed from the raw rows first
    (map-side broadcast anti join, before any shuffle)."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES + FLOW_TYPES)
    if exclusions:
        ev = exclude(ev, exclusions, ["SiteID", "Year"])
    values = {
        "rain": F.when(F.col("event_type").isin(*RAIN_TYPES), F.col("value")),
        "flow": F.when(F.col("event_type").isin(*FLOW_TYPES), F.col("value")),
    }
    return regular_grid(ev, list(keys), "ts", values, step, chunk_seconds=chunk_seconds)


def series_steps(spark: SparkSession, sf_dir: str, step: int = GRID_SECONDS, exclusions=None,
                 keys=("SiteID", "Treatment", "Year")) -> DataFrame:
    """Occupied steps of the rain/flow series: sums per step, no zero fill."""
    ev = keyed_events(spark, sf_dir, RAIN_TYPES + FLOW_TYPES)
    if exclusions:
        ev = exclude(ev, exclusions, ["SiteID", "Year"])
    values = {
        "rain": F.when(F.col("event_type").isin(*RAIN_TYPES), F.col("value")),
        "flow": F.when(F.col("event_type").isin(*FLOW_TYPES), F.col("value")),
    }
    return occupied_steps(ev, list(keys), "ts", values, step)


def samples(spark: SparkSession, sf_dir: str, step: int = GRID_SECONDS) -> DataFrame:
    """Water samples: one row per error event, with its grid step."""
    ev = keyed_events(spark, sf_dir, (SAMPLE_TYPE,))
    return ev.select("SiteID", "Treatment", "Year",
                     F.col("event_id").cast("string").alias("sampleID"),
                     F.col("ts").alias("date_time"),
                     floor_time("ts", step).alias("step_time"),
                     (F.col("value") * F.lit(LB_AC_TO_KG_HA)).alias("tss_kg_ha"))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level model table: y = l_extendedprice, covariate l_quantity,
    Treatment = l_returnflag, crop = o_orderpriority, Year = year(o_orderdate),
    SiteID = n_name. Dimension joins are done on narrow projections first;
    nation (25 rows by definition) is the only explicit broadcast."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = (read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_name").alias("SiteID")))
    orders = (read_table(spark, sf_dir, "orders")
              .select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "SiteID", F.col("o_orderpriority").alias("crop"),
                      F.year("o_orderdate").cast("long").alias("Year")))
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag")
    return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "SiteID", "Year", "crop",
                    F.col("l_returnflag").alias("Treatment"),
                    F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"),
                    F.col("l_extendedprice").alias("price")))


# DuckDB text of the same shapes, for the oracles.
SQL_KEYED = """
  SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS SiteID,
         CASE WHEN (user_id // 8) % 2 = 0 THEN 'strips' ELSE 'control' END AS Treatment,
         date_trunc('week', ts) AS Year, ts, event_type, value, event_id, user_id
  FROM events"""

SQL_GRID = f"""
ev AS ({SQL_KEYED} WHERE event_type IN ('click','view','purchase','signup')),
binned AS (
  SELECT SiteID, Treatment, Year, time_bucket(INTERVAL '15 minutes', ts) AS date_time,
         sum(CASE WHEN event_type IN ('click','view') THEN value END) AS rain,
         sum(CASE WHEN event_type IN ('purchase','signup') THEN value END) AS flow
  FROM ev GROUP BY ALL),
bounds AS (SELECT SiteID, Treatment, Year, min(date_time) AS t0, max(date_time) AS t1
           FROM binned GROUP BY ALL),
spine AS (SELECT SiteID, Treatment, Year,
                 unnest(generate_series(t0, t1, INTERVAL '15 minutes')) AS date_time FROM bounds),
grid AS (
  SELECT s.SiteID, s.Treatment, s.Year, s.date_time,
         coalesce(b.rain, 0.0) AS rain, coalesce(b.flow, 0.0) AS flow
  FROM spine s LEFT JOIN binned b USING (SiteID, Treatment, Year, date_time))"""

SQL_SAMPLES = f"""
samples AS (
  SELECT SiteID, Treatment, Year, CAST(event_id AS VARCHAR) AS sampleID, ts AS date_time,
         time_bucket(INTERVAL '15 minutes', ts) AS step_time, value * 1.12 AS tss_kg_ha
  FROM ({SQL_KEYED}) k WHERE event_type = 'error')"""

SQL_MODEL = """
model AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, n.n_name AS SiteID,
         year(o.o_orderdate) AS Year, o.o_orderpriority AS crop,
         l.l_returnflag AS Treatment, l.l_quantity AS qty, l.l_discount AS discount,
         l.l_extendedprice AS price
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def segment_sql(src: str, keys: str, order: str, value: str, k: int, prefix: str = "g") -> str:
    """CTE chain (DuckDB) for E5 on ``src``; the last CTE is ``{prefix}6``."""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    return f"""
{prefix}1 AS (SELECT *, CAST({value} > 0 AS INTEGER) AS _wet,
                 row_number() OVER ({w}) AS _rn FROM {src}),
{prefix}2 AS (SELECT *, lag(_wet) OVER ({w}) AS _pw FROM {prefix}1),
{prefix}3 AS (SELECT *, CAST(sum(CASE WHEN _wet IS NULL OR _pw IS NULL OR _wet <> _pw THEN 1 ELSE 0
                 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS _run FROM {prefix}2),
{prefix}4 AS (SELECT *, CASE WHEN _wet IS NULL THEN NULL WHEN _rn < {k} AND _wet = 0 THEN 0
                 WHEN _wet = 1 THEN 1 WHEN count(*) OVER (PARTITION BY {keys}, _run) < {k} THEN 1
                 ELSE 0 END AS eventflag FROM {prefix}3),
{prefix}5 AS (SELECT *, lag(eventflag) OVER ({w}) AS _pf FROM {prefix}4),
{prefix}6 AS (SELECT *, CAST(sum(CASE WHEN eventflag IS NULL OR _pf IS NULL OR eventflag <> _pf
                 THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eventid
              FROM {prefix}5)"""


def sql_grid(keys: str = "SiteID, Treatment, Year", name: str = "grid", prefix: str = "") -> str:
    """DuckDB grid CTEs for any series keys (the default equals SQL_GRID)."""
    return f"""
{prefix}ev AS ({SQL_KEYED} WHERE event_type IN ('click','view','purchase','signup')),
{prefix}binned AS (
  SELECT {keys}, time_bucket(INTERVAL '15 minutes', ts) AS date_time,
         sum(CASE WHEN event_type IN ('click','view') THEN value END) AS rain,
         sum(CASE WHEN event_type IN ('purchase','signup') THEN value END) AS flow
  FROM {prefix}ev GROUP BY ALL),
{prefix}bounds AS (SELECT {keys}, min(date_time) AS t0, max(date_time) AS t1
           FROM {prefix}binned GROUP BY ALL),
{prefix}spine AS (SELECT {keys},
                 unnest(generate_series(t0, t1, INTERVAL '15 minutes')) AS date_time FROM {prefix}bounds),
{name} AS (
  SELECT s.*, coalesce(b.rain, 0.0) AS rain, coalesce(b.flow, 0.0) AS flow
  FROM {prefix}spine s LEFT JOIN {prefix}binned b USING ({keys}, date_time))"""
