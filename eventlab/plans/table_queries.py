"""Queries for the table-level operators (A, B, C, D1/D3/D7, G) on the
TPC-H-like driver tables. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.functions.columns import (
    AC_TO_HA,
    LB_AC_TO_KG_HA,
    M_TO_MM,
    clamp_nonnegative,
    factor_code,
    join_resolve,
    label_when,
    ln_offset,
    parse_timestamp,
    positive_flag,
    prefix_upper,
    rate,
    recode,
    split_key,
    suffix,
    with_logs,
    zero_to_null,
)
from eventlab.operators.filters import (
    attach,
    distinct_keys,
    distinct_rows,
    drop_null,
    exclude,
    keep_first,
    keep_ids,
    where_all,
)
from eventlab.operators.reshape import (
    append_rows,
    box_stats,
    complete_cells,
    levels_of,
    pivot_longer,
    pivot_wider,
    sort_by,
)
from eventlab.plans.registry import register, with_ctes
from eventlab.plans.shapes import SQL_MODEL, model_table
from eventlab.sources.files import read_delimited, read_quarantined, read_table, read_with_reasons, stage, write_table
from eventlab.session import stage_path

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]
STAGE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Priority recode used by the recode query (default 'other').
PRIORITY_CODES = {"1-URGENT": "U", "2-HIGH": "H"}
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Exclusion list on (SiteID = nation, Year); None is a wildcard.
NATION_YEAR_EXCLUSIONS = [("CHINA", None), ("FRANCE", 1996), ("JAPAN", 1999)]


# ------------------------------------------------------------------ sources

@register("csv_roundtrip", """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, sf_dir):
    """A1 + A2: write orders as CSV (header, NA for NULL) to the shared stage
    folder and read it back with a declared schema and NA tokens."""
    src = read_table(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    path = stage_path(spark, "orders-csv")
    write_table(src.select(*ORDERS_COLS), path, "csv")
    schema = src.select(*ORDERS_COLS).schema
    return read_delimited(spark, path, schema,
                          timestamp_formats=(STAGE_TS_FORMAT, "yyyy-MM-dd HH:mm:ss"))


@register("parquet_stage", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  l_returnflag FROM lineitem""")
def q_parquet_stage(spark, sf_dir):
    """A2 + A3: stage a projection as parquet partitioned by return flag in
    the shared folder, then continue from the stage table."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return stage(li, "lineitem-stage", ["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


def _stacked_csv(spark, sf_dir):
    """Two tables with different schemas written into one folder (the
    'stacked schemas' case): orders rows are good, customer rows are not."""
    path = stage_path(spark, "stacked-csv")
    write_table(read_table(spark, sf_dir, "orders").select(*ORDERS_COLS), path + "/a", "csv")
    write_table(read_table(spark, sf_dir, "customer"), path + "/b", "csv")
    schema = read_table(spark, sf_dir, "orders").select(*ORDERS_COLS).schema
    return read_quarantined(spark, path + "/*", schema,
                            timestamp_formats=(STAGE_TS_FORMAT, "yyyy-MM-dd HH:mm:ss"))


@register("quarantine_good", "SELECT * FROM orders")
def q_quarantine_good(spark, sf_dir):
    """A4: rows that pass the declared schema."""
    return _stacked_csv(spark, sf_dir)[0]


@register("quarantine_bad", "SELECT count(*) AS bad_rows FROM customer")
def q_quarantine_bad(spark, sf_dir):
    """A4: number of quarantined rows."""
    return _stacked_csv(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("bad_rows"))


DEFECT_SQL = """CASE WHEN o_orderkey % 40 = 3 THEN 'field count' WHEN o_orderkey % 40 = 5 THEN 'type'
  WHEN o_orderkey % 40 = 6 THEN 'merge marker' WHEN o_orderkey % 40 = 7 THEN 'repeated header' END"""


def _damaged_csv(spark, sf_dir):
    """Orders as text lines, some of them damaged by their key; every file has a header."""
    o = read_table(spark, sf_dir, "orders")
    head = ",".join(ORDERS_COLS)
    cells = [F.coalesce(F.date_format(c, STAGE_TS_FORMAT) if c == "o_orderdate" else F.col(c).cast("string"), F.lit("NA")) for c in ORDERS_COLS]
    worse = [F.concat(cells[0], F.lit("x")) if c == "o_orderkey" else x for c, x in zip(ORDERS_COLS, cells)]
    key = F.col("o_orderkey") % 40
    line = (F.when(key == 3, F.concat_ws(",", *cells, F.lit("more"))).when(key == 5, F.concat_ws(",", *worse))
            .when(key == 6, F.lit("=======")).when(key == 7, F.lit(head)).otherwise(F.concat_ws(",", *cells)))
    path = stage_path(spark, "damaged-csv")
    # the text writer has no header: one is put before each file's first line
    first = F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.array(F.lit(head), line)).otherwise(F.array(line))
    o.select(F.explode(first).alias("value")).write.text(path)
    return read_with_reasons(spark, path, o.select(*ORDERS_COLS).schema, timestamp_formats=(STAGE_TS_FORMAT, "yyyy-MM-dd HH:mm:ss"))


@register("reasons_good", f"SELECT {', '.join(ORDERS_COLS)} FROM orders WHERE ({DEFECT_SQL}) IS NULL")
def q_reasons_good(spark, sf_dir):
    """A1 + A4: the rows that pass, typed."""
    return _damaged_csv(spark, sf_dir)[0]


@register("reasons_bad", f"""SELECT reason, CASE WHEN reason = 'type' THEN 'o_orderkey' END AS field,
  CASE WHEN reason IN ('field count', 'type') THEN CAST(o_orderkey AS VARCHAR) || CASE WHEN reason = 'type' THEN 'x' ELSE '' END END AS first_cell,
  count(*) AS n FROM (SELECT o_orderkey, {DEFECT_SQL} AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY ALL""")
def q_reasons_bad(spark, sf_dir):
    """A4: every quarantined line with its reason, the field and its first cell."""
    bad = _damaged_csv(spark, sf_dir)[1]
    cell = F.when(F.col("reason").isin("field count", "type"), F.split("line", ",")[0])
    return bad.groupBy("reason", "field", cell.alias("first_cell")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------- columns

@register("project_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def q_project_columns(spark, sf_dir):
    """B1: keep / drop columns (pruned at the scan)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.drop("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
                   "l_linestatus", "l_shipdate")


@register("derived_columns", f"""SELECT l_orderkey, l_linenumber,
  l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_tax AS tax_amt,
  l_quantity * {AC_TO_HA} AS qty_ha, l_extendedprice * {LB_AC_TO_KG_HA} AS price_kg_ha,
  l_quantity * {M_TO_MM} AS qty_mm, l_quantity / 60 AS qty_h,
  CAST(l_discount > 0 AS INTEGER) AS discounted FROM lineitem""")
def q_derived_columns(spark, sf_dir):
    """B2 + B5 + B6: add columns in one projection (unit factors, flag)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_amt"),
        (F.col("l_quantity") * AC_TO_HA).alias("qty_ha"),
        (F.col("l_extendedprice") * LB_AC_TO_KG_HA).alias("price_kg_ha"),
        (F.col("l_quantity") * M_TO_MM).alias("qty_mm"),
        (F.col("l_quantity") / 60).alias("qty_h"),
        positive_flag("l_discount").alias("discounted"))


@register("recode_priority", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U'
  WHEN '2-HIGH' THEN 'H' ELSE 'other' END AS code FROM orders""")
def q_recode_priority(spark, sf_dir):
    """Value map with a literal default."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", recode("o_orderpriority", PRIORITY_CODES, "other").alias("code"))


@register("label_segments", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
  THEN 'R' WHEN c_mktsegment = 'MACHINERY' THEN 'NR' ELSE '0' END AS random FROM customer""")
def q_label_segments(spark, sf_dir):
    """Multi-branch label with fall-through '0' (R / NR)."""
    c = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    return c.select("c_custkey", label_when(
        [(seg.isin("BUILDING", "AUTOMOBILE"), "R"), (seg == "MACHINERY", "NR")], "0").alias("random"))


@register("rate_zero_denominator", """SELECT l_orderkey, l_linenumber, l_partkey,
  l_extendedprice / nullif(l_discount, 0) AS price_per_discount FROM lineitem""")
def q_rate_zero_denominator(spark, sf_dir):
    """Rate with NULL where the denominator is 0."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     rate("l_extendedprice", "l_discount").alias("price_per_discount"))


@register("fill_missing", """SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(nullif(l_discount, 0), 0.0) AS disc, coalesce(l_extendedprice / nullif(l_discount, 0), 0.0) AS ppd
  FROM lineitem""")
def q_fill_missing(spark, sf_dir):
    """B8 + B12: zero -> NULL, then NULL -> 0 in chosen columns."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_discount").alias("disc"), rate("l_extendedprice", "l_discount").alias("ppd"))
    return zero_to_null(li, ["disc"]).fillna(0.0, subset=["disc", "ppd"])


@register("log_covariates", with_ctes([SQL_MODEL], """SELECT l_orderkey, l_linenumber, l_partkey,
  ln(price) AS ln_price, ln(qty) AS ln_qty, ln(price + 0.036) AS ln_price_off,
  ln(discount + 0.001) AS ln_disc FROM model"""))
def q_log_covariates(spark, sf_dir):
    """B9 + B10: natural logs in one projection, and offset logs."""
    m = model_table(spark, sf_dir)
    m = with_logs(m, {"ln_price": "price", "ln_qty": "qty"})
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "ln_price", "ln_qty",
                    ln_offset("price", 0.036).alias("ln_price_off"),
                    ln_offset("discount", 0.001).alias("ln_disc"))


@register("clamp_balances", """SELECT c_custkey, greatest(c_acctbal, 0.0) AS c_acctbal,
  c_nationkey FROM customer""")
def q_clamp_balances(spark, sf_dir):
    """Floor numeric columns at zero (NULL kept)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return clamp_nonnegative(c, ["c_acctbal"])


@register("name_parts", """SELECT c_custkey, upper(substring(c_name, 1, 3)) AS prefix,
  right(c_name, 3) AS suffix FROM customer""")
def q_name_parts(spark, sf_dir):
    """Upper-cased prefix and suffix."""
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", prefix_upper("c_name", 3).alias("prefix"),
                    suffix("c_name", 3).alias("suffix"))


@register("parse_dates", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def q_parse_dates(spark, sf_dir):
    """Text timestamps in four formats (chosen per priority) parsed back."""
    o = read_table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy/M/d H:mm"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "M/d/yyyy H:mm"))
            .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm")))
    return o.select("o_orderkey", parse_timestamp(text).alias("parsed"))


@register("calendar_parts", """SELECT o_orderkey, year(o_orderdate) AS year,
  dayofyear(o_orderdate) AS doy FROM orders""")
def q_calendar_parts(spark, sf_dir):
    """B15 + B16: calendar year and day of year."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"),
                    F.dayofyear("o_orderdate").cast("long").alias("doy"))


@register("ship_duration", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  date_diff('microsecond', o.o_orderdate, l.l_shipdate) / 60000000.0 + 1.0 AS minutes
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_ship_duration(spark, sf_dir):
    """Inclusive duration in minutes between two timestamps."""
    from eventlab.functions.columns import duration_minutes
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                      "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    duration_minutes("o_orderdate", "l_shipdate").alias("minutes"))


@register("factor_codes", """SELECT o_orderkey, CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM',
  '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS INTEGER) AS code FROM orders""")
def q_factor_codes(spark, sf_dir):
    """Ordered factor codes from an explicit level list."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", factor_code("o_orderpriority", PRIORITY_LEVELS).alias("code"))


@register("split_keys", with_ctes([SQL_MODEL], """SELECT DISTINCT SiteID || ':' || crop || ':' ||
  CAST(Year AS VARCHAR) AS grp, SiteID AS a, crop AS b, CAST(Year AS VARCHAR) AS c FROM model"""))
def q_split_keys(spark, sf_dir):
    """A composite key split into its parts."""
    m = model_table(spark, sf_dir).select(
        F.concat_ws(":", "SiteID", "crop", F.col("Year").cast("string")).alias("grp")).distinct()
    return split_key(m, "grp", ["a", "b", "c"])


@register("join_suffixes", with_ctes([SQL_MODEL,
    "li AS (SELECT SiteID, Year, count(*) AS n, avg(price) AS v FROM model GROUP BY ALL)",
    """od AS (SELECT n.n_name AS SiteID, year(o.o_orderdate) AS Year, count(*) AS n,
         avg(o.o_totalprice) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
         JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL)"""],
    """SELECT li.SiteID, li.Year, li.n AS n_x, li.v AS v_x, od.n AS n_y, od.v AS v_y
  FROM li LEFT JOIN od ON li.SiteID = od.SiteID AND li.Year = od.Year"""))
def q_join_suffixes(spark, sf_dir):
    """B20 + D1: left join of two tables with clashing column names,
    resolved with suffixes."""
    m = model_table(spark, sf_dir)
    li = m.groupBy("SiteID", "Year").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("v"))
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    od = (read_table(spark, sf_dir, "orders")
          .join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
          .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
          .groupBy(F.col("n_name").alias("SiteID"), F.year("o_orderdate").cast("long").alias("Year"))
          .agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("v")))
    return join_resolve(li, od, ["SiteID", "Year"], "left", suffixes=("_x", "_y"))


# --------------------------------------------------------- filters

@register("filter_range", """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
  WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate < TIMESTAMP '1997-01-01'""")
def q_filter_range(spark, sf_dir):
    """Comparison / range filter (pushed to the parquet scan)."""
    li = read_table(spark, sf_dir, "lineitem")
    return where_all(li, F.col("l_quantity").between(10, 20),
                     F.col("l_shipdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
                     ).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@register("exclude_site_years", with_ctes([SQL_MODEL], """SELECT SiteID, Year, count(*) AS n
  FROM model WHERE NOT (SiteID = 'CHINA') AND NOT (SiteID = 'FRANCE' AND Year = 1996)
  AND NOT (SiteID = 'JAPAN' AND Year = 1999) GROUP BY ALL"""))
def q_exclude_site_years(spark, sf_dir):
    """Exclusion list of (site, year) pairs with wildcards, as broadcast
    anti joins, before the aggregate."""
    m = model_table(spark, sf_dir)
    kept = exclude(m, NATION_YEAR_EXCLUSIONS, ["SiteID", "Year"])
    return kept.groupBy("SiteID", "Year").agg(F.count(F.lit(1)).alias("n"))


@register("keep_listed", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_keep_listed(spark, sf_dir):
    """Inclusion list as a semi join."""
    ids = (read_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
           .select(F.col("c_custkey").alias("o_custkey")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return keep_ids(o, ids, "o_custkey")


@register("drop_missing", """SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem
  WHERE l_discount <> 0""")
def q_drop_missing(spark, sf_dir):
    """Rows with NULL (placeholder zero) removed."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                      "l_discount")
    return drop_null(zero_to_null(li, ["l_discount"]), ["l_discount"])


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def q_distinct_rows(spark, sf_dir):
    """Whole-row de-duplication."""
    return distinct_rows(read_table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_tax"))


@register("distinct_keys", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def q_distinct_keys(spark, sf_dir):
    """De-duplication on projected keys."""
    return distinct_keys(read_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@register("first_line_per_order", """SELECT * EXCLUDE (_k) FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
   l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS _k FROM lineitem) WHERE _k = 1""")
def q_first_line_per_order(spark, sf_dir):
    """First row per key in an explicit order (ties broken by the other
    columns), planned as a partial min-aggregate."""
    return keep_first(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"])


# ------------------------------------------------------------ joins (D)

@register("inner_join_keys", with_ctes([SQL_MODEL,
    "a AS (SELECT SiteID, Year, crop, Treatment, avg(price) AS mean_price FROM model GROUP BY ALL)",
    "b AS (SELECT SiteID, Year, crop, Treatment, count(*) AS n FROM model WHERE qty > 25 GROUP BY ALL)"],
    "SELECT * FROM a JOIN b USING (SiteID, Year, crop, Treatment)"))
def q_inner_join_keys(spark, sf_dir):
    """D3: inner join on four keys. Both sides come from one pass over the
    model table (staged cells) and are partitioned by the same keys."""
    keys = ["SiteID", "Year", "crop", "Treatment"]
    cells = stage(model_table(spark, sf_dir).groupBy(*keys).agg(
        F.avg("price").alias("mean_price"), F.count_if(F.col("qty") > 25).alias("n")), "join-cells")
    return cells.select(*keys, "mean_price").join(cells.where("n > 0").select(*keys, "n"), keys, "inner")


@register("attach_region", """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_attach_region(spark, sf_dir):
    """Lookup join of dimension attributes (nation, region: fixed-size
    dimensions of 25 and 5 rows, broadcast)."""
    nr = (read_table(spark, sf_dir, "nation")
          .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
          .select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return attach(c, F.broadcast(nr), ["c_nationkey"]).select("c_custkey", "n_name", "r_name")


# ------------------------------------------------------------ reshape (G)

PIVOT_SQL = with_ctes([SQL_MODEL,
    "cell AS (SELECT SiteID, Treatment, avg(price) AS v FROM model GROUP BY ALL)"],
    """SELECT SiteID, max(v) FILTER (WHERE Treatment = 'A') AS A,
  max(v) FILTER (WHERE Treatment = 'N') AS N, max(v) FILTER (WHERE Treatment = 'R') AS R
  FROM cell GROUP BY SiteID""")


def _flag_means(spark, sf_dir):
    cell = model_table(spark, sf_dir).groupBy("SiteID", "Treatment").agg(F.avg("price").alias("v"))
    return pivot_wider(cell, ["SiteID"], "Treatment", "v", ["A", "N", "R"])


@register("pivot_flags", PIVOT_SQL)
def q_pivot_flags(spark, sf_dir):
    """G1: long -> wide, mean price per site with one column per flag."""
    return _flag_means(spark, sf_dir)


@register("unpivot_flags", with_ctes([SQL_MODEL],
    "SELECT SiteID, Treatment AS flag, avg(price) AS v FROM model GROUP BY ALL"))
def q_unpivot_flags(spark, sf_dir):
    """Wide -> long, back from the pivot."""
    return pivot_longer(_flag_means(spark, sf_dir), ["SiteID"], ["A", "N", "R"], "flag", "v")


@register("sorted_totals", with_ctes([SQL_MODEL],
    "SELECT SiteID, Year, sum(price) AS total FROM model GROUP BY ALL ORDER BY total DESC, SiteID, Year"))
def q_sorted_totals(spark, sf_dir):
    """Global sort (range partitioned)."""
    t = model_table(spark, sf_dir).groupBy("SiteID", "Year").agg(F.sum("price").alias("total"))
    return sort_by(t, F.col("total").desc(), "SiteID", "Year")


@register("append_totals", with_ctes([SQL_MODEL],
    """SELECT CAST(Year AS VARCHAR) AS label, sum(price) AS total FROM model GROUP BY Year
  UNION ALL SELECT 'all' AS label, sum(price) AS total FROM model"""))
def q_append_totals(spark, sf_dir):
    """Append rows (a grand-total row under the per-year rows, from them)."""
    per = stage(model_table(spark, sf_dir).groupBy(F.col("Year").cast("string").alias("label"))
                .agg(F.sum("price").alias("total")), "year-totals")
    allrow = per.agg(F.sum("total").alias("total")).withColumn("label", F.lit("all"))
    return append_rows(per, allrow)


@register("complete_cells", with_ctes([SQL_MODEL,
    "big AS (SELECT Year, crop, count(*) AS n FROM model WHERE qty >= 49.5 AND discount >= 0.09 GROUP BY ALL)",
    "ys AS (SELECT DISTINCT Year FROM model)",
    "cs AS (SELECT DISTINCT crop FROM model)"],
    "SELECT ys.Year, cs.crop, coalesce(big.n, 0) AS n FROM ys, cs LEFT JOIN big ON big.Year = ys.Year AND big.crop = cs.crop"))
def q_complete_cells(spark, sf_dir):
    """Every Year x crop cell present, 0 where no rows qualify. One
    aggregate gives the levels (bounded factor lists) and the counts."""
    cells = stage(model_table(spark, sf_dir).groupBy("Year", "crop").agg(
        F.count_if((F.col("qty") >= 49.5) & (F.col("discount") >= 0.09)).alias("n")), "year-crop")
    return complete_cells(cells.where("n > 0"), {"Year": levels_of(cells, "Year"), "crop": levels_of(cells, "crop")},
                          fill={"n": 0})


@register("box_stats", with_ctes([SQL_MODEL,
    """q AS (SELECT Treatment, count(price) AS n, min(price) AS min, max(price) AS max,
        quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
        quantile_cont(price, 0.75) AS q3 FROM model GROUP BY Treatment)""",
    "q2 AS (SELECT *, q3 - q1 AS iqr FROM q)"],
    """SELECT q2.Treatment, n, min, max, q1, median, q3, iqr,
  min(price) FILTER (WHERE price >= q1 - 1.5 * iqr) AS lower_whisker,
  max(price) FILTER (WHERE price <= q3 + 1.5 * iqr) AS upper_whisker,
  count(price) FILTER (WHERE price < q1 - 1.5 * iqr OR price > q3 + 1.5 * iqr) AS n_outliers
  FROM q2 JOIN model USING (Treatment) GROUP BY ALL"""))
def q_box_stats(spark, sf_dir):
    """Boxplot summary of price per return flag."""
    return box_stats(model_table(spark, sf_dir), ["Treatment"], "price")


@register("unknown_flag_box_stats", with_ctes([SQL_MODEL,
    "nm AS (SELECT nullif(Treatment, 'N') AS Treatment, -price AS price FROM model)",
    """q AS (SELECT Treatment, count(price) AS n, min(price) AS min, max(price) AS max,
        quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
        quantile_cont(price, 0.75) AS q3 FROM nm GROUP BY Treatment)""",
    "q2 AS (SELECT *, q3 - q1 AS iqr FROM q)"],
    """SELECT q2.Treatment, n, min, max, q1, median, q3, iqr,
  min(price) FILTER (WHERE price >= q1 - 1.5 * iqr) AS lower_whisker,
  max(price) FILTER (WHERE price <= q3 + 1.5 * iqr) AS upper_whisker,
  count(price) FILTER (WHERE price < q1 - 1.5 * iqr OR price > q3 + 1.5 * iqr) AS n_outliers
  FROM q2 JOIN nm ON nm.Treatment IS NOT DISTINCT FROM q2.Treatment GROUP BY ALL"""))
def q_unknown_flag_box_stats(spark, sf_dir):
    """G7 where a flag is not known: NULL is a group; values below zero."""
    m = model_table(spark, sf_dir).select(F.nullif("Treatment", F.lit("N")).alias("Treatment"), (-F.col("price")).alias("price"))
    return box_stats(m, ["Treatment"], "price")


@register("unknown_crop_cells", with_ctes([SQL_MODEL,
    "nm AS (SELECT Year, nullif(crop, '5-LOW') AS crop, qty, discount FROM model)",
    "big AS (SELECT Year, crop, count(*) AS n FROM nm WHERE qty >= 49.5 AND discount >= 0.09 GROUP BY ALL)",
    "ys AS (SELECT DISTINCT Year FROM nm)",
    "cs AS (SELECT DISTINCT crop FROM nm)"],
    """SELECT ys.Year, cs.crop, coalesce(big.n, 0) AS n FROM ys, cs
  LEFT JOIN big ON big.Year = ys.Year AND big.crop IS NOT DISTINCT FROM cs.crop"""))
def q_unknown_crop_cells(spark, sf_dir):
    """G5 where a level is not known: NULL is a level and keeps its count."""
    m = model_table(spark, sf_dir).withColumn("crop", F.nullif("crop", F.lit("5-LOW")))
    cells = stage(m.groupBy("Year", "crop").agg(
        F.count_if((F.col("qty") >= 49.5) & (F.col("discount") >= 0.09)).alias("n")), "year-crop")
    return complete_cells(cells.where("n > 0"), {"Year": levels_of(cells, "Year"), "crop": levels_of(cells, "crop")},
                          fill={"n": 0})
