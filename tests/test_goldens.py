"""Golden input/output relations of the field study, with a few of its
published values copied into literal frames (fixed values)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlab.functions.columns import duration_minutes, ln_offset, rate
from eventlab.operators.events import window_per_key
from eventlab.operators.filters import above


def test_sample_window_duration(spark):
    # sampleID, sampStart, sampEnd, rain_time (minutes).
    rows = [("1000", datetime(2016, 4, 30, 8, 15), datetime(2016, 4, 30, 19, 45), 691.0),
            ("1001", datetime(2016, 4, 27, 2, 5), datetime(2016, 5, 1, 9, 40), 6216.0),
            ("1002", datetime(2016, 4, 30, 13, 5), datetime(2016, 5, 1, 14, 5), 1501.0)]
    df = spark.createDataFrame(rows, "sampleID string, s timestamp_ntz, e timestamp_ntz, rain_time double")
    got = [r[0] for r in df.select(duration_minutes("s", "e") - F.col("rain_time")).collect()]
    assert got == [0.0, 0.0, 0.0]
    # the same via the per-key window operator on the two end rows
    ends = df.select("sampleID", F.explode(F.array("s", "e")).alias("t"), F.lit(0.0).alias("v"))
    w = {r["sampleID"]: r["rain_time"] for r in window_per_key(ends, ["sampleID"], "t", "v").collect()}
    assert w == {"1000": 691.0, "1001": 6216.0, "1002": 1501.0}


def test_runoff_rollup_and_three_way_join(spark):
    # Per (sample, runoff event) totals, and rain events of the sample.
    ro = spark.createDataFrame(
        [(2016, "ARM", "control", "1001", 8, 6.10688368220422, 7085.378, 2511.0),
         (2016, "ARM", "control", "1001", 10, 6.00900538043084, 6969.413, 1796.0)],
        "Year int, SiteID string, Treatment string, sampleID string, ro_event int, "
        "tss_sum double, flow double, flow_time double")
    rf = spark.createDataFrame(
        [(2016, "ARM", 5, 11.0, 3.85, "1001"), (2016, "ARM", 6, 33.0, 2.51666666666667, "1001"),
         (2016, "ARM", 7, 33.0, 6.01666666666667, "1001")],
        "Year int, SiteID string, rf_event int, rain_mm double, rain_hr double, sampleID string")
    per = (ro.groupBy("Year", "SiteID", "Treatment", "sampleID")
           .agg(F.sum("tss_sum").alias("tss_sum"), F.sum("flow").alias("flow_sum"),
                F.sum("flow_time").alias("flow_min"), F.count(F.lit(1)).alias("ro_count")))
    per = above(per, "tss_sum", 3.977139e-6)
    out = (per.join(rf.drop("Year"), ["SiteID", "sampleID"])
           .withColumn("rf_rate", rate("rain_mm", "rain_hr")).orderBy("rf_event").collect())
    assert len(out) == 3
    assert out[0]["tss_sum"] == pytest.approx(12.1158890626351, abs=1e-10)
    assert out[0]["flow_sum"] == pytest.approx(14054.791) and out[0]["flow_min"] == 4307
    assert out[0]["ro_count"] == 2
    assert [r["rf_rate"] for r in out] == pytest.approx([2.85714285714286, 13.112582781457,
                                                         5.48476454293629], rel=1e-12)


def test_seasonal_rollup_and_offset_logs(spark):
    # Per-season loads of one site-year and the yearly totals.
    seasons = spark.createDataFrame(
        [(2017, "ARM", "control", 1, 9.2237769, 0.071), (2017, "ARM", "control", 3, 19.781666537, 0.09)],
        "Year int, SiteID string, Treatment string, Time int, tss_sum double, rain double")
    year = (seasons.groupBy("Year", "SiteID", "Treatment")
            .agg(F.sum("tss_sum").alias("tss_sum"), F.sum("rain").alias("rain")).first())
    assert year["tss_sum"] == pytest.approx(29.005443437, abs=1e-12)
    assert year["rain"] == pytest.approx(0.161, abs=1e-12)
    ln_t = [r[0] for r in seasons.select(ln_offset("tss_sum", 0.036)).orderBy("Time").collect()]
    assert ln_t == pytest.approx([2.2256799554952797, 2.986573789226096], abs=1e-12)
    ln_y = seasons.sparkSession.createDataFrame([(year["tss_sum"],)], "t double").select(
        ln_offset("t", 0.049)).first()[0]
    assert ln_y == pytest.approx(3.369171429845407, abs=1e-9)
