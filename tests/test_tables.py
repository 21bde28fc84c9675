"""Joins, filters, reshape, columns and sources on literal frames, with
brute-force checks."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.functions.columns import (
    clamp_nonnegative,
    duration_minutes,
    factor_code,
    parse_timestamp,
    rate,
    recode,
    zero_to_null,
)
from eventlab.operators.filters import exclude, keep_first
from eventlab.operators.joins import interval_join, overlap_join
from eventlab.operators.reshape import box_stats, complete_cells, pivot_longer, pivot_wider
from eventlab.session import stage_path
from eventlab.sources.files import read_delimited, read_quarantined

T0 = datetime(2024, 1, 1)


def _random_intervals(rng, n, site):
    out, t = [], 0
    for i in range(n):
        t += rng.randint(1, 3000)
        length = rng.choice([0, 15, 600, 2000, 4000])     # some span several day buckets
        out.append((site, i, T0 + timedelta(minutes=t), T0 + timedelta(minutes=t + length)))
        t += length
    return out


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(11)
    ivs = _random_intervals(rng, 30, "A") + _random_intervals(rng, 20, "B")
    pts = [(s, f"p{i}", T0 + timedelta(minutes=rng.randint(0, 60000))) for i, s in
           enumerate(rng.choice("AB") for _ in range(300))]
    pts += [(s, f"e{i}", st) for i, (s, _, st, _) in enumerate(ivs[:5])]       # on the edges
    pts += [(s, f"f{i}", en) for i, (s, _, _, en) in enumerate(ivs[5:10])]
    iv = spark.createDataFrame(ivs, "site string, ev int, t0 timestamp_ntz, t1 timestamp_ntz")
    pt = spark.createDataFrame(pts, "site string, pid string, t timestamp_ntz")
    got = sorted((r["pid"], r["ev"]) for r in interval_join(pt, iv, ["site"], "t", "t0", "t1").collect())
    want = sorted((p, e) for s, p, t in pts for s2, e, a, b in ivs if s == s2 and a <= t <= b)
    assert got == want
    left = interval_join(pt, iv, ["site"], "t", "t0", "t1", how="left")
    assert left.count() == len(want) + len({p for _, p, _ in pts} - {p for p, _ in want})


def test_overlap_join_each_pair_once(spark):
    rng = random.Random(5)
    a = _random_intervals(rng, 25, "A")
    b = [(s, i + 100, x, y) for s, i, x, y in _random_intervals(random.Random(9), 25, "A")]
    da = spark.createDataFrame(a, "site string, ia int, a0 timestamp_ntz, a1 timestamp_ntz")
    db = spark.createDataFrame(b, "site string, ib int, b0 timestamp_ntz, b1 timestamp_ntz")
    got = sorted((r["ia"], r["ib"]) for r in overlap_join(da, db, ["site"], "a0", "a1", "b0", "b1").collect())
    want = sorted((i, j) for _, i, x0, x1 in a for _, j, y0, y1 in b if x0 <= y1 and y0 <= x1)
    assert got == want


def test_exclude_with_wildcards(spark):
    df = spark.createDataFrame([(s, y) for s in ("A", "B", "C") for y in (2016, 2017)],
                               "site string, year int")
    out = exclude(df, [("C", None), ("A", 2016)], ["site", "year"])
    assert sorted(tuple(r) for r in out.collect()) == [("A", 2017), ("B", 2016), ("B", 2017)]


def test_keep_first_is_first_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 20), rng.randint(1, 5), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = {r["k"]: (r["o"], r["v"]) for r in keep_first(df, ["k"], ["o"]).collect()}
    want = {}
    for k, o, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, (o, v))
    assert got == want


def test_column_rules(spark):
    df = spark.createDataFrame([("arm", -1.0, 0.0), ("eia", 2.0, 4.0), (None, None, None),
                                ("zzz", 0.0, 2.0)], "site string, x double, d double")
    out = df.select(recode("site", {"arm": "ARM", "eia": "EIA"}, "site").alias("s"),
                    rate("x", "d").alias("r"), factor_code("site", ["eia", "arm"]).alias("c"))
    assert [tuple(r) for r in out.collect()] == [("ARM", None, 2), ("EIA", 0.5, 1),
                                                 (None, None, None), ("site", 0.0, None)]
    cl = clamp_nonnegative(df.select("x"), ["x"]).collect()
    assert [r["x"] for r in cl] == [0.0, 2.0, None, 0.0]
    zn = zero_to_null(df.select("d"), ["d"]).collect()
    assert [r["d"] for r in zn] == [None, 4.0, None, 2.0]


def test_parse_timestamp_formats(spark):
    df = spark.createDataFrame([("2016-04-30 08:15:00",), ("4/30/2016 8:15",), ("2016/4/30 8:15",),
                                ("2016-04-30T08:15",), ("not a time",)], "s string")
    got = [r["t"] for r in df.select(parse_timestamp("s").alias("t")).collect()]
    assert got[:4] == [datetime(2016, 4, 30, 8, 15)] * 4 and got[4] is None
    d = spark.createDataFrame([(datetime(2016, 4, 30, 8, 15), datetime(2016, 4, 30, 9, 0))],
                              "a timestamp_ntz, b timestamp_ntz")
    assert d.select(duration_minutes("a", "b")).first()[0] == pytest.approx(46.0)


def test_csv_na_tokens_and_quarantine(spark, tmp_path):
    text = ("sampleID,Year,precipitation,date_time\n"
            "1001,2016,NA,2016-04-30 08:15:00\n"
            "SPL1052,2017,0.5,4/30/2017 8:15\n"
            "<<<<<<< HEAD\n"
            "NS,2018,abc,2018-01-01 00:00:00\n"
            "=======\n"
            "sampleID,Year,precipitation,date_time\n"
            "1003,2019,0.1,garbage\n"
            ">>>>>>> other\n")
    path = os.path.join(stage_path(spark, "qtest"), "data.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    schema = "sampleID string, Year int, precipitation double, date_time timestamp_ntz"
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema)
    good, bad = read_quarantined(spark, path, st)
    g = sorted(tuple(r) for r in good.collect())
    assert g == [("1001", 2016, None, datetime(2016, 4, 30, 8, 15)),
                 ("SPL1052", 2017, 0.5, datetime(2017, 4, 30, 8, 15))]
    # markers (3), bad number, bad timestamp; Spark's CSV reader already drops
    # lines equal to the header, so the repeated header is not a row at all
    assert bad.count() == 5
    plain = read_delimited(spark, path, st).where(F.col("sampleID") == "1001").first()
    assert plain["precipitation"] is None


def test_pivot_roundtrip_and_complete(spark):
    df = spark.createDataFrame([("s1", "A", 1.0), ("s1", "R", 2.0), ("s2", "A", 3.0)],
                               "site string, flag string, v double")
    wide = pivot_wider(df, ["site"], "flag", "v", ["A", "R"])
    assert sorted(tuple(r) for r in wide.collect()) == [("s1", 1.0, 2.0), ("s2", 3.0, None)]
    long = pivot_longer(wide, ["site"], ["A", "R"], "flag", "v").dropna()
    assert long.count() == 3
    full = complete_cells(df, {"site": None, "flag": ["A", "N", "R"]}, fill={"v": 0.0})
    assert full.count() == 6 and full.where("v = 0.0").count() == 3


def test_box_stats_quartiles(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double")
    r = box_stats(df, ["g"], "x").first()
    assert (r["q1"], r["median"], r["q3"]) == (3.0, 5.0, 7.0)
    assert r["upper_whisker"] == 8.0 and r["n_outliers"] == 1


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from eventlab.operators.reshape import exact_quantiles
    rng = random.Random(13)
    rows = [(g, float(rng.choice([rng.gauss(0, 1), 1.0, 2.5]))) for g in "abc" for _ in range(rng.randint(1, 3000))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for pieces in (1, 7, None):
        out = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", probs, pieces).collect()}
        for g in "abc":
            xs = np.array([v for h, v in rows if h == g])
            for i, p in enumerate(probs):
                assert out[g][f"q{i}"] == pytest.approx(float(np.quantile(xs, p)), abs=1e-12)


def test_box_stats_with_one_value_in_most_rows(spark):
    import numpy as np
    vals = [0.0] * 9000 + [float(k % 37) - 5 for k in range(1000)]
    r = box_stats(spark.createDataFrame([("g", v) for v in vals], "g string, x double"), ["g"], "x").first()
    q1, m, q3 = (float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75))
    assert (r["q1"], r["median"], r["q3"], r["n"]) == (q1, m, q3, 10000)
    assert r["n_outliers"] == sum(v != 0 for v in vals) and (r["min"], r["max"]) == (min(vals), max(vals))


def test_blank_header_cells_with_declared_schema(spark):
    from pyspark.sql.types import StructType
    text = ('"sampleID","","","date_time","rain"\n'
            '"1001",,"x",4/30/2016 8:15,0.5\n'
            '"NS",1,,2016-04-30 08:20:00,NA\n')
    path = os.path.join(stage_path(spark, "blank-header"), "data.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    st = StructType.fromDDL("sampleID string, c1 string, c2 string, date_time timestamp_ntz, rain double")
    rows = sorted(tuple(r) for r in read_delimited(spark, path, st).collect())
    assert rows == [("1001", None, "x", datetime(2016, 4, 30, 8, 15), 0.5),
                    ("NS", "1", None, datetime(2016, 4, 30, 8, 20), None)]


def test_overlap_totals_match_pairs(spark):
    from eventlab.operators.joins import overlap_totals
    rng = random.Random(6)
    a = [("s", i, T0 + timedelta(minutes=x), T0 + timedelta(minutes=x + rng.choice([0, 30, 5000])))
         for i, x in enumerate(rng.sample(range(0, 9000, 30), 60))]
    b = [("s", float(k), T0 + timedelta(minutes=x), T0 + timedelta(minutes=x + rng.choice([0, 60, 4000])))
         for k, x in enumerate(rng.sample(range(0, 9000, 30), 50))]
    da = spark.createDataFrame(a, "site string, ia long, a0 timestamp_ntz, a1 timestamp_ntz")
    db = spark.createDataFrame(b, "site string, v double, b0 timestamp_ntz, b1 timestamp_ntz")
    got = {r["ia"]: (r["n"], r["v"]) for r in overlap_totals(da, db, ["site"], "a0", "a1", "b0", "b1", {"v": "v"}, "n").collect()}
    for _, i, s0, s1 in a:
        hit = [v for _, v, b0, b1 in b if b0 <= s1 and s0 <= b1]
        assert got[i] == (len(hit), pytest.approx(sum(hit)) if hit else None)


def test_quantiles_of_extreme_values_and_null_groups(spark):
    import numpy as np
    from eventlab.operators.reshape import box_stats, exact_quantiles, order_key
    rng = random.Random(17)
    pool = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1e-310, -1e-310, 1.0, 2.0, 4.0, np.nextafter(2.0, 0), np.nextafter(2.0, 3),
            1.7976931348623157e308, -1.7976931348623157e308, 1e300, -3.5, -1.0, 0.1, 1024.0, np.nextafter(1024.0, 0)]
    every = [float(v) for v in pool] + [rng.gauss(0, 10 ** rng.randint(-300, 300)) for _ in range(300)] + [float("inf"), float("-inf"), float("nan")]
    keyed = spark.createDataFrame([(v,) for v in every], "x double").select("x", order_key(F.col("x")).alias("k")).collect()
    for a, b in zip(sorted(keyed, key=lambda r: r["k"]), sorted(keyed, key=lambda r: r["k"])[1:]):
        assert (a["x"] < b["x"]) == (a["k"] < b["k"]) or b["x"] != b["x"] or a["x"] == b["x"]
    rows = [(g, rng.choice([rng.gauss(0, 1), 2.5, -1e9])) for g in ("a", None) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert set(out) == {"a", None, "one"}
    for g in ("a", None):
        xs = np.array([v for h, v in rows if h == g])
        for i, p in enumerate([0.0, 0.25, 0.5, 1.0]):
            assert out[g][f"q{i}"] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12)
    box = {r["g"]: r for r in box_stats(df, ["g"], "x").collect()}
    assert set(box) == {"a", None, "one"} and box["one"]["min"] == box["one"]["q3"] == 3.0 and box["one"]["n_outliers"] == 0


def test_complete_cells_keep_null_levels(spark):
    from eventlab.operators.reshape import complete_cells
    df = spark.createDataFrame([(None, 1, 7), ("a", 2, 8)], "g string, y int, n long")
    got = {(r["g"], r["y"]): r["n"] for r in complete_cells(df, {"g": None, "y": None}, fill={"n": 0}).collect()}
    assert got == {(None, 1): 7, (None, 2): 0, ("a", 1): 0, ("a", 2): 8}
