"""Event segmentation and series operators against a plain-Python model of
the study's run-length rules (each NULL is its own run)."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators.events import (
    gap_events,
    regular_grid,
    run_lengths,
    segment_events,
    session_events,
    summarize_events,
    threshold_sweep,
)


def rle(xs):
    runs = []
    for x in xs:
        if runs and x is not None and runs[-1][0] is not None and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    return runs


def simulate(values, k):
    wet = [None if v is None else (1 if v > 0 else 0) for v in values]
    lengths = [n for _, n in rle(wet) for _ in range(n)]
    flags = []
    for i, (w, n) in enumerate(zip(wet, lengths)):
        if w is None:
            f = None
        elif i + 1 < k and w == 0:
            f = 0
        elif w == 1 or n < k:
            f = 1
        else:
            f = 0
        flags.append(f)
    ids = [i for i, (_, n) in enumerate(rle(flags), start=1) for _ in range(n)]
    return flags, ids


def _segment(spark, series: dict, k):
    rows = [(key, t, None if v is None else float(v)) for key, vals in series.items()
            for t, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "key string, t int, value double")
    out = segment_events(df, ["key"], ["t"], "value", k).orderBy("key", "t").collect()
    got = {}
    for r in out:
        got.setdefault(r["key"], ([], []))
        got[r["key"]][0].append(r["eventflag"])
        got[r["key"]][1].append(r["eventid"])
    return got


FIXTURE_CASES = [
    ([1, 0, 0, 1], [1, 0, 1, 1]),
    ([1, 1, 1, 0, 0, 1], [1, 1, 1, 1, 1, 1]),
    ([1, 1, 1, 0, 0, 0, 1], [1, 1, 1, 0, 0, 0, 1]),
    ([0, 0, 1, 1], [0, 0, 1, 1]),
    ([1, 1, 1, 0], [1, 1, 1, 1]),
    ([1, 1, 1, 0, None, 0, 1], [1, 1, 1, 1, None, 1, 1]),
]


def test_fixture_cases_k3(spark):
    got = _segment(spark, {f"c{i}": v for i, (v, _) in enumerate(FIXTURE_CASES)}, 3)
    for i, (vals, flags) in enumerate(FIXTURE_CASES):
        assert got[f"c{i}"][0] == flags, (vals, got[f"c{i}"])
    # NULL is its own run and splits the event
    assert got["c5"][1] == [1, 1, 1, 1, 2, 3, 3]


def test_segmentation_matches_simulation(spark):
    rng = random.Random(7)
    edge = {"all_dry": [0] * 9, "all_wet": [1.5] * 7, "one_row": [2.0], "one_dry": [0],
            "exactly_k": [1, 0, 0, 0, 1], "null_only": [None, None], "lead_null": [None, 0, 1]}
    for k in (1, 2, 3, 4, 6):
        series = dict(edge)
        for i in range(40):
            n = rng.randint(1, 40)
            series[f"r{i}"] = [rng.choice([None, 0, 0, 0, 0.5, 2.0]) for _ in range(n)]
        got = _segment(spark, series, k)
        for key, vals in series.items():
            assert got[key] == simulate(vals, k), (k, key, vals)


def test_run_lengths(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, None, None, 0, 0])],
                               "k string, t int, f int")
    out = run_lengths(df, ["k"], ["t"], "f").orderBy("t").collect()
    assert [r["run_id"] for r in out] == [1, 1, 2, 3, 4, 5, 5]
    assert [r["run_length"] for r in out] == [2, 2, 1, 1, 1, 2, 2]


def test_threshold_sweep_equals_single_runs(spark):
    rng = random.Random(3)
    series = {f"s{i}": [rng.choice([0, 0, 0, 1.0]) for _ in range(30)] for i in range(6)}
    rows = [(k, t, float(v)) for k, vals in series.items() for t, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "key string, t int, value double")
    sweep = threshold_sweep(df, ["key"], ["t"], "value", [2, 3, 5]).collect()
    for K in (2, 3, 5):
        single = {(r["key"], r["t"]): (r["eventflag"], r["eventid"])
                  for r in segment_events(df, ["key"], ["t"], "value", K).collect()}
        for r in sweep:
            if r["K"] == K:
                assert single[(r["key"], r["t"])] == (r["eventflag"], r["eventid"])


def test_summary_strict_nulls_and_duration(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(minutes=5 * i), v, 1, 1) for i, v in enumerate([1.0, 2.0, None])]
    df = spark.createDataFrame(rows, "k string, date_time timestamp_ntz, rain double, eventflag int, eventid long")
    out = summarize_events(df, ["k"], "rain", "date_time", "precipitation", "rain_time").first()
    assert out["precipitation"] is None           # R's sum without na.rm
    assert out["rain_time"] == pytest.approx(11.0)  # 10 minutes + 1
    skip = summarize_events(df, ["k"], "rain", "date_time", "p", "d", na="skip").first()
    assert skip["p"] == pytest.approx(3.0)


def test_gap_events_and_session_window_agree(spark):
    t0 = datetime(2024, 1, 1)
    mins = [0, 30, 90, 151, 200, 400, 460]          # gaps 30, 60, 61, 49, 200, 60
    df = spark.createDataFrame([("a", t0 + timedelta(minutes=m), 1.0) for m in mins],
                               "k string, ts timestamp_ntz, v double")
    ev = [r["event"] for r in gap_events(df, ["k"], "ts", 60).orderBy("ts").collect()]
    assert ev == [0, 0, 0, 1, 1, 2, 2]              # exactly 60 stays in the event
    sess = session_events(df, ["k"], "ts", 60, [F.count(F.lit(1)).alias("n")])
    assert sorted(r["n"] for r in sess.collect()) == [2, 2, 3]


def test_regular_grid_zero_fill(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0, 1.0), ("a", t0 + timedelta(minutes=7), 2.0), ("a", t0 + timedelta(minutes=46), 4.0),
            ("b", t0 + timedelta(minutes=20), 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    g = regular_grid(df, ["k"], "ts", {"v": F.col("v")}, 900).orderBy("k", "date_time").collect()
    assert [(r["k"], r["date_time"].minute, r["v"]) for r in g] == [
        ("a", 0, 3.0), ("a", 15, 0.0), ("a", 30, 0.0), ("a", 45, 4.0), ("b", 15, 3.0)]


def test_gap_events_random_against_python(spark):
    from eventlab.operators.events import gap_event_summary
    rng = random.Random(21)
    t0 = datetime(2024, 1, 1)
    rows = []
    for key in ("a", "b", "c"):
        t = 0.0
        for i in range(120):
            t += rng.choice([0.5, 10, 59.9, 60, 60.01, 61, 200, 0.01])
            rows.append((key, t0 + timedelta(minutes=t), float(i)))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {(r["k"], r["ts"]): r["event"] for r in gap_events(df, ["k"], "ts", 60).collect()}
    want = {}
    for key in ("a", "b", "c"):
        ts = sorted(t for k, t, _ in rows if k == key)
        ev = 0
        for i, t in enumerate(ts):
            if i and (t - ts[i - 1]).total_seconds() / 60 > 60:
                ev += 1
            want[(key, t)] = ev
    assert got == want
    summ = gap_event_summary(df, ["k"], "ts", 60, "v").collect()
    assert sum(r["n"] for r in summ) == len(rows)
    assert len(summ) == len({(k, e) for (k, _), e in want.items()})


def test_chunked_segmentation_equals_whole_series(spark):
    from eventlab.operators.events import segment_events_chunked
    rng = random.Random(17)
    rows = []
    for s in range(25):
        n = rng.randint(1, 60)
        # long dry and wet stretches so runs cross several chunks
        vals, cur = [], rng.choice([0, 1.0])
        for _ in range(n):
            if rng.random() < 0.15:
                cur = rng.choice([0, 0, 1.0, None])
            vals.append(cur)
        rows += [(f"s{s}", t, None if v is None else float(v)) for t, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "key string, t int, value double")
    for k in (1, 3, 5):
        whole = {(r["key"], r["t"]): (r["eventflag"], r["eventid"])
                 for r in segment_events(df, ["key"], ["t"], "value", k).collect()}
        for width in (1, 2, 7):
            got = {(r["key"], r["t"]): (r["eventflag"], r["eventid"]) for r in segment_events_chunked(
                df, ["key"], ["t"], "value", k, F.floor(F.col("t") / width)).collect()}
            assert got == whole, (k, width)


def test_chunked_grid_equals_plain(spark):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), t0 + timedelta(minutes=rng.randint(0, 6000)), rng.random())
            for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    plain = sorted(tuple(r) for r in regular_grid(df, ["k"], "ts", {"v": F.col("v")}, 900).collect())
    chunked = sorted(tuple(r) for r in regular_grid(df, ["k"], "ts", {"v": F.col("v")}, 900,
                                                    chunk_seconds=3600 * 5).collect())
    assert plain == chunked


def test_trim_trailing_dry_run(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, 1.0, 0.0, 0.0])],
                               "key string, t int, value double")
    keep = [r["eventflag"] for r in segment_events(df, ["key"], ["t"], "value", 3).orderBy("t").collect()]
    trim = [r["eventflag"] for r in segment_events(df, ["key"], ["t"], "value", 3, trim=True)
            .orderBy("t").collect()]
    assert keep == [1, 1, 1, 1] and trim == [1, 1, 0, 0]


def test_total_order_guard(spark):
    from eventlab.operators.events import assert_total_order
    from eventlab.plans.shapes import series_grid
    assert_total_order(series_grid(spark, "/root/testdata/sf0.001"),
                       ["SiteID", "Treatment", "Year"], ["date_time"])
    tied = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "k string, t int, v double")
    with pytest.raises(ValueError):
        assert_total_order(tied, ["k"], ["t"])


def test_size_for_input(spark):
    from eventlab.session import size_for_input
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = size_for_input(spark, 100 << 40)          # 100 TiB of input
    try:
        if "spark.sql.shuffle.partitions" in applied:
            assert int(applied["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k in applied:
            if k != "spark.sql.shuffle.partitions":
                spark.conf.unset(k)


def test_missing_readings_stay_null_on_the_grid(spark):
    from eventlab.operators.events import regular_grid
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0, 1.0), ("a", t0 + timedelta(minutes=5), None), ("a", t0 + timedelta(minutes=6), 3.0),
            ("a", t0 + timedelta(minutes=15), 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    kept = regular_grid(df, ["k"], "ts", {"v": F.col("v")}, 300, missing={"v": F.col("v").isNull()})
    assert [r["v"] for r in kept.orderBy("date_time").collect()] == [1.0, None, 0.0, 2.0]
    plain = regular_grid(df, ["k"], "ts", {"v": F.col("v")}, 300)
    assert [r["v"] for r in plain.orderBy("date_time").collect()] == [1.0, 3.0, 0.0, 2.0]
