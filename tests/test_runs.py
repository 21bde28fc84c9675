"""Run tables against the plain-Python model of the run rules and against the
grid, on sparse, dense, missing and keyless series."""

import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from eventlab.operators.events import gap_event_summary, gap_events, segment_events, segment_events_chunked, summarize_events
from eventlab.operators.joins import overlap_totals
from eventlab.operators.runs import occupied_steps, run_events, run_table
from tests.test_events import simulate

T0 = datetime(2024, 1, 1)
STEP = 300


def _raw(series):
    """Raw rows of the series' occupied steps; None readings are missing, 'gap' is no row."""
    return [(k, T0 + timedelta(seconds=STEP * t + 7), None if v is None else float(v), v is None)
            for k, vals in series.items() for t, v in enumerate(vals) if v != "gap"]


def _expected(series, k, trim=False):
    out = []
    for key, vals in series.items():
        while vals and vals[-1] == "gap":
            vals = vals[:-1]
        first = next((i for i, v in enumerate(vals) if v != "gap"), None)
        if first is None:
            continue
        vals = [0 if v == "gap" else v for v in vals[first:]]
        flags, _ = simulate(vals, k)
        if trim:
            dry = len(vals) - next((i for i, v in enumerate(reversed(vals)) if v is None or v > 0), len(vals))
            flags = flags[:dry] + [0] * (len(vals) - dry)
        at, number = 0, 0
        for flag, run in groupby(enumerate(flags), key=lambda x: (x[1], x[0] if x[1] is None else None)):
            run = [i for i, _ in run]
            number += 1
            total = None if flag[0] is None else float(sum(vals[i] for i in run))
            out.append((key, number, flag[0], T0 + timedelta(seconds=STEP * (first + at)), len(run), total))
            at += len(run)
    return out


def _series(seed, n=40, values=("gap", "gap", "gap", 0, 0, None, 0.5, 2.0)):
    rng = random.Random(seed)
    series = {f"r{i}": [rng.choice(values) for _ in range(rng.randint(1, 60))] for i in range(n)}
    return series | {"all_dry": [0] * 9, "all_wet": [1.5] * 7, "one_row": [2.0], "one_dry": [0], "missing": [None, None],
                     "lead": ["gap", 0, "gap", "gap", 1.0], "long": [1.0, *["gap"] * 200, 1.0, *["gap"] * 90, 0],
                     None: [1.0, "gap", 0, 2.0, None, "gap", "gap", "gap", "gap", "gap", 1.0]}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))


def _steps(spark, series):
    df = spark.createDataFrame(_raw(series), "key string, ts timestamp_ntz, v double, lost boolean")
    return occupied_steps(df, ["key"], "ts", {"v": F.col("v")}, STEP, {"v": F.col("lost")})


@pytest.mark.parametrize("k", [1, 2, 3, 6])
@pytest.mark.parametrize("chunk", [None, 1, 5])
def test_run_table_is_the_model(spark, k, chunk):
    series = _series(k)
    got = run_table(_steps(spark, series), ["key"], "v", STEP, k, chunk_steps=chunk)
    assert got.columns == ["key", "eventid", "eventflag", "run_start", "n_steps", "total"]
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    assert _rows(got) == sorted(_expected(series, k), key=key)


def test_run_table_trimmed_and_events_only(spark):
    series = _series(11, 20)
    steps = _steps(spark, series)
    every = _expected(series, 4, trim=True)
    assert len(_rows(run_table(steps, ["key"], "v", STEP, 4, trim=True))) == len(every)
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    assert _rows(run_table(steps, ["key"], "v", STEP, 4, trim=True, events_only=True)) == sorted(
        [r for r in every if r[2] == 1], key=key)


def test_events_of_runs_equal_the_grid(spark):
    rng = random.Random(2)
    rows = [(f"s{i % 3}", i, T0 + timedelta(seconds=STEP * i), float(rng.choice([0, 0, 0, 1.5]))) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, i int, ts timestamp_ntz, v double")
    grid = df.where("key = 's0'").withColumn("key", F.lit("a"))
    grid = grid.withColumn("ts", F.timestamp_add("SECOND", F.col("i") * F.lit(-2 * STEP // 3), "ts"))
    want = summarize_events(segment_events(grid, ["key"], ["ts"], "v", 5), ["key"], "v", "ts", "total", "minutes")
    runs = run_table(occupied_steps(grid, ["key"], "ts", {"v": F.col("v")}, STEP), ["key"], "v", STEP, 5)
    got = run_events(runs, ["key"], STEP, "total", "minutes").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_series_have_no_runs(spark):
    df = spark.createDataFrame([], "key string, ts timestamp_ntz, v double, lost boolean")
    steps = occupied_steps(df, ["key"], "ts", {"v": F.col("v")}, STEP)
    assert run_table(steps, ["key"], "v", STEP, 3).count() == 0
    assert run_table(steps, ["key"], "v", STEP, 3, chunk_steps=4).count() == 0


def test_no_dry_step_becomes_a_row(spark):
    two = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(days=4000), 1.0)], "key string, ts timestamp_ntz, v double")
    steps = occupied_steps(two, ["key"], "ts", {"v": F.col("v")}, STEP)
    runs = run_table(steps, ["key"], "v", STEP, 72)
    assert "sequence" not in runs._jdf.queryExecution().toString()
    assert [(r["eventflag"], r["n_steps"]) for r in runs.orderBy("eventid").collect()] == [(1, 1), (0, 4000 * 288 - 1), (1, 1)]


# NULL is a key like any other, whichever form of an operator is used

def test_null_keys_in_both_forms(spark):
    rows = [(None, T0 + timedelta(minutes=m), 1.0) for m in (0, 30, 200)] + [("a", T0, 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    assert gap_events(df, ["k"], "ts", 60).count() == 4
    assert {(r["k"], r["event"], r["n"]) for r in gap_event_summary(df, ["k"], "ts", 60, "v").collect()} == {
        (None, 0, 2), (None, 1, 1), ("a", 0, 1)}
    grid = spark.createDataFrame([(None, t, v) for t, v in enumerate([1.0, 0.0, 0.0, 1.0, 0.0])] + [("a", 0, 1.0)], "k string, t int, v double")
    whole = segment_events(grid, ["k"], ["t"], "v", 3)
    parts = segment_events_chunked(grid, ["k"], ["t"], "v", 3, F.floor(F.col("t") / 2))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.select(*parts.columns).collect()))


def test_overlap_totals_keep_null_keys_and_repeated_rows(spark):
    d = lambda h: T0 + timedelta(hours=h)
    a = spark.createDataFrame([(None, 1, d(0), d(5)), (None, 1, d(0), d(5)), ("x", 2, d(50), d(51)), ("x", 3, d(0), d(100))],
                              "k string, i int, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(None, d(5), d(6), 2.0), (None, d(6), d(7), 4.0), ("x", d(1), d(2), 1.0), ("x", d(90), d(200), 8.0)],
                              "k string, bs timestamp_ntz, be timestamp_ntz, v double")
    got = overlap_totals(a, b, ["k"], "s", "e", "bs", "be", {"t": "v"}, "n")
    assert sorted((r["i"], r["n"], r["t"]) for r in got.collect()) == [(1, 1, 2.0), (1, 1, 2.0), (2, 0, None), (3, 2, 9.0)] or \
        sorted((r["i"], r["n"], str(r["t"])) for r in got.collect()) == [(1, 1, "2.0"), (1, 1, "2.0"), (2, 0, "None"), (3, 2, "9.0")]
