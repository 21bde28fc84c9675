"""The sweep join against brute force and the bucket join; text files read with
line numbers and reasons."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampNTZType

from eventlab.operators.joins import interval_join
from eventlab.operators.sweep import sweep_join
from eventlab.sources import files

T0 = datetime(2024, 1, 1)


def _tables(spark, seed, hot=0.5):
    rng = random.Random(seed)
    at = lambda hours: T0 + timedelta(hours=hours)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", None])
    points = [(key(), i, at(rng.choice([rng.randint(0, 2000), 100]))) for i in range(400)] + [("hot", 900, None), (None, 901, None), ("zz", 902, at(5))]
    spans = []
    for j in range(150):
        s = rng.randint(-50, 2000)
        spans.append((key(), j, at(s), at(s + rng.choice([0, 0, 1, 5, 24, 720, 1500]))))
    spans += [("hot", 500, at(-10), at(5000)), ("hot", 501, at(100), at(100)), ("hot", 502, at(50), at(40)), ("a", 503, None, at(9)), ("b", 504, at(3), None)]
    p = spark.createDataFrame(points, "k string, i int, t timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, j int, s timestamp_ntz, e timestamp_ntz")
    return points, spans, p, s


@pytest.mark.parametrize("parts, block", [(2, 512), (16, 512), (16, 3)])
def test_sweep_is_brute_force(spark, monkeypatch, parts, block):
    from eventlab.operators import sweep
    points, spans, p, s = _tables(spark, parts)
    monkeypatch.setattr(sweep, "BLOCK", block)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sweep_join(p, s, ["k"], "t", "s", "e")
        rows = got.select("i", "j").collect()
        left = sweep_join(p, s, ["k"], "t", "s", "e", "left").select("i", "j").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = sorted((i, j) for k, i, t in points for l, j, a, z in spans if k is not None and k == l and t and a and z and a <= t <= z)
    assert got.columns == ["k", "i", "t", "j", "s", "e"]
    assert sorted((r["i"], r["j"]) for r in rows) == want
    met = {i for i, _ in want}
    assert sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in left) == sorted(want + [(i, -1) for _, i, _ in points if i not in met])


def test_sweep_equals_the_bucket_join(spark):
    _, _, p, s = _tables(spark, 9)
    s = s.where("s <= e")
    a, b = sweep_join(p, s, ["k"], "t", "s", "e"), interval_join(p, s, ["k"], "t", "s", "e")
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("list_rows, out_rows", [(8192, 65536), (7, 20)])
def test_nested_spans_leave_python_as_lists(spark, monkeypatch, list_rows, out_rows):
    from eventlab.operators import sweep
    monkeypatch.setattr(sweep, "LIST_ROWS", list_rows)
    monkeypatch.setattr(sweep, "OUT_ROWS", out_rows)
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    points = [("k", i, at(i)) for i in range(0, 3000, 3)] + [("k", -1, None)]
    spans = [("k", j, at(j % 40), at(2990 - j % 30)) for j in range(150)]
    p = spark.createDataFrame(points, "k string, i int, t timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, j int, s timestamp_ntz, e timestamp_ntz")
    want = sorted((i, j) for _, i, t in points for _, j, a, z in spans if t and a <= t <= z)
    got, left = (sweep_join(p, s, ["k"], "t", "s", "e", how) for how in ("inner", "left"))
    # 150,000 pairs: the worker's rows hold lists, from which Spark makes the pairs
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(_i") < plan.index("explode(_p") < plan.index("MapInArrow")
    assert sorted((r["i"], r["j"]) for r in got.select("i", "j").collect()) == want
    met = {i for i, _ in want}
    assert sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in left.select("i", "j").collect()) == sorted(
        want + [(i, -1) for _, i, _ in points if i not in met])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_row_of_lists_makes_few_pairs(spark, monkeypatch, how):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    # 600 spans open over all points, 6,000 that end together in the middle
    points = [("k", i, at(1000 + i % 500)) for i in range(700)] + [("k", -1, None)]
    spans = [("k", j, at(j % 40), at(2000 + j)) for j in range(600)] + [("k", 600 + j, at(50), at(1250)) for j in range(6000)]
    p = spark.createDataFrame(points, "k string, i int, t timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, j int, s timestamp_ntz, e timestamp_ntz")
    plain, left_worker = type(p).mapInArrow, []
    monkeypatch.setattr(type(p), "mapInArrow", lambda *a, **k: left_worker.append(plain(*a, **k)) or left_worker[-1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = sweep_join(p, s, ["k"], "t", "s", "e", how)
        found = got.selectExpr("count(*)", "count(distinct i, j)").first()
        most, pairs = left_worker[0].selectExpr("max(size(_p) * size(_i))", "sum(size(_p) * size(_i))").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = sum(1 for _, i, t in points for _, j, a, z in spans if t and a <= t <= z)
    assert tuple(found) == (want + (how == "left"), want) and pairs == found[0]
    assert most <= 4096


def test_sweep_of_empty_tables(spark):
    _, _, p, s = _tables(spark, 1)
    assert sweep_join(p.limit(0), s, ["k"], "t", "s", "e").count() == 0
    assert sweep_join(p, s.limit(0), ["k"], "t", "s", "e").count() == 0
    assert sweep_join(p, s.limit(0), ["k"], "t", "s", "e", "left").count() == p.count()


SCHEMA = StructType([StructField("id", IntegerType()), StructField("name", StringType()), StructField("at", TimestampNTZType())])


def test_reasons_of_every_line(spark):
    folder = tempfile.mkdtemp(prefix="eventlab-reasons-")
    first = ["id,name,at", "1,a,2024-01-01 00:00:00", "x1,a,2024-01-01 00:00:00", "2,\"b, c\",2024/1/2 3:04", "3,NA,NA", "4,,", "", "<<<<<<< HEAD",
             "5,e", "6,f,2024-01-01 00:00:00,more", "id,name,at", "7,g,yesterday", "=======", "8,h,"]
    second = ["id,,at", "9,i,2024-01-01 00:00:00"]
    for name, lines in (("one.csv", first), ("two.csv", second)):
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    good, bad = files.read_with_reasons(spark, folder, SCHEMA)
    assert good.schema == SCHEMA
    rows = {r["id"]: (r["name"], r["at"]) for r in good.collect()}
    assert set(rows) == {1, 2, 3, 4, 8, 9} and rows[2] == ("b, c", datetime(2024, 1, 2, 3, 4)) and rows[3] == (None, None)
    got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): (r["reason"], r["field"]) for r in bad.collect()}
    assert got == {("one.csv", 3): ("type", "id"), ("one.csv", 8): ("merge marker", None), ("one.csv", 9): ("field count", None),
                   ("one.csv", 10): ("field count", None), ("one.csv", 11): ("repeated header", None), ("one.csv", 12): ("type", "at"),
                   ("one.csv", 13): ("merge marker", None), ("two.csv", 1): ("blank header", None)}


def test_line_numbers_across_blocks(spark):
    folder = tempfile.mkdtemp(prefix="eventlab-lines-")
    with open(os.path.join(folder, "long.csv"), "w") as f:
        f.write("".join(f"{i},{'x' * (i % 50)}\n" for i in range(1, 5001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.numbered_lines(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(rows) == 5000 and all(r["line"].split(",")[0] == str(r["line_no"]) for r in rows)
