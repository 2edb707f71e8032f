"""Running values and as-of joins over many parts against plain loops; one key with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import evaluation
from sheetweave.operators.running import LAST, MAX, SUM, as_of, running


def some(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["b", None]), i, rng.choice([None, *range(9)])) for i in range(n)]


@pytest.mark.parametrize("before, parts", [(False, 1), (True, 7), (False, 40)])
def test_running_values(spark, before, parts):
    rows = some(61)
    values = {"s": (SUM, F.col("v")), "m": (MAX, F.col("v")), "l": (LAST, F.col("v"))}
    got = running(spark.createDataFrame(rows, "k string, i int, v int").repartition(3), ["k"], [F.col("i").asc()], values, before, parts)
    assert got.columns == ["k", "i", "v", "s", "m", "l"]
    seen, want = {}, {}
    for k, i, v in rows:
        old = [x for x in seen.setdefault(k, []) if x is not None]
        seen[k].append(v)
        now = old if before else [x for x in seen[k] if x is not None]
        want[i] = (sum(now), max(now), now[-1]) if now else (None, None, None)
    assert {r.i: (r.s, r.m, r.l) for r in got.collect()} == want
    assert running(spark.createDataFrame([], "k string, i int, v int"), ["k"], [F.col("i").asc()], values).count() == 0


def test_as_of_against_all_rows(spark):
    rng = random.Random(62)
    left = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(40)])) for i in range(200)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 40, 3)]), i, rng.choice([None, i])) for i in range(60)]
    got = as_of(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, version int, note int"), ["k"], "t", ["version", "note"], [F.col("version").asc()], parts=9)
    want = {}
    for i, k, t in left:
        held = [r for r in right if r[0] == k and t is not None and r[1] is not None and r[1] <= t]
        best = max(held, key=lambda r: (r[1], -r[2]), default=(None,) * 4)
        want[i] = (k, t, best[2], best[3])
    assert {r.id: (r.k, r.t, r.version, r.note) for r in got.collect()} == want and len(want) == 200


def test_champions(spark):
    tried = [("m", 1, 10, 0.5), ("m", 2, 10, 0.7), ("m", 3, 10, 0.7), ("m", 4, 20, 0.7), ("m", 5, 30, 0.9), ("m", 6, 40, None), ("n", 7, 5, -1.0), ("m", 8, None, 5.0)]
    df = spark.createDataFrame(tried, "model string, version int, ts int, metric double")
    assert sorted((r.model, r.ts, r.version) for r in evaluation.champions(df, 3).collect()) == [("m", 10, 2), ("m", 30, 5), ("n", 5, 7)]
    jobs = spark.createDataFrame([(1, "m", 9), (2, "m", 10), (3, "m", 99), (4, "x", 50), (5, "n", 5)], "job_id int, model string, ts int")
    base = spark.createDataFrame([("m", 50, "late"), ("n", 1, "b2"), ("n", 1, "b1")], "model string, ts int, baseline string")
    got = {r.job_id: (r.version, r.baseline) for r in evaluation.at_the_time(jobs, df, base, 4).collect()}
    assert got == {1: (None, None), 2: (2, None), 3: (5, "late"), 4: (None, None), 5: (7, "b1")}


def test_no_task_sees_a_whole_history(spark):
    """Nine tenths of all rows under one key go through as many tasks as there are parts."""
    df = spark.range(20_000).selectExpr("IF(id % 10 = 0, id, -1) AS k", "id AS i")
    ran = running(df, ["k"], [F.col("i").asc()], {"n": (SUM, F.lit(1))}, parts=16)
    sizes = [r["count"] for r in ran.where("k = -1").groupBy((F.col("n") / 1).isNull().alias("x")).count().collect()]
    assert sizes == [18_000] and ran.where("k = -1").agg(F.max("n")).first()[0] == 18_000
    spread = df.repartitionByRange(16, "k", "i").withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert spread < 4_000
