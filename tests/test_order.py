"""Global order without a single task."""

import random

from pyspark.sql import functions as F

from inkfold.operators import order


def test_places_and_running_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(900)] + [("a", 7, 1)] * 300
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = [(r.g, r.x, r.i, r.place) for r in order.numbered(df, ["x", "i"], ["g"], parts=7).collect()]
    want = []
    for g in ("a", "b", None):
        want += [(*r, k) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    every = order.numbered(df, [F.desc("x"), "i", "g"], parts=5).orderBy("place").collect()
    assert [r.place for r in every] == list(range(1, len(rows) + 1)) and [(-r.x, r.i) for r in every] == sorted((-r[1], r[2]) for r in rows)
    run = order.accumulated(df, ["x", "i"], ["g"], sums={"s": F.col("i").cast("long")}, tops={"t": F.when(F.col("i") % 3 == 0, F.col("i"))}, parts=6)
    found = sorted(((r.x, r.i, r.s, r.t) for r in run.where("g = 'b'").collect()))
    total, top, expected = 0, None, []
    for _, x, i in sorted((r for r in rows if r[0] == "b"), key=lambda r: r[1:]):
        total += i
        top = i if i % 3 == 0 and (top is None or i > top) else top
        expected.append((x, i, total, top))
    assert found == expected
    assert order.numbered(df.limit(0), ["x"], ["g"]).count() == 0


def test_plan_has_no_single_task(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    plan = order.numbered(df, ["x", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
