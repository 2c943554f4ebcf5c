"""Joins by time, sketches and versions against plain code."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import records as R
from ledgerloom.operators import sketches as K
from ledgerloom.operators import temporal as J

DAY = datetime.date(2024, 1, 1)


def test_as_of_equals_plain_search(spark):
    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.05 else DAY + datetime.timedelta(days=rng.randint(-200, 400))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left, right = [(key(), day(), i) for i in range(150)], [(key(), day(), i) for i in range(150)]
    l, r = (spark.createDataFrame(x, "k string, at date, id int") for x in (left, right))
    for tolerance in (1, 7, 60):
        got = {row["id"]: row["last_id"] for row in J.as_of(l, r, ["k"], "at", "id", tolerance).collect()}
        want = {i: max(((b, j) for m, b, j in right if m == k and k is not None and a and b and 0 <= (a - b).days <= tolerance), default=(None, None))[1] for k, a, i in left}
        assert got == want and len(got) == 150
    assert "NestedLoop" not in (plan := J.as_of(l, r, ["k"], "at", "id", 7)._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_points_in_intervals(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), DAY + datetime.timedelta(days=rng.randint(0, 90)), i) for i in range(120)]
    spans = [(rng.choice("ab"), DAY + datetime.timedelta(days=(s := rng.randint(-5, 90))), DAY + datetime.timedelta(days=s + rng.randint(-3, 40)), j) for j in range(60)]
    met = J.in_intervals(spark.createDataFrame(points, "k string, at date, i int"), spark.createDataFrame(spans, "k string, a date, b date, j int"), ["k"], "at", "a", "b", 10)
    assert Counter((r["i"], r["j"]) for r in met.collect()) == Counter((i, j) for k, at, i in points for m, a, b, j in spans if k == m and a <= at < b)
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    rows = spark.range(60000).select((F.col("id") % 6).alias("month"), (F.pmod(F.xxhash64("id"), F.lit(20000))).alias("k"), (F.col("id") % 9973).cast("double").alias("v"))
    R.append(K.states(rows, ["month"], "k", "v"), str(tmp_path / "states"))
    kept = spark.read.parquet(str(tmp_path / "states")).withColumn("half", F.col("month") % 2)
    for by in (["half"], []):
        for r in K.merged(kept, by).select(*by, "n", K.distinct_count().alias("d"), K.quantile(0.9).alias("q")).collect():
            mine = rows.where(F.col("month") % 2 == r["half"]) if by else rows
            exact, under = mine.agg(F.countDistinct("k"), F.avg((F.col("v") <= r["q"]).cast("double"))).first()
            assert abs(r["d"] - exact) <= 0.03 * exact and abs(under - 0.9) <= 0.03 and r["n"] == mine.count()


def test_versions_as_multisets(spark):
    a = [("x", "p"), ("x", "p"), ("x", "q"), ("y", "p"), ("z", None), ("z", None)]
    b = [("x", "p"), ("x", "q"), ("x", "q"), ("w", "p"), ("z", None)]
    got = {r["input_id"]: (r["same"], r["removed"], r["added"]) for r in R.reconciled(spark.createDataFrame(a, "input_id string, t string"), spark.createDataFrame(b, "input_id string, t string")).collect()}
    assert got == {"x": (2, 1, 1), "y": (0, 1, 0), "z": (1, 1, 0), "w": (0, 0, 1)}
