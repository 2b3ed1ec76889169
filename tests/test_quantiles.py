import random

import numpy as np
from pyspark.sql import functions as F

from lathework.operators.quantiles import quantiles


def test_equal_numpy_with_and_without_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random() * 100, float(rng.randint(0, 3)), None])) for _ in range(20_000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.005, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = quantiles(df, F.col("v"), qs).first().q
    assert np.allclose(got, np.quantile([v for _, v in rows if v is not None], qs), atol=1e-9)
    by = {r.k: r.q for r in quantiles(df, F.col("v"), qs, ["k"]).collect()}
    assert set(by) == {"a", "b", None, "one"} and by["one"] == [7.0] * 7
    for k in ("a", "b", None):
        assert np.allclose(by[k], np.quantile([v for g, v in rows if g == k and v is not None], qs), atol=1e-9)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(30_000)], "v double")
    assert quantiles(df, F.col("v"), [0.3, 0.34, 0.5, 0.9]).first().q == [0.0, 1.0, 1.0, 2.0]
    assert quantiles(df.where("false"), F.col("v"), [0.5, 0.9]).first().q == [None, None]
    assert quantiles(df.where("false").withColumn("k", F.lit(1)), F.col("v"), [0.5], ["k"]).count() == 0


def test_few_large_groups_stay_where_their_rows_lie(spark, tmp_path):
    # One value by key would be one task: the rows must reach their brackets without a shuffle by that key.
    spark.range(60_000).selectExpr("if(id < 400, cast(id div 2 as string), 'all') as k", "cast(id * 7919 % 60013 as double) as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = quantiles(df, F.col("v"), [0.25, 0.5, 0.999], ["k"])
    rows: dict[str, list[float]] = {}
    for r in df.collect():
        rows.setdefault(r.k, []).append(r.v)
    got = {r.k: r.q for r in out.collect()}
    assert set(got) == set(rows) and len(rows) == 201
    assert all(np.allclose(got[k], np.quantile(v, [0.25, 0.5, 0.999]), atol=1e-9) for k, v in rows.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "rightHint=(strategy=broadcast)" in plan


def test_small_groups_interpolate_between_their_values(spark):
    rows = [(f"g{n}", float(v * v)) for n in (2, 3, 5, 8, 21) for v in range(n)]
    qs = [0.05, 0.25, 0.5, 0.9, 0.95]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in quantiles(df, F.col("v"), qs, ["k"]).collect():
        own = [v for k, v in rows if k == r.k]
        assert np.allclose(r.q, np.quantile(own, qs), atol=1e-9)
        assert np.allclose(quantiles(df.where(F.col("k") == r.k), F.col("v"), qs).first().q, np.quantile(own, qs), atol=1e-9)
