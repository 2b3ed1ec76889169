import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import charts, compare, filters, profile, timeseries, transforms


def test_reports_and_renames(spark):
    a = spark.createDataFrame([(i, i, float(i), "x") for i in range(30)], "_row_id long, k long, v double, s string")
    b = a.withColumn("v", F.when(F.col("k") < 3, F.col("v") + 1).otherwise(F.col("v")))
    m = compare.match(a, b, ["k"], "_row_id")
    got = {r.column: (r.changed, round(r.share, 3), len(r.top or [])) for r in compare.report(m, ["v", "s"]).collect()}
    assert got == {"v": (3, 0.1, 3), "s": (0, 0.0, 0)}
    d = compare.diff_summary(compare.value_diffs(m.where("status = 'changed'"), "v")).first()
    assert (d.n, d["sum"], d.p95_reach) == (3, 3.0, 1.0)
    assert compare.side_totals(m, "v").first().sum_b == sum(range(30)) + 3
    r = compare.suggest_renames(a, a.withColumnRenamed("k", "key"), ["k", "s"], ["key"]).collect()
    assert [(x.a, x.b, x.overlap) for x in r] == [("k", "key", 1.0)]
    assert compare.letters("abcd", "aXcd") == [("=", "a"), ("+", "X"), ("-", "b"), ("=", "cd")] or compare.letters("abcd", "aXcd") == [("=", "a"), ("-", "b"), ("+", "X"), ("=", "cd")]


@pytest.mark.parametrize("text,kind,want", [("GB82 WEST 1234 5698 7654 32", "iban", True), ("GB82 WEST 1234 5698 7654 33", "iban", False), ("51 824 753 556", "abn", True), ("51 824 753 557", "abn", False), ("123 456 782", "tfn", True), ("4111111111111111", "card", True)])
def test_check_digits(text, kind, want):
    assert profile.CHECKS[kind](text) is want


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, k long")
    assert {r.column: r.identifier for r in profile.identifier_like(df, ["id", "k"]).collect()} == {"id": True, "k": False}
    assert profile.name_hint("customerEmail") == "email" and profile.name_hint("foo") is None
    f = transforms.flag_anomalies(spark.createDataFrame([(float(i % 10),) for i in range(60)] + [(900.0,)], "v double"), "v")
    assert f.where("`v anomaly` = 'Yes'").count() == 1


def test_patterns_and_judgements():
    t = np.arange(120)
    y = 50 + 0.3 * t + 8 * np.sin(2 * np.pi * t / 12)
    trend, season, rest = timeseries.stl(y, 12)
    assert np.abs(rest[12:-12]).max() < 1.5 and np.ptp(season) > 12
    assert timeseries.verdict(y, 12, 6) in ("good", "fair") and timeseries.verdict(y[:5], 12, 6) == "too short"
    lam = timeseries.box_cox_lambda(np.exp(y / 20), 12)
    assert lam < 0.5 and np.allclose(timeseries.inverse_box_cox(timeseries.box_cox(y, 0.3), 0.3), y)
    x = np.random.default_rng(1).normal(size=200)
    z = np.concatenate([[0.0], 3 * x[:-1]]) + np.random.default_rng(2).normal(size=200) * 0.1
    assert timeseries.drivers(z, {"x": x, "noise": np.random.default_rng(3).normal(size=200)})[0][:2] == ("x", 1)
    assert timeseries.easter(2024) == (3, 31) and ("2024-11-28", "Thanksgiving") in timeseries.holidays(2024, 2024) and ("2024-03-29", "Good Friday") in timeseries.holidays(2024, 2024, "AU")


def test_more_charts_and_search(spark):
    df = spark.createDataFrame([(float(i), float(i * i), "a" if i % 2 else "b") for i in range(100)], "x double, y double, g string")
    assert sum(r.n for r in charts.density(df, "x", "y", 5).collect()) < 100
    assert charts.scatter(df, "x", "y", 10).count() == 10
    assert {r.region: r.n for r in charts.region_aggregate(df, F.col("g"), "x").collect()} == {"a": 50, "b": 50}
    c = spark.createDataFrame([(1, "z"), (2, "q"), (3, "z")], "id long, t string")
    ids = [r.id for r in filters.copies_together(c, "id").collect()]
    assert ids in ([1, 3, 2], [2, 1, 3])
    n = spark.createDataFrame([("Smith",), ("Zebra",)], "t string")
    assert filters.search(n, "t", "smyth").count() == 1
    e = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-01", "b", 2.0), ("2024-01-02", "a", 3.0)], "d string, k string, v double").withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert {r.key: round(r.repeated, 3) for r in timeseries.shape_check(e, "d", ["k"]).collect()} == {"(all)": 0.667, "k": 0.0}
    assert {r.label: r.n for r in timeseries.typical(e, "d", "v").collect()} == {"Mon": 2, "Tue": 1}


def test_registered_bars_and_forest_take_the_operators_own_sizes(spark, monkeypatch):
    from lathework import queries
    from lathework.operators import charts, models

    seen = []
    monkeypatch.setattr(charts, "bootstrap", lambda df, column, group, rounds=1000: seen.append(rounds) or df)
    monkeypatch.setattr(models, "isolation_forest", lambda df, columns, trees=100: seen.append(trees) or df)
    monkeypatch.setattr(models, "flag_top", lambda df: df.selectExpr("*", "true AS outlier", "0.0 AS outlier_score"))
    queries.error_bars_bootstrap(spark, "/root/testdata/sf0.001")
    queries.outliers_isolation_forest(spark, "/root/testdata/sf0.001")
    assert seen == [1000, 100]


def test_isolation_forest_scores_each_row_once_and_as_the_trees_say(spark):
    from lathework.operators import models

    leaf = lambda p: (p,)
    tree = (0, 0.5, leaf(1.0), (1, 2.0, (0, 3.0, leaf(0.0), leaf(2.5)), leaf(0.0)))
    of, cut, path = models._laid_out(tree, 4)
    z = np.array([[0.0, 9.0], [0.5, 2.0], [1.0, 0.0], [3.0, -1.0]])
    at = models._leaves(np.ascontiguousarray(z.T).ravel(), 4, of, cut, 4)
    assert path[at].tolist() == [2.0, 2.0, 3.0, 5.5]

    runs = spark.sparkContext.accumulator(0)

    def scored(x):
        runs.add(len(x))
        return x

    df = spark.range(2000).select(F.pandas_udf(scored, "double")(F.col("id").cast("double")).alias("outlier_score"))
    assert {r.outlier_score for r in models.flag_top(df, 0.01).where("outlier").collect()} == {float(k) for k in range(1980, 2000)}
    assert runs.value == 2000
