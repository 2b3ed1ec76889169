import pytest
from pyspark.sql import functions as F

from lathework.functions import buckets
from lathework.operators.aggregate import (
    BinEdges, BinQuantile, BinWidth, Cohort, Measure, Since, Time, Value, View, Where, aggregate, compile_expression, lambda_expression, post,
)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, "a", "2024-01-31 10:00:00", 1.0, 2.0), (2, "a", "2024-03-01 00:00:00", 3.0, 1.0), (3, None, "2024-03-02 00:00:00", None, 1.0), (4, "b", "2024-06-30 23:59:59", float("nan"), 0.0), (5, "b", None, 5.0, 4.0)],
        "id long, k string, at string, v double, w double",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_null_keys_and_missing_numbers(sales):
    out = aggregate(sales, View((Value("k"),), (Measure("count", name="n"), Measure("count", "v", "nv"), Measure("sum", "v", "s"), Measure("mean", "v", "m"), Measure("wmean", "v", "wm", weight="w")), names=("k",)))
    got = {r.k: (r.n, r.nv, r.s, r.m, r.wm) for r in out.collect()}
    assert got["(missing)"] == (1, 0, 0.0, None, None)
    assert got["a"] == (2, 2, 4.0, 2.0, 5 / 3)
    assert got["b"] == (2, 2, 5.0, 5.0, 5.0)


@pytest.mark.parametrize(
    "args,want",
    [
        (dict(grain="month"), "2024-02-01"), (dict(grain="week"), "2024-02-26"), (dict(grain="week", week_start=7), "2024-02-25"),
        (dict(grain="quarter", fiscal_start=7), "2024-01-01"), (dict(grain="year", fiscal_start=7), "2023-07-01"), (dict(grain="month", every=5), "2023-10-01"),
        (dict(grain="day", every=7), "2024-02-29"), (dict(grain="hour", every=6), "2024-02-29 18:00:00"), (dict(grain="day", zone="Asia/Tokyo"), "2024-03-01"),
    ],
)
def test_buckets(spark, args, want):
    df = spark.sql("select timestamp_ntz'2024-02-29 20:15:00' as t")
    assert str(df.select(buckets.bucket(F.col("t"), **args)).first()[0]) == (want if " " in want else want + " 00:00:00")


def test_labels(spark):
    df = spark.sql("select timestamp_ntz'2024-02-01' as t")
    label = lambda g, f=1: df.select(buckets.bucket_label(F.col("t"), g, f)).first()[0]
    assert [label("month"), label("quarter"), label("quarter", 7), label("year", 7), label("hour")] == ["2024-02", "2024 Q1", "FY2023 Q3", "FY2023", "2024-02-01 00:00"]


def test_fill_modes(sales):
    known = sales.where("at is not null")
    m = (Measure("count", name="n"), Measure("sum", "v", "s"), Measure("mean", "v", "m"))
    v = lambda fill: {str(r.b)[:7]: (r.n, r.s, r.m) for r in aggregate(known, View((Time("at", "month"),), m, fill=fill, names=("b",))).collect()}
    assert v("zero")["2024-02"] == (0, 0.0, None)
    assert v("carry")["2024-04"] == (2, 3.0, 3.0)
    assert v("gaps")["2024-05"] == (None, None, None)
    assert len(v("zero")) == 6


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "v double")
    one = lambda d: [r.b for r in aggregate(df.withColumn("i", F.col("v")), View((d, Value("v")), (Measure("count", name="n"),), names=("b", "v"))).orderBy(F.col("v").cast("double")).collect()]
    assert one(BinEdges("i", (0, 2, 10, 50))) == [0, 1, 1, 1, 2]
    assert one(BinWidth("i", 2.0)) == [0, 1, 1, 2, 50]
    assert one(BinQuantile("i", 2)) == [0, 0, 1, 1, 1]


def test_cohort_and_since(spark):
    df = spark.createDataFrame([("x", "2024-01-15"), (" x", "2024-03-01"), ("y", "2024-03-31"), ("y", "2024-04-01")], "e string, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = {str(r.c)[:7]: r.n for r in aggregate(df, View((Cohort("e", "d", "month"),), (Measure("count", name="n"),), names=("c",))).collect()}
    assert got == {"2024-01": 2, "2024-03": 2}
    assert rows(aggregate(df, View((Since("e", "d", "month"),), (Measure("count", name="n"),), names=("s",)))) == [("P0", 2), ("P1", 1), ("P2", 1)]


def test_conditions_expressions_and_ties(sales):
    w = Where("k", values=("a",))
    out = sales.agg(compile_expression("sum(v) / count(*) * 2 - 1", w).alias("x"), compile_expression("1 / (count(*) - count(*))").alias("z")).first()
    assert out.x == 3.0 and out.z is None
    assert lambda_expression("lambda x: x.sum() / x.size + x.quantile(0.5)", "v") == "sum([v]) / count(*) + p50([v])"
    for bad in ("sum(v", "sum(v) +", "foo(v)", "v", "lambda x: x", "sum(v) ) "):
        with pytest.raises(ValueError):
            sales.agg(compile_expression(bad)).first()
    with pytest.raises(ValueError):
        lambda_expression("lambda x: x + 1", "v")
    ties = sales.sparkSession.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "t string")
    assert aggregate(ties, View((Value("t"),), (Measure("mode", "t", "m"),), names=("g",))).count() == 3
    from lathework.operators.aggregate import measure

    assert ties.agg(measure(Measure("mode", "t"))).first()[0] == "a"


def test_post_operations(spark):
    df = spark.createDataFrame([(f"{y}-02-{d:02d}", v) for y, d, v in [(2023, 28, 2.0), (2024, 28, 4.0), (2024, 29, 5.0), (2025, 28, 10.0)]], "b string, v double").withColumn("b", F.col("b").cast("timestamp_ntz"))
    one = lambda op, **k: [r.x for r in post(df, op, "v", "b", name="x", **k).orderBy("b").collect()]
    assert one("yoy") == [None, 1.0, None, 1.0]
    assert one("rolling", width=2) == [2.0, 3.0, 4.5, 7.5]
    assert one("cumulative") == [2.0, 6.0, 11.0, 21.0]
    assert one("diff") == [None, 2.0, 1.0, 5.0]
    assert one("rank") == [4, 3, 2, 1]
    assert one("pctTotal", total=20.0) == [0.1, 0.2, 0.25, 0.5]


def test_empty_table(sales):
    v = View((Value("k"),), (Measure("count", name="n"), Measure("p95", "v", "p")), names=("k",))
    assert aggregate(sales.where("false"), v).count() == 0
    assert aggregate(sales.where("false"), View((Time("at", "day"),), (Measure("count", name="n"),), fill="zero", names=("b",))).count() == 0
