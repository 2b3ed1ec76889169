import random

from pyspark.sql import functions as F

from lathework.functions import formula
from lathework.operators import order


def test_two_phase_functions_equal_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 2.0, 5.0])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v double")
    rows.sort()
    got = {r.k: r for r in order.previous(order.row_number(order.running_sum(df, F.col("v"), "k", "s"), "k", "n"), F.col("v"), "k", "p").collect()}
    fill = {r.k: r.v for r in order.carry(df, "v", "k").collect()}
    back = {r.k: r.v for r in order.carry(df, "v", "k", False).collect()}
    total, last = 0.0, None
    for i, (k, v) in enumerate(rows):
        total += v or 0.0
        last = v if v is not None else last
        assert (got[k].s, got[k].n, got[k].p) == (total, i + 1, rows[i - 1][1] if i else None)
        assert fill[k] == last
        assert back[k] == next((x for _, x in rows[i:] if x is not None), None)


def test_attached_formulas_equal_windows(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice([None, 1.0, 2.0, 5.0, 9.5])) for i in range(300)], "k long, v double")
    texts = {"a": "ROWNUMBER()", "b": "RANK([v])", "c": "RUNNINGSUM([v])", "d": "PREVIOUS([v])", "e": "COLUMNMEAN([v])", "f": "BIN([v],4)", "g": "PERCENTOFTOTAL([v])", "h": "COLUMNSTDEV([v])+COLUMNMEDIAN([v])"}
    got = sorted(tuple(r) for r in formula.apply(df, texts, "k").select("k", *texts).na.fill(-1.0).collect())
    comp = formula.Compiler(df, "k")
    want = sorted(tuple(r) for r in df.select("k", *[comp.column(t).alias(n) for n, t in texts.items()]).na.fill(-1.0).collect())
    for a, b in zip(got, want, strict=True):
        assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)), (a, b)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "k long, v double")
    assert order.running_sum(df, F.col("v"), "k", "s").count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k long, v double")
    assert order.row_number(nulls, "k", "n").count() == 2
