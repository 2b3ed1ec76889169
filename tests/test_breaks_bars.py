"""Natural breaks, bars of a median, the scaled histogram."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import charts, filters


def best_breaks(values, k):
    """Every division of the sorted values into runs, by their squared deviations."""
    v = sorted(values)
    different = sorted(set(v))
    k = min(k, len(different))
    cost = lambda part: sum((x - sum(part) / len(part)) ** 2 for x in part)
    out = []
    for cut in itertools.combinations(different[1:], k - 1):
        ends = [-math.inf, *cut, math.inf]
        out.append((round(sum(cost([x for x in v if a <= x < b]) for a, b in zip(ends, ends[1:])), 9), [different[0], *cut, different[-1]]))
    return min(out)[1]


def numbers(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


def test_natural_breaks_weigh_repeated_rows(spark):
    rng = random.Random(2)
    assert charts.class_breaks(numbers(spark, [0] * 500 + [1] * 480 + list(np.linspace(10, 20, 20))), "v", 3, "natural") == [0.0, 1.0, 10.0, 20.0]
    for k in (2, 3, 4):
        values = [rng.choice([1, 2, 3, 7, 8, 20, 21, 22.5, 90]) for _ in range(60)]
        assert charts.class_breaks(numbers(spark, [*values, None, float("nan")]), "v", k, "natural") == best_breaks(values, k)
    assert charts.class_breaks(numbers(spark, [5, 5, 5]), "v", 4, "natural") == [5.0, 5.0]
    assert charts.class_breaks(numbers(spark, [None]), "v", 4, "natural") == []


def test_natural_breaks_of_more_values_than_fit(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(12, 2, 2000), rng.exponential(5, 500) + 30, np.full(4000, 12.25)])
    df = numbers(spark, values)
    whole, ranges = charts.class_breaks(df, "v", 4, "natural"), charts.class_breaks(df, "v", 4, "natural", exact=400)
    assert ranges == whole and len(whole) == 5


def ranks(n):
    """By the definition: the innermost ranks that hold the median with 95 %."""
    found = [k for k in range(n // 2) if 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n <= 0.05]
    return (found[-1], n - 1 - found[-1]) if found else None


def test_ranks_of_the_median():
    for n in [1, 5, 6, 7, 8, 20, 99, 500, 1000]:
        assert charts.median_ranks(n) == ranks(n)


@pytest.mark.parametrize("repeated", [False, True])
def test_median_bars_are_order_statistics(spark, repeated):
    rng = random.Random(6)
    rows = [(g, (float(rng.randint(0, 5)) if repeated else rng.gauss(0, 10))) for g, n in (("a", 3), ("b", 6), ("c", 77), ("d", 1500), (None, 11)) for _ in range(n)]
    rows += [("a", None), ("e", None), ("c", float("nan"))] + [("f", 7.0)] * 2000
    got = {r.g: r for r in charts.median_bars(spark.createDataFrame(rows, "g string, x double").repartition(3), "x", "g").collect()}
    assert set(got) == {"a", "b", "c", "d", "f", None}
    for g, r in got.items():
        own = sorted(x for h, x in rows if h == g and x is not None and x == x)
        pair = charts.median_ranks(len(own))
        assert r.n == len(own) and r.median == pytest.approx(np.median(own))
        assert (r.low, r.high) == ((own[pair[0]], own[pair[1]]) if pair else (None, None))


def test_histogram_chooses_its_scale(spark):
    rng = random.Random(8)
    tail = [rng.uniform(-1, 1) for _ in range(400)] + [10.0**k for k in range(2, 9)] + [-1e5]
    got = {r.bin: r.n for r in filters.histogram(numbers(spark, [*tail, None]), "v", 16, scale="auto").collect()}
    f = lambda x: math.copysign(math.log1p(abs(x)), x)
    lo, hi, want = f(min(tail)), f(max(tail)), {}
    for x in tail:
        b = max(0, min(15, math.floor((f(x) - lo) / ((hi - lo) / 16))))
        want[b] = want.get(b, 0) + 1
    assert got == want and len(got) > 5
    even = numbers(spark, range(1000))
    assert sorted(filters.histogram(even, "v", 16, scale="auto").collect()) == sorted(filters.histogram(even, "v", 16).collect())
    few = {r.bin: r.n for r in filters.histogram(numbers(spark, [0, 1, 2, 3, 1e9]), "v", 4, scale="auto").collect()}
    assert few == {0: 4, 3: 1}
    assert filters.histogram(numbers(spark, [None]), "v", 4, scale="auto").count() == 0
    assert [tuple(r) for r in filters.histogram(numbers(spark, [5] * 80), "v", 4, scale="auto").collect()] == [(0, 80)]


def test_repeated_rows_come_back_without_a_list_of_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(1, None)] * 2 + [(None, None)] * 2 + [(2, "b")], "k int, v string")
    out = filters.in_duplicate_group(df)
    assert sorted(out.collect(), key=repr) == sorted([r for r in df.collect() if r != (2, "b")], key=repr)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
