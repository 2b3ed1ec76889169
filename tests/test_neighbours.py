"""Nearest neighbours and the local outlier factor: against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import neighbours


def plain_neighbours(x, w, k):
    out = {}
    for i, a in enumerate(x):
        found = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b))), j, w[j] - (i == j)) for j, b in enumerate(x) if w[j] - (i == j) > 0)
        upto, kth = 0, math.inf
        for d, _, n in found:
            upto += n
            if upto >= k:
                kth = d
                break
        out[i] = {j: (d, n) for d, j, n in found if d <= kth}
    return out


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_nearest_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.standard_normal((400, 3)) * [1, 5, 0.2], "grid": np.array([(i, j) for i in range(18) for j in range(18)], float), "copies": rng.standard_normal((150, 2))}[kind]
    w = [1] * len(x) if kind != "copies" else [500 if i == 7 else int(rng.integers(1, 5)) for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r], w[i]) for i, r in enumerate(x)], "id long, x array<double>, w long").repartition(3)
    got = {}
    for r in neighbours.nearest(df, 6, cell=40).collect():
        got.setdefault(r.id, {})[r.other] = (r.d, r.w)
    want = plain_neighbours(x.tolist(), w, 6)
    assert {i: {j: (pytest.approx(d), n) for j, (d, n) in o.items()} for i, o in want.items()} == got


def plain_lof(v, k):
    out, columns = [], []
    for c in v.T:
        c = np.log1p(c) if len(c) >= 20 and c.min() >= 0 and np.median(c) > 0 and c.max() > 12 * np.median(c) else c
        mid = np.median(c)
        mad, (q1, q3) = np.median(np.abs(c - mid)), np.quantile(c, [0.25, 0.75])
        scale = 1.4826 * mad if mad > 1e-12 else (q3 - q1) / 1.349 if q3 - q1 > 1e-12 else np.std(c, ddof=1) if np.std(c, ddof=1) > 1e-12 else 1
        columns.append((c - mid) / scale)
    x = np.column_stack(columns)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    near = [np.flatnonzero(d[i] <= kth[i] * (1 + 1e-12)) for i in range(len(x))]
    reach = [np.maximum(kth[n], d[i, n]) for i, n in enumerate(near)]
    lrd = np.array([len(r) / r.sum() if r.sum() > 0 else 0 for r in reach])
    return np.array([lrd[n].mean() / lrd[i] if lrd[i] > 0 else 0 for i, n in enumerate(near)])


def test_factor_equals_all_pairs_with_skew_and_copies(spark):
    rng = np.random.default_rng(9)
    v = np.column_stack([rng.standard_normal(500), np.exp(rng.standard_normal(500) * 2)])
    v[:30] = v[0]  # more copies than neighbours
    v[40] = [30.0, 1e6]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, float("nan"), None)], "id long, a double, b double").withColumn("id2", F.lit("clash")).withColumn("w", F.lit("clash"))
    got = {r.id: r.outlier_score for r in neighbours.local_outlier_factor(df, ["a", "b"], 8).collect()}
    assert got[900] is None and got[901] is None and len(got) == 502
    want = plain_lof(v, 8)
    assert np.allclose([got[i] for i in range(500)], want, rtol=1e-9)
    assert want.argmax() == 40


def test_factor_of_small_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [r.outlier_score for r in neighbours.local_outlier_factor(df, ["a", "b"]).collect()] == [None]
    assert neighbours.local_outlier_factor(df.where("a > 5"), ["a", "b"]).count() == 0
    assert neighbours.robust(df.where("a > 5"), ["a"]) == [(False, 0.0, 1.0)]
