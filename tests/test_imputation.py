"""Imputation from nearest neighbours: every complete row is a donor, against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import models


@pytest.mark.parametrize("cell", [models.CELL, 20])
def test_neighbours_from_all_rows(spark, cell):
    rng = random.Random(4)
    # Few places, so that many donors are as near as the k-th; labels and numbers may be unknown.
    place = lambda: (round(rng.uniform(0, 3), 1), rng.choice("abcdefgh"), rng.randint(-20, 20))
    donors = [(i, *place(), float(rng.randint(0, 9))) for i in range(900)]
    gaps = [(1000 + i, *[None if rng.random() < 0.25 else v for v in place()], None) for i in range(150)] + [(2000, 99.0, "zz", -500, None), (2001, None, None, None, None)]
    other = [(3000, None, "a", 1, 1e6), (3001, float("inf"), "a", 1, 1e6), (3002, 1.0, "a", 1, float("inf"))]
    df = spark.createDataFrame(donors + gaps + other, "i long, n double, c string, m int, y double").withColumn("lab", F.when(F.col("i") < 1000, F.chr(F.col("y").cast("int") % 3 + 97)))
    df = df.repartition(3)
    scale = [np.std([d[1] for d in donors]), None, np.std([d[3] for d in donors])]
    got = {r.i: r for r in models.knn_impute(df, "y", ["n", "c", "m"], 7, cell).collect()}
    voted = {r.i: r for r in models.knn_impute(df.where("i < 3000"), "lab", ["n", "c", "m"], 7, cell).collect()}
    assert len(got) == len(donors + gaps + other) and got[0].__fields__ == df.columns
    assert all(got[r[0]].y == r[4] for r in donors + other)
    for g in gaps[:-1]:
        known = [j for j in range(3) if g[1 + j] is not None]
        if not known:
            continue
        square = lambda d: sum(float(g[1 + j] != d[1 + j]) if j == 1 else ((g[1 + j] - d[1 + j]) / scale[j]) ** 2 for j in known)  # noqa: B023, E731
        found = sorted((round(math.sqrt(square(d) * 3 / len(known)), 9), d[4]) for d in donors)
        found = [x for x in found if x[0] <= found[6][0]]
        found = [(1.0, y) for d, y in found if d == 0] or [(1 / d, y) for d, y in found]
        assert got[g[0]].y == pytest.approx(sum(w * y for w, y in found) / sum(w for w, _ in found), abs=1e-6), g
        votes = {}
        for w, y in found:
            votes["abc"[int(y) % 3]] = votes.get("abc"[int(y) % 3], 0) + w
        assert votes[voted[g[0]].lab] == pytest.approx(max(votes.values())), g
    assert got[2001].y == np.median([d[4] for d in donors])
    labels = ["abc"[int(d[4]) % 3] for d in donors]
    assert voted[2001].lab == max(sorted(set(labels)), key=labels.count)


def test_every_complete_row_is_a_donor(spark):
    n = 60_000
    df = spark.range(n).select("id", (F.col("id") * 7 % n).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    asked = df.where("id % 100 = 0").select((F.col("id") + n).alias("id"), "x", F.lit(None).cast("double").alias("y"))
    got = models.knn_impute(df.unionByName(asked), "y", ["x"], 1).where(F.col("id") >= n)
    assert got.count() == n // 100 and got.where(F.col("y") != F.col("id") - n).count() == 0


def test_neighbours_without_donors_or_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, None), (3.0, None)], "x double, y double")
    assert models.knn_impute(df.where("y is null"), "y", ["x"]).collect() == df.where("y is null").collect()
    assert models.knn_impute(df.where("y is not null"), "y", ["x"]).collect() == [(1.0, 2.0)]
    assert sorted(r.y for r in models.knn_impute(df, "y", ["x"]).collect()) == [2.0, 2.0, 2.0]
    assert [r.y for r in models.knn_impute(df, "y", []).collect()] == [2.0, 2.0, 2.0]
