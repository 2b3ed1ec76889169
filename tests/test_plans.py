"""Recipe steps, formula references, keys, pairings, neighbours and bounded samples."""

import random

import numpy as np
from pyspark.sql import functions as F

from lathework.functions import cleans, formula
from lathework.operators import charts, compare, models, order, profile
from lathework.plans.recipe import Recipe


def test_new_steps_and_cleans(spark):
    df = spark.createDataFrame([(0, "a", "1,5", 1.0), (1, "a", "2.5", 2.0), (2, "b", "1.234,56", None), (3, "b", "1,234", 40.0)], "_row_id long, g string, t string, x double")
    r = Recipe(cleans={"t": [{"op": "repairDecimal"}], "g": [{"op": "setCells", "edits": [{"row": 3, "from": "b", "to": "c"}]}]})
    assert [(x.g, x.t) for x in r.apply(df).orderBy("_row_id").collect()] == [("a", "1.5"), ("a", "2.5"), ("b", "1234.56"), ("c", "1,234")]
    agg = Recipe(steps=[{"op": "aggregate", "dims": [{"kind": "value", "column": "g"}], "measures": [{"agg": "sum", "column": "x", "name": "total"}, {"agg": "count", "name": "n"}]}])
    got = {tuple(x)[0]: tuple(x)[1:] for x in Recipe.from_json(agg.to_json()).apply(df).collect()}
    assert got == {"a": (3.0, 2), "b": (40.0, 2)}
    filled = Recipe(steps=[{"op": "knn", "column": "x", "predictors": ["g"], "k": 1}]).apply(df).orderBy("_row_id").collect()
    assert filled[2].x == 40.0
    flagged = Recipe(steps=[{"op": "flagAnomalies", "column": "x", "name": "odd"}]).apply(df)
    assert "odd" in flagged.columns
    assert spark.range(1).select(cleans.repair_decimal(F.lit("3.25"), True)).first()[0] == "3.25"


def test_names_follow_into_formulas(spark):
    assert formula.rename('IF([Old]="[old]", [o ld]+[OLD], "x ""[old]""")', {"old": "new]x"}) == 'IF([new]]x]="[old]", [o ld]+[new]]x], "x ""[old]""")'
    r = Recipe(cleans={"a": [{"op": "trim"}]}, steps=[{"op": "derive", "name": "d", "formula": "[a] & [b]"}, {"op": "melt", "ids": ["a"], "values": ["b"]}, {"op": "drop", "column": "b"}])
    new = r.renamed({"a": "z"})
    assert new.cleans == {"z": [{"op": "trim"}]} and new.steps[0]["formula"] == "[z] & [b]" and new.steps[1]["ids"] == ["z"] and new.steps[2]["column"] == "b"


def brute_neighbours(rows, donors, numeric, k, y, number):
    """Distances by the definition: numbers standardised, labels differ by one, scaled to all predictors."""
    stats = [(np.mean([d[j] for d in donors]), np.std([d[j] for d in donors]) or 1.0) if n else None for j, n in enumerate(numeric)]
    out = []
    for row in rows:
        dist = []
        for i, d in enumerate(donors):
            known = [j for j in range(len(row)) if row[j] is not None]
            s = sum(((row[j] - d[j]) / stats[j][1]) ** 2 if numeric[j] else float(row[j] != d[j]) for j in known)
            dist.append((round(np.sqrt(s * len(row) / len(known)), 9), i))
        near = sorted(dist)[:k]
        near = [x for x in near if x[0] < 1e-6] or near
        w = [1.0 if x < 1e-6 else 1 / x for x, _ in near]
        if number:
            out.append(sum(a * y[i] for a, (_, i) in zip(w, near)) / sum(w))
        else:
            votes = {}
            for a, (_, i) in zip(w, near):
                votes[y[i]] = votes.get(y[i], 0) + a
            out.append(max(votes, key=votes.get))
    return out


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(9)
    donors = [(i, rng.random() * 10, rng.choice("abc"), rng.choice("xy"), rng.random()) for i in range(80)]
    gaps = [(1000 + i, None if i == 0 else rng.random() * 10, rng.choice(["a", "b", "zz", None]), "x", None) for i in range(40)]
    df = spark.createDataFrame(donors + gaps, "i long, n double, c string, d string, y double")
    got = {r.i: r.y for r in models.knn_impute(df, "y", ["n", "c", "d"], 4).collect()}
    want = brute_neighbours([g[1:4] for g in gaps], [d[1:4] for d in donors], [True, False, False], 4, [d[4] for d in donors], True)
    # Rows that know no number tie with many donors.
    assert np.allclose([got[g[0]] for g in gaps[1:]], want[1:], atol=1e-6) and 0 <= got[1000] <= 1
    labelled = df.withColumn("lab", F.when(F.col("i") < 1000, F.when(F.col("n") > 5, "high").otherwise("low"))).drop("y")
    got = {r.i: r.lab for r in models.knn_impute(labelled, "lab", ["n", "c"], 3).collect()}
    assert all(got[g[0]] == ("high" if g[1] > 5 else "low") for g in gaps if g[1] is not None and abs(g[1] - 5) > 2)
    assert all(v is not None for v in got.values())


def test_keys_alone_and_in_pairs(spark):
    a = spark.createDataFrame([(i, i // 3, i % 3, float(i)) for i in range(300)], "order_id long, x long, y long, price double")
    b = a.where("order_id % 10 != 0")
    best = compare.suggest_key_pairs(a, b, ["order_id", "x", "y", "price"]).collect()
    assert best[0].column == "order_id" and {r.column for r in best} == {"order_id", "price"}
    pairs = compare.suggest_key_pairs(a.drop("order_id", "price"), b.drop("order_id", "price"), ["x", "y"]).collect()
    assert [(r.column, round(r.overlap, 3)) for r in pairs] == [("x + y", 1.0)]
    assert compare.suggest_key_pairs(a, b, ["y"]).count() == 0


def greedy(edges):
    out, a, b = [], set(), set()
    for x, y, r in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if x not in a and y not in b:
            out.append((x, y))
            a.add(x)
            b.add(y)
    return sorted(out)


def test_pairing_is_the_greedy_rule(spark):
    rng = random.Random(4)
    edges = list({(rng.randrange(40), rng.randrange(40)): None for _ in range(300)})
    edges = [(x, y, round(rng.random(), 1)) for x, y in edges]
    got = compare.one_to_one(spark.createDataFrame(edges, "a_id long, b_id long, rank double")).collect()
    assert sorted((r.a_id, r.b_id) for r in got) == greedy(edges)


def test_agreeing_columns_decide_between_like_names(spark):
    a = spark.createDataFrame([(1, "Smith Trading Ltd", "x"), (2, "Smith Tradings", "y")], "k long, name string, city string")
    b = spark.createDataFrame([(11, "Smith Trading", "y"), (12, "Smith Trading", "x"), (13, "Other 5", "z")], "j long, name string, city string")
    got = {r.a_id: r.b_id for r in compare.fuzzy_match(a, b, "name", "k", "j", checks=["city"]).collect()}
    assert got == {1: 12, 2: 11}


def test_ranges_are_balanced_with_repeated_values(spark):
    df = spark.range(80_000, numPartitions=8).select((F.col("id") % 80).alias("v"))
    n = [r["count"] for r in df.groupBy(order.range_part(df, "v", 8).alias("p")).count().collect()]
    assert len(n) == 8 and max(n) < 2 * 80_000 / 8


def test_samples_and_draws_do_not_collapse_on_copies(spark):
    df = spark.range(4000).select((F.col("id") % 4).cast("double").alias("v"), F.lit("g").alias("g"))
    some = models._sample(df, ["v"], 400, 1)
    assert some["v"].value_counts().min() > 50
    low, high = charts.bootstrap(df, "v", "g", rounds=400).first()[1:]
    # The mean is 1.5 with a standard error of 0.0177.
    assert 1.44 < low < 1.49 and 1.51 < high < 1.56


def test_similar_values_of_a_large_block(spark):
    values = [(f"same thing {chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(600)]
    got = profile.similar_clusters(spark.createDataFrame(values, "v string"), "v", 0.9)
    assert got.count() == 600


def test_rows_with_equal_predictors_meet_the_donors_once(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    class Counting(models.Neighbours):
        def near(self, rows, k):
            compared.add(len(rows[0]))
            return super().near(rows, k)

    monkeypatch.setattr(models, "Neighbours", Counting)
    rows = [(i, float(i % 4), "ab"[i % 2] if i % 7 else None, float(i % 5) if i % 3 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, n double, c string, y double").coalesce(1)
    got = {}
    for r in models.knn_impute(df, "y", ["n", "c"], 4).collect():
        assert r.y == rows[r.i][3] if rows[r.i][3] is not None else r.y is not None
        if rows[r.i][3] is None:
            got.setdefault((r.n, r.c), set()).add(r.y)
    assert len(got) == 8 and all(len(v) == 1 for v in got.values())
    assert compared.value == 8
