"""Formulas by example, the headless check, views as series, dependencies, places in polygons, class edges."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from lathework import check
from lathework.functions import by_example
from lathework.operators import charts, profile, timeseries
from lathework.sources import readers


def test_formulas_from_examples(spark):
    df = spark.createDataFrame([(0, "ann.lee@x.org", "Ann", "Lee", 2.345, 3.0), (1, "bo@y.com", "Bo", "Ray", 7.0, 2.0), (2, "cy-d@z.net", "Cy", "Dow", 1.5, 4.0)], "k long, mail string, first string, last string, x double, y double")
    want = {
        "user": ["ann.lee", "bo", ""],
        "domain": ["x.org", "y.com", "z.net"],
        "join": ["Ann Lee", "Bo Ray", "Cy Dow"],
        "upper": ["ANN", "BO", "CY"],
        "product": ["7.035", "14", "6"],
    }
    got = {k: by_example.formulas(df, w, "k") for k, w in want.items()}
    assert 'LEFT([mail], FIND("@", [mail]) - 1)' in got["user"]
    assert got["domain"][0] == 'MID([mail], FIND("@", [mail]) + 1, 1000)'
    assert got["join"] == ['[first] & " " & [last]'] and got["upper"][0] == "UPPER([first])" and "[x] * [y]" in got["product"]
    assert by_example.formulas(df, ["nothing", "like", "it"], "k") == [] and by_example.formulas(df, ["", "", ""], "k") == []


def test_headless_check(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("id,amount,kind\n" + "".join(f"{i},{i * 2},{'a' if i % 2 else 'b'}\n" for i in range(60)))
    (tmp_path / "rules.json").write_text(json.dumps([{"kind": "range", "column": "id", "low": 0, "high": 50}, {"kind": "inList", "column": "kind", "values": ["a", "b"]}, {"kind": "notNull", "column": "gone"}]))
    at = str(tmp_path / "t.csv")
    assert check.main([at, "--min-score", "50"]) == 0
    assert check.main([at, "--rules", str(tmp_path / "rules.json"), "--json", "--exceptions", str(tmp_path / "out")]) == 1
    printed = capsys.readouterr().out
    out = json.loads(printed[printed.index("{") :])
    assert [r["passed"] for r in out["rules"]] == [False, True] and out["rows"] == 60 and out["skipped"] == ["gone"] and len(out["failures"]) == 1
    assert check.main([at, "--rules", str(tmp_path / "none.json")]) == 2


def test_a_view_is_a_series_with_cut_edges(spark):
    view = spark.createDataFrame([(f"2024-0{m}-01", g, float(m)) for m in range(1, 5) for g in "ab"] + [(None, "a", 9.0)], "month string, g string, total double").withColumn("month", F.col("month").cast("timestamp_ntz"))
    got = timeseries.from_view(view, "month", "total", "g", ("2024-01-10", "2024-04-30"), 86400.0).orderBy("series", "slot").collect()
    assert [(r.series, r.value, r.partial) for r in got] == [(g, float(m), m == 1) for g in "ab" for m in range(1, 5)]
    assert timeseries.from_view(view.where("total < 3"), "month", "total").count() == 0


def test_dependencies_equal_pairwise_checks(spark):
    df = spark.range(600).select("id", (F.col("id") % 30).alias("a"), (F.col("id") % 30 % 7).alias("b"), F.when(F.col("id") == 77, 99).otherwise(F.col("id") % 30 % 5).alias("c"), (F.col("id") % 11).alias("d"), F.lit(1).alias("one"))
    got = {(r.determinant, r.dependent): (r["rows"], r.violations) for r in profile.dependencies(df, ["a", "b", "c", "d", "one"], "id").collect()}
    assert got == {("a", "b"): (600, 0), ("a", "c"): (600, 1)}
    for (x, y), (n, bad) in got.items():
        r = profile.dependency(df, x, y, "id").first()
        assert (r["rows"], r.violations) == (n, bad)


def brute_place(x, y, polygons):
    for name, rings in polygons:
        inside = False
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    inside = not inside
        if inside:
            return name
    return None


def test_points_in_polygons_equal_brute_force(spark):
    rng = random.Random(3)
    polygons = []
    for k in range(40):
        cx, cy, n = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.randint(3, 9)
        angle = sorted(rng.uniform(0, 6.283) for _ in range(n))
        polygons.append((f"p{k}", [[(cx + rng.uniform(1, 9) * float(np.cos(a)), cy + rng.uniform(1, 9) * float(np.sin(a))) for a in angle]]))
    polygons.append(("hole", [[(-80, -80), (-60, -80), (-60, -60), (-80, -60)], [(-75, -75), (-65, -75), (-65, -65), (-75, -65)]]))
    pts = [(i, rng.uniform(-90, 70), rng.uniform(-90, 70)) for i in range(3000)] + [(9000, None, 1.0)]
    got = {r.i: r.region for r in charts.points_in_polygons(spark.createDataFrame(pts, "i long, x double, y double"), "x", "y", polygons).collect()}
    assert got == {i: None if x is None else brute_place(x, y, polygons) for i, x, y in pts}
    assert len(set(got.values())) > 20


def test_class_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 3, 8, 20, 97)], "v double")
    assert charts.class_breaks(df, "v", 5, "pretty") == [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
    assert np.allclose(charts.class_breaks(df, "v", 2, "log"), [1, 97**0.5, 97])
    assert charts.class_breaks(df, "v", 3, "manual", [10, 50, 500]) == [1.0, 10, 50, 97.0]


def test_stray_quotes_and_ragged_rows(spark, tmp_path):
    rows = [f'{i},"a, b {i}",{i * 2}' for i in range(50)]
    rows[7] = '7,"open and never closed,14'
    rows[20] = '20,5" pipe,40'
    rows[30] = "30,short"
    rows[31] = "31,x,62,more,,again"
    rows[32] = "32,x,64,,"
    (tmp_path / "t.csv").write_text("id,what,n\n" + "\n".join(rows) + "\n")
    at = str(tmp_path / "t.csv")
    got = {r.id: (r.what, r.n) for r in readers.read_delimited(spark, at).collect()}
    assert len(got) == 50 and got["7"] == ("open and never closed", "14") and got["20"] == ('5" pipe', "40") and got["3"] == ("a, b 3", "6")
    assert got["30"] == ("short", None) and got["31"] == ("x", "62")
    assert tuple(readers.ragged(spark, at).first()) == (51, 1, 1, 2, 1)
    (tmp_path / "m.csv").write_text('id,what\n1,"two\nlines"\n2,"one"\n')
    assert [r.what for r in readers.read_delimited(spark, str(tmp_path / "m.csv")).collect()] == ["two\nlines", "one"]
