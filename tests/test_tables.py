import datetime
import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.functions import cleans
from lathework.functions import text as T
from lathework.operators import charts, compare, filters, models, neighbours, pivot, profile, timeseries, transforms
from lathework.operators.aggregate import Measure
from lathework.operators.profile import Rule
from lathework.plans.recipe import Recipe
from lathework.sources import readers, sinks
from lathework.streaming import windows


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


# -- reshaping ----------------------------------------------------------------


def test_melt_spread_explode_split(spark):
    df = spark.createDataFrame([(1, "x", 1.0, None), (2, "y", 3.0, 4.0)], "id int, k string, jan double, feb double")
    long = pivot.melt(df, ["id", "k"], ["jan", "feb"], drop_empty=True)
    assert rows(long) == [(1, "x", "jan", "1.0"), (2, "y", "feb", "4.0"), (2, "y", "jan", "3.0")]
    wide = spark.createDataFrame([(0, 1, "b", 5.0), (1, 1, "a", 6.0), (2, 1, "b", 7.0), (3, 2, None, 8.0)], "_row_id long, id int, k string, v double")
    out = pivot.spread(wide, ["id"], "k", "v")
    assert out.columns == ["id", "b", "a", "(empty)"]
    assert rows(out) == [(1, 5.0, 6.0, None), (2, None, None, 8.0)]
    parts = spark.createDataFrame([(1, "a - b-"), (2, ""), (3, None), (4, "--")], "id int, code string")
    assert rows(pivot.explode_column(parts, "code", "-")) == [(1, "a"), (1, "b"), (2, ""), (3, ""), (4, "")]
    assert pivot.split_column(parts, "code", "-").columns == ["id", "code", "code_1", "code_2", "code_3"]
    with pytest.raises(ValueError):
        pivot.column_values(spark.range(600).withColumn("c", F.col("id").cast("string")), "c")


def test_pivot_margins_come_from_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 10.0), (None, "x", 2.0)], "i string, c string, v double")
    got = {(r.i, r.c): r.med for r in pivot.pivot_long(df, ["i"], ["c"], [Measure("median", "v", "med")]).collect()}
    assert got[("(total)", "(total)")] == 2.5 and got[("a", "(total)")] == 2.0 and got[("(missing)", "x")] == 2.0 and got[("(total)", "x")] == 2.0
    share = {(r.i, r.c): r.share for r in pivot.pivot_percent(df, ["i"], ["c"], Measure("sum", "v", "s"), "column").collect()}
    assert share[("b", "x")] == 10 / 13 and share[("a", "y")] == 1.0


# -- transforms ---------------------------------------------------------------


def test_dedupe_keeps_by_row_order(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", 1), (3, "a", None)], "_row_id long, x string, y int")
    assert [r._row_id for r in transforms.dedupe(df, "first").orderBy("_row_id").collect()] == [0, 2]
    assert [r._row_id for r in transforms.dedupe(df, "last").orderBy("_row_id").collect()] == [2, 3]
    assert [r._row_id for r in transforms.dedupe(df, "none").collect()] == [2]


def test_impute(spark):
    df = spark.createDataFrame([(i, "g" if i < 3 else "h" if i < 6 else None, float(i) if i in (1, 2, 4) else None) for i in range(8)], "_row_id long, g string, v double")
    col = lambda d: [r.v for r in d.orderBy("_row_id").collect()]
    assert col(transforms.impute(df, "v", "forward")) == [None, 1.0, 2.0, 2.0, 4.0, 4.0, 4.0, 4.0]
    assert col(transforms.impute(df, "v", "backward")) == [1.0, 1.0, 2.0, 4.0, 4.0, None, None, None]
    assert col(transforms.impute(df, "v", "mean", by=["g"])) == [1.5, 1.0, 2.0, 4.0, 4.0, 4.0, pytest.approx(7 / 3, abs=1e-6), pytest.approx(7 / 3, abs=1e-6)]
    assert col(transforms.impute(df, "v", "constant", 0.0))[0] == 0.0
    assert all(v is not None for v in col(models.knn_impute(df, "v", ["_row_id"], 1)))


def test_winsorize_uses_nearest_ranks(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    got = sorted(r.v for r in transforms.winsorize(df, "v", 5).collect())
    assert got[0] == 5.0 and got[-1] == 94.0
    few = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert sorted(r.v for r in transforms.winsorize(few, "v", 25).collect()) == [float(i) for i in range(10)]


def test_combine_date_and_names(spark):
    df = spark.createDataFrame([("2024", "2", "30"), ("2024", "2", "29"), ("x", "1", "1")], "y string, m string, d string")
    out = transforms.combine_date(df, {"year": "y", "month": "m", "day": "d"})
    assert [r.date for r in out.collect()] == [None, datetime.date(2024, 2, 29), None]
    assert transforms.derive(out, "DATE", F.lit(1), 0).columns[0] == "DATE (2)"


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = readers.row_ids(df, ["k"]).collect()
    assert all(r.k == r._row_id for r in got)


# -- filters ------------------------------------------------------------------


def test_filters_on_blanks_and_marks(spark):
    df = spark.createDataFrame([(1, "Ørsted", 1.0), (2, "José O'Brien", None), (3, None, 3.0), (4, "  a   b ", -1.0)], "id int, t string, v double")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.contains("t", "orsted")) == [1] and ids(filters.contains("t", "obrien")) == [2] and ids(filters.exact("t", "A B")) == [4]
    assert ids(filters.contains("t", " ")) == [1, 2, 3, 4]
    assert ids(filters.compare("v", "ne", 1.0)) == [3, 4] and ids(filters.in_range("v", None, 1.0)) == [1, 4]
    assert ids(filters.values("t", ["(empty)", "a   b"])) == [3, 4]
    assert ids(filters.exclude(filters.compare("v", "gt", 0.0))) == [2, 4]
    assert [r.id for r in filters.versus_average(df, "v", False).collect()] == [4]
    assert [r.id for r in filters.ordered(df, "v", "id", True).collect()] == [2, 3, 1, 4]
    assert [r.id for r in filters.page(df, "v", "id", 1, 3).collect()] == [1, 3]


def test_fuzzy_and_phonetic(spark):
    df = spark.createDataFrame([(1, "Jonathan Smith"), (2, "Jonathon Smyth"), (3, "Maria Lopez"), (4, None)], "id int, t string")
    assert [r.id for r in filters.fuzzy(df, "t", "jonathan smith", "normal").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in filters.phonetic(df, "t", "smith").orderBy("id").collect()] == [1, 2]
    assert T.jaro_winkler("abcd", "axyz") == pytest.approx(0.55) and T.jaro_winkler("", "a") == 0.0
    assert filters.suggestions(df, "t", "maria").first().value == "Maria Lopez"


# -- cleans -------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,comma,want",
    [("1,234.5", False, 1234.5), ("1.234,5", True, 1234.5), ("(12)", False, -12.0), ("$ 3", False, 3.0), ("87%", False, 87.0), ("1,23", False, None), ("0x1f", False, None), ("", False, None), ("-", False, None), ("1e3", False, 1000.0)],
)
def test_numbers(spark, text, comma, want):
    assert spark.createDataFrame([(text,)], "t string").select(cleans.number(F.col("t"), comma)).first()[0] == want


def test_clean_values(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(" a \n b ", cleans.trim) == "a b"
    assert one("120.5 DR", cleans.sign_suffix) == "-120.5" and one("7 cr", cleans.sign_suffix) == "7"
    assert one("=1+1", cleans.escape_formulas) == "'=1+1" and one("-5.2", cleans.escape_formulas) == "-5.2"
    assert one("abcdef", lambda c: cleans.mask(c, 1, 1)) == "a****f" and one("ab", lambda c: cleans.mask(c, 1, 1)) == "**"
    assert one("31/12/2023", cleans.to_date) == datetime.date(2023, 12, 31) and one("12/31/2023", cleans.to_date) is None and one("12/31/2023", lambda c: cleans.to_date(c, "mdy")) == datetime.date(2023, 12, 31)
    assert one("2024.03.05", lambda c: cleans.to_date(c, "fmt:YYYY.MM.DD")) == datetime.date(2024, 3, 5)
    assert one("45292", lambda c: cleans.number_to_date(c, "excelSerial")) == datetime.date(2024, 1, 1) and one("20240230", lambda c: cleans.number_to_date(c, "yyyymmdd")) is None
    assert one("Yes", lambda c: cleans.cast(c, "boolean")) is True and one("x", lambda c: cleans.cast(c, "integer", "keep")) == "x"
    assert one("1:02:03", cleans.duration_ms) == 3723000
    missing = lambda x, **k: one(x, lambda c: cleans.is_missing(c, **k))
    assert [missing(x) for x in ("N/A", " - ", "No", "0", "-999", None, "")] == [True, True, False, False, False, True, True]
    assert missing("-999", extra=("-999",)) and not missing("N/A", keep=("N/A",))


# -- compare ------------------------------------------------------------------


def test_compare_pairs_repeated_keys_in_order(spark):
    a = spark.createDataFrame([(0, " k ", 1.0), (1, "k", 2.0), (2, "k", 3.0), (3, None, 4.0), (4, "z", 5.0)], "_row_id long, k string, v double")
    b = spark.createDataFrame([(0, "k", 1.0), (1, "k", 2.5), (2, None, 4.0), (3, "z", 5.0000001)], "_row_id long, k string, v double")
    m = compare.match(a, b, ["k"], "_row_id", relative=1e-6)
    assert {r.status: r.n for r in compare.summary(m).collect()} == {"identical": 2, "changed": 1, "only A": 2, "only B": 1}
    assert rows(compare.changes_long(m, ["k"])) == [("k", "v", "2.0", "2.5")]
    assert {r.column: r.n for r in compare.changed_counts(m).collect()}["v"] == 1
    assert tuple(compare.content_match(a, b, ["v"]).first()) == (2, 3, 2)
    assert compare.pair_columns(["Total Cost", "b"], ["total_cost", "b"]) == {"Total Cost": "total_cost", "b": "b"}


def test_shifts(spark):
    a = spark.createDataFrame([(float(i % 50), "x" if i % 2 else "y") for i in range(500)], "v double, k string")
    same = compare.psi(a, a, "v").first()
    assert same.psi == pytest.approx(0.0) and same.shift == "none" and same.smd == pytest.approx(0.0)
    b = a.withColumn("v", F.col("v") + 30).withColumn("k", F.when(F.col("k") == "x", "w").otherwise(F.col("k")))
    assert compare.psi(a, b, "v").first().shift == "large"
    c = compare.category_shift(a, b, "k").first()
    assert (c.appeared, c.vanished) == (1, 1) and c.v > 0.5


def test_fuzzy_keys(spark):
    a = spark.createDataFrame([(1, "Acme Pty Ltd"), (2, "Main St 12"), (3, "Zeta")], "id int, n string")
    b = spark.createDataFrame([(11, "ACME"), (12, "Main Street 12"), (13, "Main Street 13")], "id int, n string")
    got = {r.a_id: r.b_id for r in compare.fuzzy_match(a, b, "n", "id", "id").collect()}
    assert got == {1: 11, 2: 12}


# -- profiles -----------------------------------------------------------------


def test_fences(spark):
    flat = spark.createDataFrame([(5.0,)] * 30, "v double")
    assert profile.value_fence(flat, "v").first().kind == "none"
    df = spark.createDataFrame([(i, float(i % 10 - 5)) for i in range(100)] + [(1000, 500.0), (1001, None)], "id long, v double")
    assert [r.id for r in profile.value_anomalies(df, "v").collect()] == [1000]
    g = df.withColumn("g", F.lit("one"))
    assert [r.id for r in profile.group_anomalies(g, "v", "g").collect()] == [1000]


def test_rules_and_score(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, None, -1.0), (2, "zz", None)], "id int, k string, v double")
    rules = [Rule("notNull", "k"), Rule("unique", "id"), Rule("range", "v", 0), Rule("regex", "k", pattern="^[a-y]$"), Rule("length", "k", 1, 1, allowed=0.5), Rule("inList", "k", values=("a",))]
    got = {r.rule: (r.failures, r.passed) for r in profile.check_rules(df, rules).collect()}
    assert got == {"r0": (1, False), "r1": (1, False), "r2": (1, False), "r3": (1, False), "r4": (1, True), "r5": (1, False)}
    assert rows(profile.exceptions(df, rules[:3], "id")) == [(1, "r0", "k", None), (1, "r2", "v", "-1.0")]
    assert profile.rows_affected(df, rules).first().affected == 2
    assert 0 < profile.score(df, rules).first().score < 100


def test_relationships_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 300).astype(float)
    y = x * 2 + rng.normal(0, 3, 300)
    df = spark.createDataFrame([(float(a), float(b), "p" if a > 4 else "q") for a, b in zip(x, y)], "x double, y double, g string")
    assert profile.pearson(df, [("x", "y")]).first().r == pytest.approx(np.corrcoef(x, y)[0, 1])
    import pandas as pd

    assert profile.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
    assert 0 < profile.eta_squared(df, "g", "y").first().eta2 < 1
    assert profile.cramers_v(df.withColumn("h", F.col("g")), "g", "h").first().v == pytest.approx(1.0)


def test_masks_variants_and_shapes(spark):
    df = spark.createDataFrame([("AB-12",)] * 60 + [("x",)], "t string")
    top = profile.dominant_mask(df, "t").first()
    assert top["mask"] == "A-9" and top.dominant
    v = spark.createDataFrame([("New York",), ("new  york",), ("Paris",)], "t string")
    assert profile.variants(v, "t").first().spellings == 2
    s = spark.createDataFrame([(x,) for x in ("a@b.co", "http://x.y", "2024-01-01", "10.0.0.1", "4111 1111 1111 1111", "123-45-6789", "hello")], "t string")
    assert [r[0] for r in s.select(profile.shape_of(F.col("t"))).collect()] == ["email", "url", "date", "ip", "card", "ssn", "text"]
    assert profile.luhn("4111 1111 1111 1111") and not profile.luhn("4111 1111 1111 1112")
    assert profile.similar_clusters(spark.createDataFrame([("Jonathan",), ("Jonathon",), ("Zed",)], "t string"), "t").count() == 2


def test_outlier_scores_find_the_outlier(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    for f in (models.isolation_forest, neighbours.local_outlier_factor):
        assert f(df, ["a", "b"]).orderBy(F.col("outlier_score").desc()).first().id == 999
    line = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(200)] + [(999, 10.0, 300.0)], "id long, a double, b double")
    assert models.pca_residual(line, ["a", "b"], 1).orderBy(F.col("outlier_score").desc()).first().id == 999


# -- charts and series --------------------------------------------------------


def test_charts(spark):
    df = spark.createDataFrame([(float(v), "g") for v in (1, 2, 3, 4, 100)], "v double, k string")
    b = charts.box(df, "v", "k").first()
    assert (b.q1, b.median, b.q3, b.low_whisker, b.high_whisker, b.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert sorted(charts.class_breaks(df, "v", 2, "natural")) == [1.0, 100.0, 100.0]
    assert charts.class_breaks(df, "v", 2, "equal") == [1.0, 50.5, 100.0]
    lo, hi = charts.bootstrap(df.where("v < 50"), "v", "k", 300).select("low", "high").first()
    assert 1.0 <= lo < 2.5 < hi <= 4.0
    p = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0)], "x double, y double")
    square = [("sq", [[(0, 0), (1, 0), (1, 1), (0, 1)]])]
    assert [r.region for r in charts.points_in_polygons(p, "x", "y", square).collect()] == ["sq", None]
    assert spark.createDataFrame([(" 007.0",)], "t string").select(charts.region_key(F.col("t"))).first()[0] == "7"


def test_series_models():
    m = 12
    t = np.arange(96)
    y = 100 + t + 10 * np.sin(2 * np.pi * t / m)
    future = 100 + np.arange(96, 108) + 10 * np.sin(2 * np.pi * np.arange(96, 108) / m)
    for name in ("holt_winters", "theta", "regression", "combination"):
        assert np.abs(timeseries.MODELS[name](y, 12, m) - future).mean() < 6, name
    assert timeseries.cycle(y) == 12
    assert timeseries.changepoint(np.concatenate([np.arange(20), 20 - 3 * np.arange(20)]).astype(float)) in (19, 20, 21)
    trend, season, rest = timeseries.decompose(y, m)
    assert np.abs(trend + season + rest - y).max() < 1e-9 and abs(season[:m].sum()) < 1e-6
    assert timeseries.fill(np.array([np.nan, 1.0, np.nan, 3.0]), "last")[2] == 1.0 and timeseries.fill(np.array([1.0, np.nan, 3.0]), "interp")[1] == 2.0
    assert timeseries.backtest(y, "seasonal_naive", 6, m)["mase"] > 0
    assert timeseries.croston(np.array([0, 0, 3.0, 0, 0, 3.0]), 2)[0] > 0


def test_forecast_and_time_weighted_mean(spark):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0.0), ("a", "2024-01-01 18:00:00", 8.0), ("a", "2024-01-02 12:00:00", 8.0)], "k string, at string, v double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {str(r.slot)[:10]: r.value for r in timeseries.time_weighted_mean(e, "at", "v", "day", "k").collect()}
    assert got["2024-01-01"] == 2.0 and got["2024-01-02"] == 8.0
    s = spark.range(40).select(F.lit("x").alias("series"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("slot"), (F.col("id") % 7).cast("double").alias("value"))
    out = timeseries.forecast(s, 7, 7).orderBy("step").collect()
    assert [round(r.forecast) for r in out] == [5, 6, 0, 1, 2, 3, 4] and all(r.low <= r.forecast <= r.high for r in out)


# -- sources, sinks, recipes, streams -----------------------------------------


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Report 2024;;\r\nid;name;amount\r\n001;\"Zoé; \"\"x\"\"\";1,5\r\n;;\r\n002;Bob;2,5;extra\r\n003;Eve\r\n".encode("cp1252"))
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "amount", "_row_id"]
    assert [(r.id, r.name, r.amount) for r in df.orderBy("_row_id").collect()] == [("001", 'Zoé; "x"', "1,5"), ("002", "Bob", "2,5"), ("003", "Eve", None)]
    assert readers.infer_types(df, ["id", "name"]) == {"id": "identifier", "name": "category"}
    (tmp_path / "b.txt").write_text("1|2.5\n3|4.5\n5|6.5\n")
    assert readers.read_delimited(spark, str(tmp_path / "b.txt")).count() == 3
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("a,b\nx,1\ny,2\n")
    assert readers.read_delimited(spark, str(tmp_path / "c.csv.gz"), ",", "UTF-8", True).count() in (2, 3)
    assert readers.sniff_encoding("a\tb".encode("utf-16-le") * 5) == "UTF-16LE" and readers.looks_binary(b"\x89PNG....")
    assert readers.unique_headers(["name", "", "Name"]) == ["name", "column_2", "Name (2)"]


def test_json_zip_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": {"b": 1, "c": [1, 2]}, "d": "x"}, {"d": "y"}]))
    df = readers.read_json(spark, str(tmp_path / "a.json"))
    assert sorted(df.columns) == ["a.b", "a.c", "d"] and df.count() == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n")
        z.writestr("skip.bin", b"\x00")
    assert [r.member for r in readers.read_zip(spark, str(tmp_path / "z.zip")).collect()] == ["one.csv"]
    (tmp_path / "g.geojson").write_text(json.dumps({"features": [{"properties": {"name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    assert readers.read_geojson(spark, str(tmp_path / "g.geojson"))[0][0] == "sq"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd", 2.0, datetime.date(2024, 1, 2)), (2, None, 2.5, None)], "id int, t string, v double, d date")
    sinks.write(df, str(tmp_path / "out"), "csv-semicolon", escape=True, mask={"id": (0, 0)}, exclude=("v",))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert "id;t;d" in text and "*;'=cmd;2024-01-02" in text
    for kind in ("jsonl", "parquet", "orc"):
        sinks.write(df, str(tmp_path / kind), kind, limit=1)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert "missing_count(id)" in sinks.checks_sodacl("t", [Rule("notNull", "id")]) and "not_null" in sinks.checks_dbt("t", [Rule("notNull", "id")])
    assert sinks.markdown([{"a": 1}]).startswith("| a |")


def test_recipe_replays_and_round_trips(spark):
    df = spark.createDataFrame([(0, " Ann ", "1,200", "x-y"), (1, "N/A", "(3)", "z"), (2, " Ann ", "1,200", "x-y")], "_row_id long, name string, amount string, code string")
    r = Recipe(
        cleans={"name": [{"op": "trim"}, {"op": "case", "how": "upper"}]}, nulls={"name": {}}, types={"amount": "number"},
        steps=[{"op": "dedupe"}, {"op": "derive", "name": "double", "formula": "[amount]*2"}, {"op": "splitColumn", "column": "code", "delimiter": "-"}, {"op": "derive", "name": "bad", "formula": "[nope]"}, {"op": "drop", "column": "gone"}],
    )
    again = Recipe.from_json(r.to_json())
    got = again.apply(df).orderBy("_row_id").collect()
    assert [(x.name, x.amount, x.double, x.code_1, x.code_2) for x in got] == [("ANN", 1200.0, 2400.0, "x", "y"), (None, -3.0, -6.0, "z", "")]
    compile(r.script("p"), "script", "exec")


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", float(h), "u" if m else "v") for h in range(5) for m in (0, 10, 50)], "at string, v double, u string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = windows.read_table(spark, str(tmp_path / "in"), df.schema, 1)
    out = windows.run_once(windows.windowed(s, "at", "v", "1 hour"), "w1", str(tmp_path / "c1"), "complete")
    assert sorted((r.start.hour, r.n, r["sum"]) for r in out.collect()) == [(h, 3, 3.0 * h) for h in range(5)]
    ses = windows.run_once(windows.sessions(windows.read_table(spark, str(tmp_path / "in"), df.schema), "at", "u", "15 minutes"), "w2", str(tmp_path / "c2"), "complete")
    assert ses.count() > 5
    bad = windows.run_once(windows.split_by_rules(windows.read_table(spark, str(tmp_path / "in"), df.schema), [Rule("range", "v", 1)]), "w3", str(tmp_path / "c3"))
    assert bad.where("size(failed_rules) > 0").count() == 3
