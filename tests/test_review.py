import datetime

from pyspark.sql import functions as F

from lathework.operators import review
from lathework.sources import xlsx


def test_mojibake_is_found_and_mended(spark):
    df = spark.createDataFrame([(1, "Zoé".encode().decode("cp1252")), (2, "plain"), (3, None), (4, "naïve")], "id int, t string")
    assert [r.id for r in review.mojibake(df, "t").collect()] == [1]
    assert [r.x for r in df.select(review.fix_mojibake(F.col("t")).alias("x")).collect()] == ["Zoé", "plain", None, "naïve"]


def test_layouts_and_conflicts(spark):
    df = spark.createDataFrame([(x,) for x in ("2024-01-05", "25/12/2023", "12/25/2023", "1/2/2023", "5 March 2024", "20240101", "soon", None)], "t string")
    assert {r.layout: r.n for r in review.date_layouts(df, "t").collect()} == {"iso": 1, "day first": 1, "month first": 1, "ambiguous": 1, "named month": 1, "compact": 1, "other": 1}
    assert review.date_order_conflict(df, "t").first().conflict


def test_sentinels_places_and_reference(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(200)] + [(-999.0,)] * 5, "v double")
    assert [(r.value, r.n) for r in review.sentinels(df, "v").collect()] == [(-999.0, 5)]
    p = spark.createDataFrame([(0.0, 0.0), (120.0, 40.0), (10.0, 200.0), (1.0, 1.0)], "lat double, lon double")
    assert tuple(review.coordinates(p, "lat", "lon").first()) == (1, 1, 1)
    w = spark.createDataFrame([("Monday",), ("tuesday",), ("Wendesday",), ("sunday",)], "d string")
    assert [(r.value, r.suggestion) for r in review.reference_accuracy(w, "d").collect()] == [("wendesday", "wednesday")]
    assert review.archetype(p) == "places"


def test_spreadsheets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x & <y>", 2.5, datetime.date(2024, 2, 29), True), (2, None, None, None, None)], "id int, t string, v double, d date, b boolean")
    path = str(tmp_path / "a.xlsx")
    xlsx.write_xlsx(df.orderBy("id"), path, "Data")
    data = open(path, "rb").read()
    assert xlsx.sheets(data) == ["Data"]
    assert xlsx.rows(data)[:2] == [["id", "t", "v", "d", "b"], ["1", "x & <y>", "2.5", "2024-02-29", "TRUE"]]
    got = xlsx.read_xlsx(spark, path).orderBy("_row_id").collect()
    assert (got[0].t, got[0].d) == ("x & <y>", "2024-02-29") and len(got) == 2
    two = tmp_path / "b.xlsx"
    two.write_bytes(xlsx.workbook([("A", ["k", "name"], [(1, "p")]), ("B", ["k", "name"], [(2, "q")])]))
    assert {(r.k, r.excel_worksheetname) for r in xlsx.read_all_sheets(spark, str(two)).collect()} == {("1", "A"), ("2", "B")}
    assert xlsx.serial_text(45351.75) == "2024-02-29 18:00:00"


def test_headers_of_two_rows_units_and_footers(spark, tmp_path):
    from lathework.sources import readers

    (tmp_path / "a.csv").write_text("Energy report\n\n,Load,,Price,\nsite,peak,mean,day,night\n,MW,MW,$,$\nA,10,8,1.5,1.0\nB,20,15,1.6,1.1\nTotal,30,23,,\nSource: nobody\n")
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["site", "Load peak (MW)", "Load mean (MW)", "Price day ($)", "Price night ($)", "_row_id"]
    assert [r.site for r in df.orderBy("_row_id").collect()] == ["A", "B"]
    assert readers.read_delimited(spark, str(tmp_path / "a.csv"), limit=1).count() == 1
    assert readers.read_delimited(spark, str(tmp_path / "a.csv"), cut_footer=False).count() == 4
