import datetime

import pytest

from lathework.functions import formula


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 10.0, "Hello World", None, datetime.date(2024, 1, 31), True), (2, -7.5, "", 3.0, datetime.date(2024, 2, 29), False), (3, None, "o'brien-smith mc", 0.0, None, None)],
        "id int, n double, t string, m double, d date, b boolean",
    )


def value(table, text, row=1, order="id"):
    return table.select("id", formula.Compiler(table, order, "2024-06-15 08:30:00").column(text).alias("x")).where(f"id = {row}").first().x


@pytest.mark.parametrize(
    "text,row,want",
    [
        ("=-2^2", 1, 4.0), ("2^3^2", 1, 512.0), ("1+2*3", 1, 7.0), ("[n]+[m]", 1, None), ("[n]/0", 1, None), ("IFERROR([n]/0,9)", 1, 9.0), ("IFERROR(IFERROR(1/0,SQRT(-1)),5)", 1, 5.0),
        ('[t]="hello world"', 1, True), ("[m]=3", 1, False), ("[m]<>3", 1, True), ("AND([b],[m]>1)", 1, False), ("OR([b],[n]>1)", 3, False), ("NOT([b])", 3, True),
        ("MOD(-7,3)", 1, 2.0), ("MOD(5,-3)", 1, -1.0), ("ROUND(2.5,0)", 1, 3.0), ("ROUND(-2.5,0)", 1, -3.0), ("ROUND(1.005,2)", 1, 1.01), ("INT(-7.5)", 1, -8.0), ("TRUNC(-7.59,1)", 1, -7.5), ("ROUNDUP(2.01,1)", 1, 2.1),
        ("CEILING(7,5)", 1, 10.0), ("FLOOR(-7,5)", 1, -10.0), ("CEILING(5,-2)", 1, None), ("MIN([n],[m],4)", 1, 4.0), ("MAX([n],[m])", 2, 3.0), ("SUM([n],[m])", 1, 10.0), ("AVERAGE([n],[m])", 3, 0.0), ("POWER(-8,0.5)", 1, None), ("LN(0)", 1, None),
        ("LEN([t])", 1, 11.0), ("LEN([t])", 2, 0.0), ("LEFT([t],5)", 1, "Hello"), ("RIGHT([t],5)", 1, "World"), ("MID([t],7,3)", 1, "Wor"), ('FIND("World",[t])', 1, 7.0), ('FIND("world",[t])', 1, None), ('SEARCH("world",[t])', 1, 7.0),
        ("PROPER([t])", 3, "O'Brien-Smith Mc"), ('TRIM("  a   b ")', 1, "a b"), ('SUBSTITUTE([t],"o","0")', 1, "Hell0 W0rld"), ('SUBSTITUTE([t],"o","0",2)', 1, "Hello W0rld"), ('REPLACE([t],1,5,"Bye")', 1, "Bye World"),
        ('TEXTBEFORE([t]," ")', 1, "Hello"), ('TEXTAFTER([t],"@")', 1, None), ('TEXTAFTER([t],"o",-1)', 1, "rld"), ('TEXTJOIN("-",TRUE,[t],"","x")', 1, "Hello World-x"), ('EXACT([t],"hello world")', 1, False), ('CONTAINS([t],"WORLD")', 1, True),
        ('CONCAT([n],"|",[b])', 1, "10|TRUE"), ('VALUE("$1,234.5")', 1, 1234.5), ('VALUE("12%")', 1, 0.12), ('TEXT(1234.567,"#,##0.00")', 1, "1,234.57"), ('TEXT([d],"YYYY-MM")', 1, "2024-01"), ('"a""b"', 1, 'a"b'),
        ("YEAR([d])", 1, 2024.0), ("EDATE([d],1)", 1, datetime.date(2024, 2, 29)), ("EOMONTH([d],1)", 1, datetime.date(2024, 2, 29)), ("[d]+1", 1, datetime.date(2024, 2, 1)), ("DATE(2024,14,1)", 1, datetime.date(2025, 2, 1)), ("DATE(2024,1,0)", 1, datetime.date(2023, 12, 31)),
        ('DATEDIF([d],EDATE([d],1),"m")', 1, 0.0), ("DAYS(DATE(2024,3,1),[d])", 1, 30.0), ("WEEKDAY([d])", 1, 4.0), ("WEEKDAY([d],3)", 1, 2.0), ("WEEKNUM(DATE(2024,1,7))", 1, 2.0), ("WEEKNUM(DATE(2024,1,7),21)", 1, 1.0), ("TODAY()", 1, datetime.date(2024, 6, 15)),
        ("IFS([n]>100,1,[n]>5,2)", 1, 2.0), ("IFS([n]>100,1)", 1, None), ('SWITCH([id],1,"one",2,"two","many")', 3, "many"), ("ISBLANK([t])", 2, True), ("ISNUMBER([n])", 3, False), ("COALESCE([m],[n],1)", 1, 10.0), ('IF([n]>0,"yes")', 2, None),
        ("ROWNUMBER()", 3, 3.0), ("RANK([n])", 1, 1.0), ("RANK([n])", 3, None), ("RUNNINGSUM([n])", 2, 2.5), ("PREVIOUS([n])", 2, 10.0), ("PERCENTOFTOTAL([n])", 1, 400.0), ("COLUMNMEAN([n])", 1, 1.25), ("BIN([n],2)", 1, 2.0), ("COLUMNSTDEV([m])", 1, pytest.approx(2.1213, abs=1e-4)),
    ],
)
def test_values(table, text, row, want):
    assert value(table, text, row) == want


@pytest.mark.parametrize("text", ["1+", "[nope]", "FOO(1)", "(1", '"a', "SQRT()", "1 2", "LEFT([d])+[t]"])
def test_unreadable_formulas(table, text):
    with pytest.raises(formula.FormulaError):
        formula.Compiler(table, "id").compile(text)
    assert formula.apply(table, {"x": text}, "id").columns == table.columns


def test_error_flags(table):
    c = formula.Compiler(table, "id")
    got = {r.id: r.e for r in table.select("id", c.error("10/[m]").alias("e")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_every_function_is_there():
    names = """IF AND OR NOT IFS SWITCH IFERROR ISBLANK ISNUMBER ISTEXT COALESCE IFBLANK ROUND ABS MIN MAX SUM AVERAGE INT TRUNC ROUNDDOWN ROUNDUP MOD SQRT POWER LN CEILING FLOOR
    LEN LEFT RIGHT MID FIND SEARCH UPPER LOWER TRIM CONCAT CONTAINS SUBSTITUTE REPLACE PROPER EXACT TEXTBEFORE TEXTAFTER TEXTJOIN TEXT VALUE YEAR MONTH DAY WEEKDAY DATEDIF DATE TODAY NOW EDATE EOMONTH WEEKNUM DAYS HOUR MINUTE SECOND
    ROWNUMBER RANK PERCENTOFTOTAL RUNNINGSUM PREVIOUS COLUMNMEAN COLUMNMEDIAN COLUMNSTDEV BIN""".split()
    assert [n for n in names if not hasattr(formula.Compiler, f"f_{n.lower()}")] == []
