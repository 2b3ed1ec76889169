"""Casts with a channel for what fails."""

import pytest
from pyspark.sql import functions as F

from lathework.functions import cleans
from lathework.operators import transforms

#: (target, raw, canonical text; None: it fails).
CASES = [
    ("integer", "1", "1"), ("integer", "2.5", None), ("integer", "T", None), ("integer", "1,000", "1000"), ("integer", " 7 ", "7"), ("integer", "007", "7"), ("integer", "-3", "-3"),
    ("number", " 1,234.50 ", "1234.5"), ("number", "oops", None), ("number", "$9", "9"), ("number", "(12)", "-12"), ("number", "1e3", "1000"), ("number", "1,23", None),
    ("date", "2024-01-01", "2024-01-01"), ("date", "not a date", None), ("date", "01/02/2024", "2024-02-01"), ("date", "31/02/2024", None), ("date", "2024-02-01 10:30:00", "2024-02-01"),
    ("datetime", "2024-02-01 10:30:00", "2024-02-01T10:30:00Z"), ("datetime", "2024-02-01T10:30:00.250", "2024-02-01T10:30:00.250Z"), ("datetime", "01/02/2024", "2024-02-01T00:00:00Z"), ("datetime", "later", None),
    ("time", "9:05", "09:05"), ("time", "23:59", "23:59"), ("time", "24:00", None), ("time", "12:30 am", "00:30"), ("time", "1:05 PM", "13:05"), ("time", "13:05 pm", None), ("time", "noon", None),
    ("duration", "2h 30m", "2:30:00"), ("duration", "01:15:00", "1:15:00"), ("duration", "1 day", "24:00:00"), ("duration", "90 secs", "0:01:30"), ("duration", "9:05", None), ("duration", "2h and", None), ("duration", "100:00:01", "100:00:01"),
    ("boolean", "Yes", "true"), ("boolean", "no", "false"), ("boolean", "1", "true"), ("boolean", "FALSE", "false"), ("boolean", "maybe", None), ("boolean", "t", "true"),
]


def cells(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, v string")


@pytest.mark.parametrize("target", ["integer", "number", "date", "datetime", "time", "duration", "boolean"])
def test_each_target_in_each_mode(spark, target):
    own = [(raw, want) for kind, raw, want in CASES if kind == target]
    df = cells(spark, [raw for raw, _ in own] + [None, "", "NA", " n/a "])
    for mode in ("coerce", "keep", "reject"):
        got = [(r.v, r.v_failed) for r in transforms.cast_column(df, "v", target, mode).orderBy("id").collect()]
        failing = any(want is None for _, want in own)
        for (raw, want), (value, failed) in zip(own, got):
            assert failed == (want is None), raw
            assert value == (raw if mode == "reject" and failing else want if want is not None else None if mode == "coerce" else raw), raw
        assert got[len(own) :] == [(None, False), ("", False), ("NA", False), (" n/a ", False)]
    assert sorted(r.v for r in transforms.cast_failures(df, "v", target).collect()) == sorted(raw for raw, want in own if want is None)


def test_reject_applies_when_nothing_fails(spark):
    got = transforms.cast_column(cells(spark, ["1.50", "2", None]).withColumn("v_failed", F.lit("clash")), "v", "number", "reject").orderBy("id").collect()
    assert [(r.v, r.v_failed) for r in got] == [("1.5", False), ("2", False), (None, False)]


def test_report_counts_rows_not_texts(spark):
    df = cells(spark, ["1", "2.5", "T", "T", "", "NA", "007", "12345678901234567", " 3"])
    r = transforms.cast_report(df, "v", "integer").first()
    assert (r.non_empty, r.failed, r.changed, r.digits_lost, r.applied, r.examples) == (7, 3, 6, 2, True, ["T", "2.5"])
    r = transforms.cast_report(df, "v", "integer", "keep").first()
    assert (r.failed, r.changed, r.applied) == (3, 3, True)
    r = transforms.cast_report(df, "v", "integer", "reject").first()
    assert (r.failed, r.changed, r.applied) == (3, 0, False)
    r = transforms.cast_report(cells(spark, ["1"]).where("id > 0"), "v", "integer").first()
    assert (r.non_empty, r.failed, r.changed, r.examples) == (0, 0, 0, [])


def test_month_first_and_comma_marks(spark):
    df = cells(spark, ["01/02/2024"])
    assert transforms.cast_column(df, "v", "date", order="mdy").first().v == "2024-01-02"
    assert transforms.cast_column(cells(spark, ["1.234,5"]), "v", "number", comma=True).first().v == "1234.5"
    with pytest.raises(ValueError):
        cleans.canonical(F.col("v"), "colour")
