"""The score, the failing rows and the failing cells of a table with known flaws."""

from pyspark.sql import functions as F

from lathework.operators import scorecard as S


def flawed(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("k"),
        F.when(i % 10 == 0, "red ").when(i % 17 == 0, "N/A").when(i % 13 == 0, None).otherwise("Red ").alias("colour"),
        F.when(i % 9 == 0, F.concat(F.lit("$"), i.cast("string"))).when(i % 8 == 0, "oops").otherwise((i + 0.5).cast("string")).alias("amount"),
        F.when(i % 20 == 0, F.concat(F.lit("AB"), i)).otherwise(F.concat(F.lit("AB-"), i)).alias("code"),
        F.when(i % 7 == 0, "25/12/2023").otherwise("2023-12-25").alias("day"),
        F.when(i % 50 == 0, 240).otherwise(i % 90).alias("age"),
        F.when(i % 2 == 0, "x").alias("notes"),
    )


def rows(n=400):
    return range(n)


def test_checks_count_what_was_planted(spark):
    df = flawed(spark)
    got = {(r.check, r.column): (r.passed, r.failed, r.optional) for r in S.check_table(df, ["colour", "amount", "code", "day", "age", "notes"]).collect()}
    missing = sum(i % 10 != 0 and (i % 17 == 0 or i % 13 == 0) for i in rows())
    assert got[("completeness", "colour")] == (400 - missing, missing, False)
    assert got[("completeness", "notes")] == (200, 200, True)
    oops = sum(i % 9 != 0 and i % 8 == 0 for i in rows())
    assert got[("validity", "amount")][:2] == (400 - oops, oops)
    symbols = sum(i % 9 == 0 for i in rows())
    assert got[("validity.symbols", "amount")][:2] == (400 - oops - symbols, symbols)
    assert got[("validity", "code")][:2] == (380, 20)
    assert got[("validity.dateformat", "day")][1] == sum(i % 7 == 0 for i in rows())
    assert got[("validity.range", "age")][1] == 8
    red = sum(i % 10 == 0 for i in rows())
    assert got[("consistency.variants", "colour")][1] == red


def test_score_weighs_dimensions_and_holds_the_band_down(spark):
    df = flawed(spark)
    facts = S.find(df)
    more = [S.Check("timeliness", "timeliness.fresh", "day", 50, 50), S.Check("accuracy", "accuracy.reference", "colour", 1, 99)]
    results = S.checks(df, facts, more)
    parts = S.dimension_scores(results)
    got = S.score(df, more=more).first()
    assert parts["timeliness"] == 50 and got.accuracy == 1
    held = {d: S.WEIGHTS[d] for d in parts if S.WEIGHTS[d]}
    assert abs(got.score - sum(w * parts[d] for d, w in held.items()) / sum(held.values())) < 1e-9
    # A mostly empty column that is not optional holds the band down; marked optional it does not.
    bare = spark.range(100).select("id", F.when(F.col("id") < 20, "a").alias("a"), F.lit("b").alias("b"), F.when(F.col("id") < 80, "c").alias("c"))
    assert S.score(bare, ["id", "a", "b", "c"]).first().band == "poor"
    assert "a is 80% empty" in S.score(bare, ["id", "a", "b", "c"], optional={"a": False}).first().reason
    assert S.score(bare, ["id", "a", "b", "c"], optional={"a": True}).first().reason is None
    assert S.set_aside([S.Check("validity", "validity", "a", 1, 5)], {("validity", "a"): 5})[0].failed == 0
    empty = spark.createDataFrame([], "a string, n long")
    assert S.score(empty).first().score is None


def test_rows_affected_and_exceptions(spark):
    df = flawed(spark)
    columns = ["colour", "amount", "code", "day", "age", "notes"]
    facts = S.find(df, columns)
    bad = [i for i in rows() if i % 10 == 0 or i % 17 == 0 or i % 9 == 0 or i % 8 == 0 or i % 20 == 0 or i % 7 == 0]
    assert tuple(S.rows_affected(df, facts).first()) == (len(bad), 400)
    got = S.exceptions(df, facts, "k", ("code",)).collect()
    by = {}
    for r in got:
        by.setdefault((r.check, r.column), set()).add(r.row)
    assert by[("placeholder", "colour")] == {i for i in rows() if i % 17 == 0 and i % 10}
    assert by[("completeness", "colour")] == {i for i in rows() if i % 13 == 0 and i % 17 and i % 10}
    assert by[("consistency.variants", "colour")] == {i for i in rows() if i % 10 == 0}
    assert by[("validity", "amount")] == {i for i in rows() if i % 8 == 0 and i % 9}
    assert by[("validity.pattern", "code")] == {i for i in rows() if i % 20 == 0}
    assert by[("validity.range", "age")] == {i for i in rows() if i % 50 == 0}
    assert not any(c == "notes" for _, c in by)
    assert {r.value for r in got if r.column == "code"} == {"A9"}


def test_checks_asked_for(spark):
    df = spark.createDataFrame([(1, 2, "Monday", "2024-01-01"), (1, 0, "Tuesday", "2020-01-01"), (3, None, "Mnday", None), (4, 1, "Friday", "2024-05-05"), (5, 9, "Sunday", "2024-05-05")], "a long, b long, d string, t string")
    assert S.pair(df, "b", "a") == S.Check("consistency", "consistency.pair", "b", 2, 2, 1)
    assert S.key(df, ["a"]) == S.Check("uniqueness", "uniqueness.key", "a", 4, 1)
    assert S.fresh(df, "t", "2023-01-01") == S.Check("timeliness", "timeliness.fresh", "t", 3, 1, 1)
    assert S.reference(df, "d", "weekday") == S.Check("accuracy", "accuracy.reference", "d", 4, 1)


def test_suggestions_follow_the_findings(spark):
    df = flawed(spark).withColumn("blank", F.lit(None).cast("string")).withColumn("score", F.when(F.col("k") % 20 == 0, -999).otherwise(F.col("k") % 50))
    got = {(r.kind, r.column): (r["rows"], r.blocked) for r in S.suggestions(df, ["colour", "amount", "code", "day", "age", "blank", "score"]).collect()}
    oops = sum(i % 9 != 0 and i % 8 == 0 for i in rows())
    assert got == {
        ("blank placeholders", "colour"): (sum(i % 17 == 0 and i % 10 != 0 for i in rows()), False),
        ("merge spellings", "colour"): (40, False),
        ("convert to number", "amount"): (400, oops > 40),
        ("strip signs", "amount"): (sum(i % 9 == 0 for i in rows()), False),
        ("review format", "code"): (20, False),
        ("convert to date", "day"): (400, False),
        ("one date format", "day"): (sum(i % 7 == 0 for i in rows()), False),
        ("review values", "age"): (8, False),
        ("drop", "blank"): (400, False),
        ("missing code -999", "score"): (20, False),
    }


def test_a_cell_is_read_once_for_all_its_checks(spark):
    rows = [(i, "AB-%d" % i if i % 20 else "AB%d" % i, "2023-12-25" if i % 7 else "25/12/2023", "$%d" % i if i % 9 == 0 else "oops" if i % 8 == 0 else "%d.5" % i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, code string, day string, amount string")
    facts = S.find(df, ["code", "day", "amount"])
    out = S.exceptions(df, facts, "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(jan|feb") <= 3 and plan.count(r"^\(.*\)$") <= 3  # one layout and one number for each column at most
    assert {(r.row, r.column, r.check) for r in out.collect()} == {
        *((i, "code", "validity.pattern") for i in range(0, 200, 20)), *((i, "day", "validity.dateformat") for i in range(0, 200, 7)),
        *((i, "amount", "validity.symbols" if i % 9 == 0 else "validity") for i in range(200) if i % 9 == 0 or i % 8 == 0),
    }
