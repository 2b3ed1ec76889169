"""Shapes, check digits and levels of the sensitivity scan."""

from lathework.operators import sensitive as S


def test_check_digits(spark):
    from pyspark.sql import functions as F

    rows = [("4111111111111111", "GB82WEST12345698765432", "51 824 753 556", "123 456 782", "004 085 616"), ("4111111111111112", "GB82WEST12345698765433", "51 824 753 557", "123 456 789", "004 085 617")]
    df = spark.createDataFrame(rows, "card string, iban string, abn string, tfn string, acn string")
    by = {s.name: s for s in S.SHAPES}
    got = df.select(*[by[c].test(F.col(c)).alias(c) for c in df.columns]).collect()
    assert all(got[0]) and not any(got[1])


def test_levels_follow_shares_names_and_embedding(spark):
    n = 100
    rows = [
        (
            f"u{i}@x.org" if i < 70 else "none", f"+61 412 345 {i:03d}" if i < 40 else "-", "4111 1111 1111 1111" if i < 95 else "x", f"1.2.3.{i}", f"10.0.0.{i}",
            "call 0412 345 678 now please" if i < 4 else "nothing to see here", "a", 4111111111111111, f"AB{i}", "Ann", "x",
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "who string, mobile string, plain string, version string, host string, remark string, gender string, card_number long, sku string, first_name string, product_name string")
    got = {r.column: (r["class"], r.confidence, r.label) for r in S.scan(df).collect()}
    assert got == {
        "who": ("contact", "high", "confidential"),
        "mobile": ("contact", "high", "confidential"),
        "plain": ("financial", "high", "confidential"),
        "host": ("location", "high", "confidential"),
        "remark": ("free_text", "medium", "confidential"),
        "gender": ("demographic", "low", "internal"),
        "card_number": ("financial", "high", "confidential"),
        "first_name": ("personal_name", "medium", "confidential"),
    }
    assert S.scan(df.limit(0)).where("share > 0").count() == 0
