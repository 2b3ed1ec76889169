"""Plans and results where one value, chain or series holds a large share of the rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lathework.operators import compare, filters, models, order, pivot, review
from lathework.operators.aggregate import Measure


def test_facets_take_one_scan(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, " "]), rng.choice(["x", "y"]), rng.choice([1, 2, None])) for _ in range(300)]
    spark.createDataFrame(rows, "p string, q string, r int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tests = {"p": F.col("p") == "a", "q": F.col("q") == "x", "r": F.col("r") > 1}
    out = filters.facets(df, tests, ["p", "q", "r"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    keep = {"p": lambda v: v == "a", "q": lambda v: v == "x", "r": lambda v: v is not None and v > 1}
    want = {}
    for row in rows:
        own = dict(zip("pqr", row))
        for c in "pqr":
            if all(keep[k](own[k]) for k in "pqr" if k != c):
                label = "(empty)" if own[c] is None else str(own[c]).strip()
                want[c, label] = want.get((c, label), 0) + 1
    assert {(r.facet, r.label): r.n for r in out.collect()} == want


def test_order_functions_cut_a_value_that_most_rows_have(spark):
    rows = [(7 if i % 10 else i, i, float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "o int, i int, v double").repartition(4)
    part = df.select(order.range_part(df, "o", 8).alias("p")).groupBy("p").count().collect()
    assert len(part) == 8 and max(r["count"] for r in part) < 1000
    got = [r.n for r in order.row_number(df, "o", "n", ("i",)).orderBy("o", "i").collect()]
    assert got == list(range(1, 3001))
    total = order.running_sum(df, F.col("v"), "o", "s").agg(F.max("s"), F.count("s")).first()
    assert tuple(total) == (sum(v for *_, v in rows), 3000)


def test_draws_are_about_as_many_as_asked(spark):
    df = spark.range(20_000).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert 800 < len(models._sample(df, ["a", "b"], 1000, 3)) < 1200
    assert len(models._sample(df.limit(50), ["a", "b"], 1000, 3)) == 50


def test_a_data_value_is_no_margin(spark):
    df = spark.createDataFrame([("(total)", "x", 1.0), ("a", "x", 2.0), ("a", "(total)", 4.0)], "i string, c string, v double")
    got = {(r.i, r.c): r.s for r in pivot.pivot_long(df, ["i"], ["c"], [Measure("sum", "v", "s")]).collect()}
    assert got["'(total)'", "x"] == 1 and got["(total)", "x"] == 3 and got["(total)", "(total)"] == 7 and len(got) == 8
    share = {(r.i, r.c): r.share for r in pivot.pivot_percent(df, ["i"], ["c"], Measure("sum", "v", "s"), "column").collect()}
    assert share == {("'(total)'", "x"): pytest.approx(1 / 3), ("a", "x"): pytest.approx(2 / 3), ("a", "'(total)'"): 1.0}


def greedy(pairs):
    a_seen, b_seen, out = set(), set(), set()
    for a, b, rank in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in a_seen and b not in b_seen:
            a_seen.add(a)
            b_seen.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("component", [10_000, 5])
def test_one_to_one_on_chains_stars_and_random_pairs(spark, component):
    rng = random.Random(4)
    chain = [((k + 1) // 2, k // 2, 1 - k / 100) for k in range(30)]  # each pair is beaten by the one before
    star = [(100, 200 + k, rng.random()) for k in range(20)]
    other = list({(rng.randint(300, 330), rng.randint(300, 330)): None for _ in range(150)})
    pairs = chain + star + [(a, b, round(rng.random(), 1)) for a, b in other]
    df = spark.createDataFrame(pairs, "a_id long, b_id long, rank double")
    got = compare.one_to_one(df, rounds=1, component=component)
    assert {(r.a_id, r.b_id) for r in got.collect()} == greedy(pairs) and got.count() == len(greedy(pairs))
    assert compare.one_to_one(df.where("rank > 5")).count() == 0


def test_fuzzy_match_scores_keys_that_share_only_a_frequent_word(spark):
    left = [(i, f"street {chr(97 + i % 26)}{i} place") for i in range(200)] + [(900, "street of the rose")]
    right = [(i, f"street {chr(97 + i % 26)}{i} place") for i in range(200)] + [(901, "street of teh rosa")]
    a, b = (spark.createDataFrame(rows, "id long, k string") for rows in (left, right))
    found = {(r.a_id, r.b_id) for r in compare.fuzzy_match(a, b, "k", "id", "id").collect()}
    assert {(i, i) for i in range(200)} | {(900, 901)} == found


def test_text_network_by_groups_words_and_overlap(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        kind = rng.choice(["red", "blue"])
        rows.append((f"{kind} item number{i}", f"{kind} thing{i}" if i % 4 else None, "warm" if kind == "red" else "cold", float(i % 7) + (50 if kind == "red" else 0), rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "a string, b string, c string, v double, short string")
    got = {(r.a, r.b): r for r in review.text_network(df, ["a", "b", "short"], ["c"], ["v"]).collect()}
    assert got["a", "c"].basis in ("red", "blue") and got["a", "c"].effect == pytest.approx(1.0)
    assert got["a", "v"].kind == "eta2" and got["a", "v"].effect > 0.95
    shared = [(len({*x.split()} & {*y.split()}), len({*x.split()} | {*y.split()})) for x, y, *_ in rows if y]
    assert got["a", "b"].effect == pytest.approx(sum(i for i, _ in shared) / sum(u for _, u in shared)) and got["a", "b"].n == len(shared)
    assert not any("short" in key for key in got)
    groups = {(r.a, r.b): r for r in review.text_network(df.withColumn("short", F.when(F.col("c") == "warm", "hot stuff").otherwise(" ")), ["short"], ["c"], ["v"]).collect()}
    assert groups["short", "c"].basis is None and groups["short", "c"].effect == pytest.approx(1.0)
    assert review.text_network(df.where("v < 0"), ["a", "b"], ["c"], ["v"]).count() == 0
    assert review.text_network(df, ["a"]).count() == 0


@pytest.mark.parametrize("seconds,want", [(420, 5), (1800, 30), (1700, 30), (20, 1), (3 * 3600, 60), (20 * 3600, 1440)])
def test_base_slot_from_the_typical_gap(spark, seconds, want):
    import datetime

    from lathework.operators import timeseries

    t0 = datetime.datetime(2024, 3, 1, 6)
    rows = [(t0 + datetime.timedelta(seconds=seconds * k),) for k in range(60)] * 2 + [(None,)]
    got = timeseries.base_slot(spark.createDataFrame(rows, "t timestamp_ntz"), "t").first()
    assert (got.minutes, got.typical, got.gaps) == (want, seconds, 59)


def test_base_slot_of_days_and_of_nothing(spark):
    import datetime

    from lathework.operators import timeseries

    days = spark.createDataFrame([(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k),) for k in range(30)], "t timestamp_ntz")
    assert timeseries.base_slot(days, "t").first().minutes == 1440
    assert tuple(timeseries.base_slot(days.limit(1), "t").first()) == (1440, None, 0)
    assert tuple(timeseries.base_slot(days.where("t is null"), "t").first()) == (1440, None, 0)
    long = [datetime.datetime(2000, 1, 1) + datetime.timedelta(minutes=k) for k in range(50)] + [datetime.datetime(2010, 1, 1)]
    assert timeseries.base_slot(spark.createDataFrame([(x,) for x in long], "t timestamp_ntz"), "t").first().minutes == 5


def test_key_tokens_go_to_tasks_of_bounded_size(spark):
    n = 1_200_000
    a = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    out = compare.suggest_keys(a, a, ["k", "n"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = [int(p) for p in re.findall(r"hashpartitioning\(key#\d+, v#\d+[^)]*, (\d+)\)", plan)]
    # Both sides' tokens of both columns, whatever the session's partitions; nothing is sorted for a join.
    assert parts and min(parts) * 500_000 >= 4 * n and "Join" not in plan
    got = {r.column: (r.rows, r.kinds, r.filled, r.shared, r.overlap, r.usable) for r in out.collect()}
    assert got == {"k": (n, n, n, n, 1.0, True), "n": (n, 7, n, 7, 1.0, False)}


def test_key_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(order, "PART_ROWS", 500)
    rng = random.Random(5)
    # Hot values, blanks, padded texts, values of one side only, a column without a value on one side.
    draw = lambda i, s: (f"{s}{i}" if i % 3 else rng.choice(["x", " x ", "", "  ", None, f"r{rng.randrange(2000)}"]), rng.choice([7, 7, 7, rng.randrange(3000), None]), None if s == "a" else i)
    left, right = [draw(i, "a") for i in range(3000)], [draw(i, rng.choice("ab")) for i in range(2500)]
    a, b = (spark.createDataFrame(x, "t string, n int, m int").repartition(3) for x in (left, right))
    cols = ["t", "n", "m"]
    got = {r.column: r for r in compare._keys(a, b, [["t"], ["n"], ["m"], ["t", "n"]]).collect()}
    for key in (["t"], ["n"], ["m"], ["t", "n"]):
        told = []
        for rows in (left, right):
            cells = [tuple("" if r[cols.index(c)] is None else str(r[cols.index(c)]).strip() for c in key) for r in rows]
            told.append(Counter(c for c in cells if all(c)))
        one, two = told
        r, hits = got[" + ".join(key)], sum(two[v] for v in two if v in one)
        assert (r.rows, r.kinds, r.filled or 0, r.shared) == (3000, len(one), sum(one.values()), len(one.keys() & two.keys()))
        assert (r.flawed, r.flawed_b) == pytest.approx(((3000 - len(one)) / 3000, (2500 - len(two)) / 2500)) and r.overlap == pytest.approx(hits / sum(two.values()))
    assert compare.suggest_keys(a, b.limit(0), cols).count() == 0 and compare.suggest_key_pairs(a, b.limit(0), cols).count() == 0
