"""Reviews of a column's text: layouts, symbols, encodings, sentinels, scales, places, reference lists, history."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import cleans
from ..functions import text as T
from .aggregate import finite

#: Layouts of date texts in the order in which they are tried; fixed values.
DATE_LAYOUTS = {
    "iso": r"^\d{4}-\d{2}-\d{2}([T ].*)?$",
    "y/m/d": r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}$",
    "day first": r"^(1[3-9]|2\d|3[01])[/.-](0?[1-9]|1[0-2])[/.-]\d{2,4}$",
    "month first": r"^(0?[1-9]|1[0-2])[/.-](1[3-9]|2\d|3[01])[/.-]\d{2,4}$",
    "ambiguous": r"^(0?[1-9]|1[0-2])[/.-](0?[1-9]|1[0-2])[/.-]\d{2,4}$",
    "named month": r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b.*\d{4}",
    "compact": r"^(19|20)\d{6}$",
}


def _layout(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for name, pattern in DATE_LAYOUTS.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def date_layouts(df: DataFrame, column: str) -> DataFrame:
    """How many cells have each date layout."""
    return df.groupBy(_layout(F.col(column)).alias("layout")).agg(F.count(F.lit(1)).alias("n")).where("layout is not null")


def date_order_conflict(df: DataFrame, column: str) -> DataFrame:
    """Cells that can only be day first, only month first, and either; both kinds in one column are a conflict."""
    n = lambda k: F.count_if(_layout(F.col(column)) == k)
    return df.agg(n("day first").alias("day_first"), n("month first").alias("month_first"), n("ambiguous").alias("ambiguous")).withColumn("conflict", (F.col("day_first") > 0) & (F.col("month_first") > 0))


#: Beginnings of UTF-8 letters read as windows-1252.
MOJIBAKE = r"Ã[\x80-\xBFŒœŠšŸŽžƒˆ˜–-™€]|Â[\xA0-\xBF]|â€|ï»¿|�"


def mojibake(df: DataFrame, column: str) -> DataFrame:
    """Cells with signs of a wrong decoding."""
    return df.where(F.col(column).rlike(MOJIBAKE))


def fix_mojibake(c: Column) -> Column:
    """windows-1252 text read again as UTF-8; a text that does not decode stays."""

    def fix(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not re.search("[ÃÂâï]", x):
                return x
            try:
                raw = b"".join(bytes([ord(ch)]) if 0x80 <= ord(ch) < 0xA0 else ch.encode("cp1252") for ch in x)
                return raw.decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                return x

        return s.map(one, na_action="ignore")

    return F.pandas_udf(fix, StringType())(c)


def number_symbols(df: DataFrame, column: str) -> DataFrame:
    """Currency signs and percent signs among number cells."""
    symbol = F.regexp_extract(F.col(column).cast("string"), r"([$€£¥%])", 1)
    known = cleans.number(F.col(column)).isNotNull()
    return df.where(known).groupBy(F.when(symbol == "", "none").otherwise(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


#: Codes that often stand for a missing number; fixed values.
SENTINELS = (-1, -9, -99, -999, -9999, 9, 99, 999, 9999, 99999, 999999)


def sentinels(df: DataFrame, column: str) -> DataFrame:
    """Codes for missing values: outside of what the other values span, from 5 cells (negative codes 3) and 1 % on."""
    x = finite(F.col(column).cast("double"))
    base = df.where(x.isNotNull())
    code = x.isin(*[float(v) for v in SENTINELS])
    span = base.agg(F.count(F.lit(1)).alias("all"), F.percentile(F.when(~code, x), F.array(F.lit(0.0), F.lit(1.0))).alias("q"))
    n = base.where(code).groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span))
    out = (F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[1])
    enough = (F.col("n") >= F.when(F.col("value") < 0, 3).otherwise(5)) & (F.col("n") >= 0.01 * F.col("all"))
    return n.where(out & enough).select("value", "n")


#: Ranges that a column's name promises: an own list.
NAMED_RANGES = {"age": (0, 120), "percent": (0, 100), "pct": (0, 100), "latitude": (-90, 90), "lat": (-90, 90), "longitude": (-180, 180), "lon": (-180, 180), "lng": (-180, 180), "month": (1, 12), "day": (1, 31), "hour": (0, 23), "year": (1800, 2100), "rating": (0, 10)}


def plausibility(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers outside the range that their column's name promises, by column; one pass."""
    aggs = []
    for c in columns:
        hit = next((r for w, r in NAMED_RANGES.items() if w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", c).lower())), None)
        if hit:
            x = finite(F.col(f"`{c}`").cast("double"))
            aggs.append(F.struct(F.lit(c).alias("column"), F.lit(float(hit[0])).alias("low"), F.lit(float(hit[1])).alias("high"), F.count_if((x < hit[0]) | (x > hit[1])).alias("outside")).alias(f"c{len(aggs)}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, outside bigint")
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])))


def scale_mix(df: DataFrame, column: str) -> DataFrame:
    """Shares and percentages in one column: cells in [0, 1] and in (1, 100], when both are a tenth or more."""
    x = finite(F.col(column).cast("double"))
    return df.agg(F.avg((x.between(0, 1)).cast("double")).alias("shares"), F.avg(((x > 1) & (x <= 100)).cast("double")).alias("percents")).withColumn("mixed", (F.col("shares") >= 0.1) & (F.col("percents") >= 0.1))


def coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Pairs at 0,0, out of range, and probably swapped."""
    a, b = F.col(lat), F.col(lon)
    return df.agg(
        F.count_if((a == 0) & (b == 0)).alias("null_island"),
        F.count_if((F.abs(a) > 90) & (F.abs(b) <= 90)).alias("swapped"),
        F.count_if((F.abs(a) > 90) & (F.abs(b) > 90) | (F.abs(b) > 180)).alias("out_of_range"),
    )


#: Reference lists: the common entries, an own choice.
REFERENCE = {
    "weekday": "monday tuesday wednesday thursday friday saturday sunday".split(),
    "month": "january february march april may june july august september october november december".split(),
    "currency": "usd eur gbp jpy aud cad chf cny sek nzd mxn sgd hkd nok krw try inr brl zar dkk pln thb idr huf czk ils clp php aed".split(),
    "au_state": "nsw vic qld sa wa tas nt act".split(),
    "boolean": "yes no true false".split(),
}


def reference_accuracy(df: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """Values of a list-like column that its list does not know, with the nearest entry within two letters.

    The list is the one that knows most distinct values, 60 % at least.
    """
    v = df.where(F.col(column).isNotNull()).groupBy(F.lower(F.trim(F.col(column).cast("string"))).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    entries = spark.createDataFrame([(k, e) for k, es in REFERENCE.items() if kind in (None, k) for e in es], "list string, entry string")
    shares = v.join(F.broadcast(entries), v["value"] == entries["entry"]).groupBy("list").agg(F.sum("n").alias("known"))
    total = v.agg(F.sum("n").alias("all"))
    best = shares.crossJoin(total).where(F.col("known") >= 0.6 * F.col("all")).orderBy(F.col("known").desc(), "list").limit(1).select("list")
    own = entries.join(F.broadcast(best), "list")
    unknown = v.join(F.broadcast(own), v["value"] == own["entry"], "left_anti").crossJoin(F.broadcast(best))
    near = unknown.join(F.broadcast(own.withColumnRenamed("list", "_l")), F.levenshtein("value", "entry") <= 2, "left")
    return near.groupBy("list", "value", "n").agg(F.min_by("entry", F.struct(F.levenshtein("value", "entry"), "entry")).alias("suggestion"))


def history(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Fill rates of two loads by column, and whether they moved by more than five points."""
    one = lambda df, n: df.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(c) for c in columns]).unpivot([], columns, "column", n)
    both = one(before, "before").join(one(after, "after"), "column")
    return both.withColumn("moved", F.abs(F.col("after") - F.col("before")) > 0.05)


def archetype(df: DataFrame) -> str:
    """A guess at the kind of table from names and types: events, series, survey, places, entities."""
    names = " ".join(df.columns).lower()
    types = [t for _, t in df.dtypes]
    when = any(t.startswith(("date", "timestamp")) for t in types)
    if re.search(r"\b(lat|latitude)\b", names.replace("_", " ")):
        return "places"
    if when and re.search(r"event|user|session|action|type", names):
        return "events"
    if when and sum(t in ("double", "float") for t in types) >= len(types) - 2:
        return "series"
    if len(re.findall(r"\bq\d+|question", names)) >= 3:
        return "survey"
    return "entities"


def column_network(df: DataFrame, numbers: list[str], categories: list[str], least: float = 0.3) -> DataFrame:
    """Associated columns: a, b, kind, effect (Pearson, eta squared's root, Cramér's V), strong ones only."""
    from itertools import combinations

    from . import profile

    out = profile.pearson(df, list(combinations(numbers, 2))).select("a", "b", F.lit("pearson").alias("kind"), F.col("r").alias("effect")) if len(numbers) > 1 else None
    for a, b in combinations(categories, 2):
        v = profile.cramers_v(df, a, b).select("a", "b", F.lit("cramer").alias("kind"), F.col("v").alias("effect"))
        out = v if out is None else out.unionByName(v)
    for c in categories:
        for n in numbers:
            e = profile.eta_squared(df, c, n).select(F.lit(c).alias("a"), F.lit(n).alias("b"), F.lit("eta").alias("kind"), F.sqrt("eta2").alias("effect"))
            out = e if out is None else out.unionByName(e)
    return out.where(F.abs("effect") >= least)


#: Terms tried of a free text, rows that a term must and must not be in, rows of a pair; fixed values.
TERMS, LEAST_TERM, LEAST_PAIR = 12, 10, 20


def text_network(df: DataFrame, text: list[str], categories: list[str] = (), numbers: list[str] = (), top: int = 20, least: float = 0.3, least_overlap: float = 0.08) -> DataFrame:
    """Associations of text columns: ``a``, ``b``, ``kind``, ``effect``, ``n`` and ``basis`` (the term, of a free text).

    Two texts: the words that they share row by row over all words of both
    (``overlap``).  A text and a category (Cramér's V) or a number (eta squared):
    a text of at most ``2 top`` values by its ``top`` values and the rest, any
    other by whether one of its most widespread words is in it, the best of
    these.  Words of two letters or more that are no stop words count.

    One aggregate gives the shared words of all pairs; one more, over (feature,
    code, column, value), every table of counts and means: rows are folded where
    they lie.  Only the tops of values and words reach the driver.  Missing and
    blank cells are a value of their own and have no words; pairs of under
    ``LEAST_PAIR`` rows, and an empty table, give no row.
    """
    from itertools import combinations

    from .profile import STOP_WORDS

    spark = df.sparkSession
    label = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")), F.lit("(empty)"))
    terms = lambda c: F.array_distinct(F.filter(T.tokens(F.col(f"`{c}`")), lambda w: (F.char_length(w) >= 2) & ~w.isin(STOP_WORDS)))
    held = df.select(
        *[label(c).alias(f"_l{i}") for i, c in enumerate(text)], *[terms(c).alias(f"_t{i}") for i, c in enumerate(text)],
        *[label(c).alias(f"_c{j}") for j, c in enumerate(categories)], *[finite(F.col(f"`{c}`").cast("double")).alias(f"_n{j}") for j, c in enumerate(numbers)],
    )
    parts, pairs = [], list(combinations(range(len(text)), 2))
    schema = "a string, b string, kind string, effect double, n bigint, basis string"
    if pairs:
        both = [(F.size(f"_t{a}") > 0) & (F.size(f"_t{b}") > 0) for a, b in pairs]
        shared = [F.struct(F.sum(F.when(ok, F.size(F.array_intersect(f"_t{a}", f"_t{b}")))).alias("i"), F.sum(F.when(ok, F.size(F.array_union(f"_t{a}", f"_t{b}")))).alias("u"), F.count_if(ok).alias("n")) for ok, (a, b) in zip(both, pairs, strict=True)]
        one = held.agg(F.array(*[F.struct(F.lit(text[a]).alias("a"), F.lit(text[b]).alias("b"), s.alias("s")) for s, (a, b) in zip(shared, pairs, strict=True)]).alias("p")).select(F.inline("p"))
        one = one.select("a", "b", F.lit("overlap").alias("kind"), F.try_divide(F.col("s.i"), F.col("s.u")).alias("effect"), F.col("s.n").alias("n"), F.lit(None).cast("string").alias("basis"))
        parts.append(one.where(F.col("effect") >= least_overlap))
    # Features of the texts: a group for each top value, or one word in or out.
    rows, features = held.count(), []
    for i in range(len(text)):
        values = held.groupBy(F.col(f"_l{i}").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(2 * top + 1).collect()
        if len(values) <= 2 * top:
            order = F.array(*[F.lit(r["v"]) for r in values[:top]]) if values else F.array().cast("array<string>")
            features.append((i, None, F.array_position(order, F.col(f"_l{i}")).cast("int")))
            continue
        often = held.select(F.explode(f"_t{i}").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= rows - 2))
        for r in often.orderBy(F.desc("n"), "v").limit(TERMS).collect():
            if min(r["n"], rows - r["n"]) >= LEAST_TERM:
                features.append((i, r["v"], F.array_contains(f"_t{i}", r["v"]).cast("int")))
    targets = [(c, F.col(f"_c{j}"), F.lit(None).cast("double")) for j, c in enumerate(categories)] + [(c, F.lit(None).cast("string"), F.col(f"_n{j}")) for j, c in enumerate(numbers)]
    if features and targets:
        each = held.select(F.array(*[code for *_, code in features]).alias("f"), F.array(*[F.struct(v.alias("v"), x.alias("x")) for _, v, x in targets]).alias("t"))
        long = each.select(F.posexplode("f").alias("fi", "code"), "t").select("fi", "code", F.posexplode("t").alias("ti", "t")).select("fi", "code", "ti", "t.v", "t.x").where("v is not null or x is not null")
        cells = long.groupBy("fi", "code", "ti", "v").agg(F.count(F.lit(1)).alias("o"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
        pair, fc, tv = (Window.partitionBy("fi", "ti", *more) for more in ((), ("code",), ("v",)))  # counts only: bounded by the groups of a pair
        wide = cells.withColumns({"n": F.sum("o").over(pair), "r": F.sum("o").over(fc), "c": F.sum("o").over(tv), "mm": F.sum(F.col("m") * F.col("o")).over(pair) / F.sum("o").over(pair)})
        between, inside = F.sum(F.col("o") * (F.col("m") - F.col("mm")) ** 2), F.sum(F.col("o") * F.col("s"))
        told = wide.groupBy("fi", "ti").agg(
            F.max("n").alias("n"), F.countDistinct("code").alias("kf"), F.countDistinct("v").alias("kt"), (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1).alias("chi"), F.try_divide(between, between + inside).alias("eta")
        )
        names = spark.createDataFrame([(k, text[i], basis) for k, (i, basis, _) in enumerate(features)], "fi int, a string, basis string")
        ends = spark.createDataFrame([(k, c, "eta2" if c in numbers else "cramer") for k, (c, *_) in enumerate(targets)], "ti int, b string, kind string")
        told = told.join(F.broadcast(names), "fi").join(F.broadcast(ends), "ti").where((F.col("n") >= LEAST_PAIR) & (F.col("kf") >= 2) & ((F.col("kind") == "eta2") | (F.col("kt") >= 2)))
        effect = F.when(F.col("kind") == "eta2", F.col("eta")).otherwise(F.sqrt(F.greatest("chi", F.lit(0.0)) / (F.least("kf", "kt") - 1)))
        best = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.round("effect", 9).desc_nulls_last(), "fi"))
        told = told.withColumn("effect", effect).withColumn("_at", best).where((F.col("_at") == 1) & (F.col("effect") >= least))
        parts.append(told.select("a", "b", "kind", "effect", "n", "basis"))
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out
