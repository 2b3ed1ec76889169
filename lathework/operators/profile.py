"""Profiles, data-quality checks, fences, rules, relationships and scores."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics
from ..functions import text as T
from .aggregate import finite
from .quantiles import quantiles, with_quantiles

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_number(df: DataFrame, column: str) -> bool:
    t = df.schema[column].dataType.simpleString()
    return t in NUMBERS or t.startswith("decimal")


# -- statistics --------------------------------------------------------------


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: rows, nulls, exact distinct, min, max, mean, population sd, lengths.  One pass."""
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = finite(F.col(f"`{c}`")) if is_number(df, c) else F.lit(None).cast("double")
        s = F.col(f"`{c}`").cast("string")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"),
                F.countDistinct(s).alias("distinct"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("sd"),
                F.min(F.char_length(s)).alias("min_length"),
                F.max(F.char_length(s)).alias("max_length"),
            ).alias(f"_c{i}")
        )
    one = df.agg(*aggs)
    return one.select("rows", F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(columns))])).alias("s")).select("rows", "s.*")


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    c = F.col(column).cast("string")
    return df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null").orderBy(F.col("n").desc(), "value").limit(n)


def dataset_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, duplicate rows beyond the first, groups of duplicates, rows in these, empty rows, rows and cells with nulls."""
    columns = columns or [c for c in df.columns if c != "_input_filename"]
    copies = df.groupBy(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    cells = sum((F.col(f"_{i}").isNull().cast("int") for i in range(len(columns))), F.lit(0))
    copies = copies.select("n", cells.alias("nulls"))
    return copies.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(F.when(F.col("nulls") == len(columns), F.col("n"))), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.when(F.col("nulls") > 0, F.col("n"))), F.lit(0)).alias("null_rows"),
        F.sum(F.col("nulls") * F.col("n")).alias("null_cells"),
    )


# -- fences ------------------------------------------------------------------

REACH = 3.5 / 0.6745


def value_fence(df: DataFrame, column: str) -> DataFrame:
    """One row: low, high and kind (linear, log, quantile, none) of the normal range of a number.

    median ± 3.5 / 0.6745 MAD with at least 20 values; on log1p when nothing is
    negative and the quartiles lean right; the 0.5 % tails when a fence would
    flag more than 2 % of 500 or more values; none when the MAD is 0.
    """
    kind, low, high = fence(df, column)
    return df.sparkSession.createDataFrame([(column, kind, low, high)], "column string, kind string, low double, high double")


def fence(df: DataFrame, column: str) -> tuple[str, float | None, float | None]:
    """Kind, low and high of a column's fence; three one-row results reach the driver."""
    x = finite(F.col(column).cast("double"))
    base = df.select(x.alias("x")).where("x is not null")
    first = quantiles(base, F.col("x"), [0.005, 0.25, 0.5, 0.75, 0.995], least="lo", rows="n").first()
    (far_low, q1, mid, q3, far_high), n = first["q"], first["n"] or 0
    if n < 20:
        return "none", None, None
    log = first["lo"] >= 0 and q3 > q1 and (q3 + q1 - 2 * mid) / (q3 - q1) > 0.1
    y, middle = (F.log1p("x"), math.log1p(mid)) if log else (F.col("x"), mid)
    mad = quantiles(base, F.abs(y - F.lit(middle)), [0.5]).first()["q"][0]
    if not mad:
        return "none", None, None
    low, high = middle - REACH * mad, middle + REACH * mad
    if log:
        # Beyond what a number can be there is no fence.
        low, high = (math.expm1(min(v, 700.0)) for v in (low, high))
    if n >= 500 and base.agg(F.count_if((F.col("x") < low) | (F.col("x") > high))).first()[0] > 0.02 * n:
        return "quantile", far_low, far_high
    return "log" if log else "linear", low, high


def value_anomalies(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the fence."""
    f = value_fence(df, column).select("low", "high")
    x = F.col(column)
    return df.join(F.broadcast(f)).where((x < F.col("low")) | (x > F.col("high"))).drop("low", "high")


def length_fence(df: DataFrame, column: str) -> DataFrame:
    """Texts over 3 times the 90th percentile of length, from 8 values on."""
    n = F.char_length(F.col(column).cast("string"))
    f = with_quantiles(df.agg(F.count(n).alias("_k")), df, n, [0.9], [], "_p90")
    return df.join(F.broadcast(f)).where((F.col("_k") >= 8) & (n > 3 * F.get("_p90", F.lit(0)))).drop("_p90", "_k")


def group_anomalies(df: DataFrame, column: str, group: str, least: int = 30, limit: float = 3.5) -> DataFrame:
    """Rows far from their own group's median, by robust z; groups of ``least`` or more with a MAD above 0."""
    x = finite(F.col(column))
    known = df.where(x.isNotNull() & F.col(f"`{group}`").isNotNull())
    many = known.groupBy(group).agg(F.count(x).alias("_n")).where(F.col("_n") >= least)
    mid = with_quantiles(many, known, x, [0.5], [group], "_mid").select(group, F.get("_mid", F.lit(0)).alias("_mid"))
    near = df.join(mid, group)
    mad = quantiles(near, F.abs(x - F.col("_mid")), [0.5], [group], "_mad").select(group, F.get("_mad", F.lit(0)).alias("_mad")).where("_mad > 0")
    z = 0.6745 * (x - F.col("_mid")) / F.col("_mad")
    return near.join(mad, group).withColumn("z", z).where(F.abs(F.col("z")) > limit).drop("_mid", "_mad")


# -- duplicates, keys, dependencies ------------------------------------------


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rows with one key (no part null), rows beyond the first, rows in groups."""
    whole = df
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    n = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def near_duplicates(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows equal in all but their id-like columns: groups of two or more."""
    rest = [c for c in df.columns if c not in ids]
    return df.groupBy(*[F.col(f"`{c}`") for c in rest]).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dependency(df: DataFrame, determinant: str, dependent: str, order: str) -> DataFrame:
    """How many rows differ from the first value seen with their determinant."""
    first = df.where(F.col(determinant).isNotNull()).groupBy(determinant).agg(F.min_by(F.col(dependent), F.when(F.col(dependent).isNotNull(), F.col(order))).alias("_first"))
    joined = df.join(first, determinant).where(F.col(dependent).isNotNull())
    wrong = ~F.col(dependent).eqNullSafe(F.col("_first"))
    out = joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("violations"))
    return out.withColumn("holds", F.col("violations") <= 0.02 * F.col("rows"))


def dependencies(df: DataFrame, columns: list[str], order: str, most: float = 0.02) -> DataFrame:
    """Every ordered pair of columns of which the first determines the second in all but ``most`` of the rows.

    determinant, dependent, rows, violations (rows that differ from the first
    value seen with their determinant).  Determinants repeat and dependents vary;
    the pairs that are left are judged in one pass of three aggregates.
    """
    kinds = df.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    # Near-unique determinants say nothing; the sketch's error is far below this bound.
    left = [c for i, c in enumerate(columns) if 1 < kinds[f"k{i}"] <= 0.5 * kinds["rows"]]
    right = [c for i, c in enumerate(columns) if kinds[f"k{i}"] > 1]
    pairs = [(a, b) for a in left for b in right if a != b]
    kind = "determinant string, dependent string, rows bigint, violations bigint"
    if not pairs:
        return df.sparkSession.createDataFrame([], kind)
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for i, (a, b) in enumerate(pairs)])
    rows = df.select(F.col(order).alias("_order"), F.inline(cells)).where("a is not null and b is not null")
    counts = rows.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("_order"))
    groups = counts.groupBy("pair", "a").agg(F.sum("n").alias("n"), F.min_by("n", F.struct("_order", "b")).alias("same"))
    found = groups.groupBy("pair").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("same")).alias("violations"))
    name = lambda k: F.get(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair"))
    return found.where(F.col("violations") <= most * F.col("rows")).select(name(0).alias("determinant"), name(1).alias("dependent"), "rows", "violations")


# -- masks, variants, text ---------------------------------------------------


def mask(c: Column) -> Column:
    """Runs of letters as A, of digits as 9."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"\p{L}+", "A"), r"\p{Nd}+", "9")


def dominant_mask(df: DataFrame, column: str) -> DataFrame:
    """The most frequent mask with its share, and whether it dominates (80 % of 50 or more cells, two runs or more)."""
    m = df.where(F.col(column).isNotNull()).groupBy(mask(F.col(column)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    total = m.agg(F.sum("n").alias("cells"))
    top = m.orderBy(F.col("n").desc(), "mask").limit(1)
    runs = F.size(F.regexp_extract_all("mask", F.lit("(A|9)"), F.lit(1)))
    return top.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("cells")).withColumn("dominant", (F.col("share") >= 0.8) & (F.col("cells") >= 50) & (runs >= 2))


def variants(df: DataFrame, column: str) -> DataFrame:
    """Spellings that fold to one key: key, spellings, rows."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy(T.normalize(F.col("value")).alias("key")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"), F.max_by("value", F.struct("n", "value")).alias("most")).where("spellings > 1")


def similar_clusters(df: DataFrame, column: str, least: float = 0.9) -> DataFrame:
    """Distinct values that look alike, within blocks of one sound, first letter and the same digits (values with other digits are never alike)."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    digits = F.trim(F.regexp_replace("value", r"\D+", " "))
    keyed = v.withColumn("block", F.concat_ws("|", F.left(F.coalesce(F.get(phonetics.codes_udf("value"), F.lit(0)), F.lit("")), F.lit(4)), F.substring(T.normalize(F.col("value")), 1, 1), digits))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "value"], ascending=[False, True])
        # Heads by length: a similarity of 0.75 or more needs lengths within a factor of two.
        heads: dict[int, list[tuple[int, str, str]]] = {}
        rows = []
        for k, (value, n) in enumerate(zip(pdf["value"], pdf["n"], strict=True)):
            own = T.normalize_full(value)
            near = sorted(h for size, hs in heads.items() if least < 0.75 or size <= 2 * len(own) and len(own) <= 2 * size for h in hs)
            home = next((h for _, h, folded in near if T.jaro_winkler(folded, own) >= least), None)
            if home is None:
                heads.setdefault(len(own), []).append((k, value, own))
                home = value
            rows.append((home, value, n))
        return pd.DataFrame(rows, columns=["cluster", "value", "n"])

    out = keyed.groupBy("block").applyInPandas(cluster, "cluster string, value string, n bigint")
    size = Window.partitionBy("cluster")
    return out.withColumn("members", F.count(F.lit(1)).over(size)).where("members > 1")


#: Words that say nothing about a text's subject: an own short list, a parameter of the profile.
STOP_WORDS = "a an and are as at be but by for from has he in is it its of on or that the this to was were will with".split()

#: Shapes of values in the order in which they are tried: own patterns.
SHAPES = {
    "email": r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$",
    "url": r"^(https?://|www\.)\S+$",
    "date": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$",
    "ip": r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$",
    "lat/lon": r"^-?\d{1,2}\.\d+\s*,\s*-?\d{1,3}\.\d+$",
    "card": r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^\+?[\d ()-]{8,16}$",
    "number": r"^[+-]?\d+([.,]\d+)*%?$",
}


def shape_of(c: Column) -> Column:
    """The first shape that a value has."""
    text = F.trim(c.cast("string"))
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for name, pattern in SHAPES.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("text")


def shapes(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(shape_of(F.col(column)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    n = [int(c) for c in digits if c.isdigit()]
    return bool(n) and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(n))) % 10 == 0


def sensitivity(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the share of values of each personal shape, and a level: High from 60 %, Medium from 5 %."""
    out = None
    for c in columns:
        s = shape_of(F.col(c))
        one = df.agg(*[F.avg((s == k).cast("double")).alias(k) for k in ("email", "ip", "lat/lon", "card", "iban", "ssn", "phone")])
        one = one.unpivot([], list(one.columns), "shape", "share").withColumn("column", F.lit(c))
        out = one if out is None else out.unionByName(one)
    level = F.when(F.col("share") >= 0.6, "High").when(F.col("share") >= 0.05, "Medium").otherwise("none")
    return out.withColumn("level", level)


def text_profile(df: DataFrame, column: str, top: int = 50, stop: list[str] | None = None) -> DataFrame:
    """The most frequent words of two letters or more, stop words left out."""
    w = df.select(F.explode(T.tokens(F.col(column))).alias("word")).where((F.char_length("word") >= 2) & ~F.col("word").isin(*(STOP_WORDS if stop is None else stop)))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(top)


def conformance(df: DataFrame, column: str) -> DataFrame:
    """Shares of cells that read as integer, number, date and boolean."""
    s = F.trim(F.col(column).cast("string"))
    is_int = s.rlike(r"^[+-]?\d{1,15}(\.0+)?$")
    return df.where(s.isNotNull() & (s != "")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(is_int.cast("double")).alias("integer"),
        F.avg(s.try_cast("double").isNotNull().cast("double")).alias("number"),
        F.avg(s.try_cast("date").isNotNull().cast("double")).alias("date"),
        F.avg(F.lower(s).isin("true", "false", "yes", "no", "y", "n", "t", "f", "0", "1").cast("double")).alias("boolean"),
    )


# -- relationships -----------------------------------------------------------


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlations over rows where both are known; one pass."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = finite(F.col(a)), finite(F.col(b))
        both = x.isNotNull() & y.isNotNull()
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, x), F.when(both, y)).alias("r"), F.count_if(both).alias("n")).alias(f"p{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return pearson(df, list(combinations(columns, 2)))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Mean ranks of ties: from the counts of distinct values, summed up range by range."""
    from .order import running_sum

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sum(counts, F.col("_c").cast("double"), "_key", "_upto").select("_key", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["_key"], "left").drop("_key")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b")).where("a is not null and b is not null")
    ranked = average_rank(average_rank(both, "a", "ra"), "b", "rb")
    return ranked.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # Empty cells add their expectation: the sum over cells of o*o/(r*c) - 1 counts them too.
    one = cells.join(rows, a).join(cols, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return one.crossJoin(total).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sqrt(F.try_divide(F.col("s") - 1, F.least("ka", "kb") - 1)).alias("v"), "n")


def eta_squared(df: DataFrame, group: str, column: str) -> DataFrame:
    x = finite(F.col(column))
    base = df.where(F.col(group).isNotNull() & x.isNotNull())
    by = base.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"))
    whole = base.agg(F.avg(x).alias("mm"), F.var_pop(x).alias("v"), F.count(x).alias("nn"))
    return by.join(F.broadcast(whole)).groupBy().agg((F.sum(F.col("n") * (F.col("m") - F.col("mm")) ** 2) / F.first(F.col("v") * F.col("nn"))).alias("eta2"), F.first("nn").alias("n"))


def co_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often two columns are null together."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"{a}|{b}") for a, b in pairs])
    out = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n")
    return out.select(F.split("pair", "\\|")[0].alias("a"), F.split("pair", "\\|")[1].alias("b"), "n")


def missing_map(df: DataFrame, columns: list[str], order: str, rows: int = 100) -> DataFrame:
    """Null counts of blocks of ``rows`` rows in row order (the order column counts rows)."""
    return df.groupBy(F.floor(F.col(order) / rows).alias("block")).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def pair_check(df: DataFrame, a: str, b: str, op: str, tolerance: float = 0.0) -> DataFrame:
    """Row by row gte gt eq approx: passed, failed and not judged."""
    x, y = F.col(a), F.col(b)
    ok = {"gte": x >= y, "gt": x > y, "eq": x == y, "approx": F.abs(x - y) <= tolerance}[op]
    return df.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if(ok.isNull()).alias("not_judged"))


# -- rules and score ---------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """notNull unique range inList regex length compare, with an allowed share of failures."""

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""
    other: str = ""
    op: str = "gte"
    allowed: float = 0.0

    def failed(self) -> Column:
        """Whether a row fails; a null fails only notNull."""
        c = F.col(self.column)
        if self.kind == "notNull":
            return c.isNull()
        if self.kind == "range":
            bad = F.lit(False)
            if self.low is not None:
                bad = bad | (c < self.low)
            if self.high is not None:
                bad = bad | (c > self.high)
        elif self.kind == "inList":
            bad = ~c.cast("string").isin(*self.values)
        elif self.kind == "regex":
            bad = ~c.cast("string").rlike(self.pattern)
        elif self.kind == "length":
            n = F.char_length(c.cast("string"))
            bad = (n < (self.low or 0)) | (n > (self.high if self.high is not None else 1 << 30))
        elif self.kind == "compare":
            o = F.col(self.other)
            bad = ~{"gte": c >= o, "gt": c > o, "lte": c <= o, "lt": c < o, "eq": c == o, "ne": c != o}[self.op]
        else:
            raise ValueError(f"unknown rule {self.kind!r}")
        return F.coalesce(bad, F.lit(False))


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each rule: failures, rows, passed.  All but unique share one pass."""
    rows = None
    plain = [(i, r) for i, r in enumerate(rules) if r.kind != "unique"]
    if plain:
        one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(r.failed()).alias(f"r{i}") for i, r in plain])
        rows = one.unpivot(["rows"], [f"r{i}" for i, _ in plain], "rule", "failures")
    for i, r in enumerate(rules):
        if r.kind == "unique":
            n = df.where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("n"))
            u = n.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("failures"))
            u = df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(u).select("rows", F.lit(f"r{i}").alias("rule"), "failures")
            rows = u if rows is None else rows.unionByName(u)
    allowed = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"r{i}"), F.lit(float(r.allowed)))])
    return rows.withColumn("passed", F.col("failures") <= allowed[F.col("rule")] * F.col("rows"))


def exceptions(df: DataFrame, rules: list[Rule], order: str) -> DataFrame:
    """The failing cells: row, rule, column, value."""
    cells = F.array(*[F.struct(F.lit(f"r{i}").alias("rule"), F.lit(r.column).alias("column"), F.col(r.column).cast("string").alias("value"), r.failed().alias("hit")) for i, r in enumerate(rules) if r.kind != "unique"])
    return df.select(F.col(order).alias("row"), F.explode(F.filter(cells, lambda c: c["hit"])).alias("c")).select("row", "c.rule", "c.column", "c.value")


def rows_affected(df: DataFrame, rules: list[Rule]) -> DataFrame:
    hit = F.lit(False)
    for r in rules:
        if r.kind != "unique":
            hit = hit | r.failed()
    return df.agg(F.count_if(hit).alias("affected"), F.count(F.lit(1)).alias("rows"))


#: Weights of the score's dimensions and its bands; fixed values.
WEIGHTS = {"completeness": 30, "validity": 30, "uniqueness": 15, "consistency": 15, "accuracy": 10}
BANDS = ((90, "good"), (75, "fair"))


def score(df: DataFrame, rules: list[Rule], columns: list[str] | None = None) -> DataFrame:
    """Weighted mean of pass / (pass + fail) by dimension; a dimension without a check is left out."""
    columns = columns or df.columns
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"))
    cells = F.col("rows") * len(columns)
    copies = dataset_stats(df, columns).select("duplicates")
    checks = check_rules(df, rules).agg(F.sum("failures").alias("failures"), F.sum("rows").alias("checked")) if rules else None
    out = one.crossJoin(copies)
    out = out.crossJoin(checks) if checks is not None else out.withColumn("failures", F.lit(None)).withColumn("checked", F.lit(None))
    parts = {"completeness": 1 - F.col("nulls") / cells, "uniqueness": 1 - F.col("duplicates") / F.col("rows")}
    if rules:
        parts["validity"] = 1 - F.col("failures") / F.col("checked")
    weight = sum(WEIGHTS[p] for p in parts)
    total = sum((parts[p] * WEIGHTS[p] for p in parts), F.lit(0.0)) / weight * 100
    band = F.when(total >= BANDS[0][0], BANDS[0][1]).when(total >= BANDS[1][0], BANDS[1][1]).otherwise("poor")
    return out.select(total.alias("score"), band.alias("band"), *[(parts[p] * 100).alias(p) for p in parts])


def drift_halves(df: DataFrame, column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first and second half of the rows in row order, split at the order column's median."""
    mid = quantiles(df, F.col(order), [0.5], name="_mid").select(F.get("_mid", F.lit(0)).alias("_mid"))
    both = df.join(F.broadcast(mid))
    return both.where(F.col(order) <= F.col("_mid")).drop("_mid"), both.where(F.col(order) > F.col("_mid")).drop("_mid")


# -- check digits and kinds ----------------------------------------------------


def iban_ok(text: str) -> bool:
    """The mod-97 check of account numbers."""
    s = "".join(text.split()).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def weighted_ok(text: str, weights: tuple[int, ...], modulus: int, first_less: int = 0) -> bool:
    """Check sums of weighted digits (business and tax file numbers)."""
    d = [int(c) for c in text if c.isdigit()]
    if len(d) != len(weights):
        return False
    d[0] -= first_less
    return sum(a * b for a, b in zip(d, weights, strict=True)) % modulus == 0


#: Weights of the Australian business and tax file numbers; fixed values.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)

CHECKS = {
    "card": lambda s: 12 <= sum(c.isdigit() for c in s) <= 19 and luhn(s),
    "iban": iban_ok,
    "abn": lambda s: weighted_ok(s, ABN_WEIGHTS, 89, 1),
    "tfn": lambda s: weighted_ok(s, TFN_WEIGHTS, 11),
}


def checked_numbers(df: DataFrame, column: str) -> DataFrame:
    """How many distinct values pass each check-digit rule."""
    from pyspark.sql.types import BooleanType

    v = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    out = v.agg(*[F.count_if(F.pandas_udf(lambda s, f=f: s.map(f), BooleanType())(F.col("v"))).alias(k) for k, f in CHECKS.items()])
    return out.unpivot([], list(CHECKS), "kind", "n")


def identifier_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that name rows: integers or texts that are 98 % distinct over more than 20 rows."""
    stats = column_stats(df, columns)
    return stats.withColumn("identifier", (F.col("rows") > 20) & (F.col("distinct") >= 0.98 * (F.col("rows") - F.col("nulls")))).select("column", "identifier")


#: What words in a column's name say about it; an own list.
NAME_HINTS = {
    "email": "email", "mail": "email", "phone": "phone", "mobile": "phone", "address": "address", "postcode": "postcode", "zip": "postcode", "lat": "latitude", "latitude": "latitude",
    "lon": "longitude", "lng": "longitude", "longitude": "longitude", "date": "date", "time": "time", "amount": "money", "price": "money", "cost": "money", "total": "money",
    "name": "name", "first": "name", "last": "name", "country": "country", "city": "city", "state": "state", "url": "url", "id": "identifier", "key": "identifier", "code": "code",
}


def name_hint(column: str) -> str | None:
    """A kind from a column's name."""
    words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", column).lower())
    return next((NAME_HINTS[w] for w in words if w in NAME_HINTS), None)
