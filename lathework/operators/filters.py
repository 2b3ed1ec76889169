"""Row filters, search, facets and histograms.

All filters of a query AND together; one that cannot judge a row drops it,
except exclusions, which keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetics
from ..functions import text as T
from .aggregate import finite
from .quantiles import quantiles


def contains(column: str, query: str) -> Column:
    """Normalised text contains the normalised query; a blank query matches all."""
    q = T.normalize_full(query)
    return F.lit(True) if not q else F.contains(T.normalize(F.col(column)), F.lit(q))


def exact(column: str, query: str) -> Column:
    q = T.normalize_full(query)
    return F.lit(True) if not q else T.normalize(F.col(column)) == F.lit(q)


def in_range(column: str, low=None, high=None) -> Column:
    x = F.col(column)
    out = x.isNotNull()
    if low is not None:
        out = out & (x >= F.lit(low))
    if high is not None:
        out = out & (x <= F.lit(high))
    return out


def compare(column: str, op: str, value) -> Column:
    """eq ne gt gte lt lte; a missing number never matches."""
    x, v = F.col(column), F.lit(value)
    return {"eq": x == v, "ne": x != v, "gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]


def outside(column: str, low, high) -> Column:
    return (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))


def blank(column: str, negate: bool = False) -> Column:
    return F.col(column).isNotNull() if negate else F.col(column).isNull()


def values(column: str, wanted: list[str], negate: bool = False) -> Column:
    """Trimmed labels, null as ``(empty)``."""
    label = F.coalesce(F.trim(F.col(column).cast("string")), F.lit("(empty)"))
    return ~label.isin(*wanted) if negate else label.isin(*wanted)


def text_test(column: str, op: str, value: str) -> Column:
    """eq ne contains notContains begins ends, trimmed and without case."""
    c, v = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))), value.strip().lower()
    return {"eq": c == v, "ne": c != v, "contains": c.contains(v), "notContains": ~c.contains(v), "begins": c.startswith(v), "ends": c.endswith(v)}[op]


def date_test(column: str, op: str, a: str, b: str | None = None) -> Column:
    """on before after onOrBefore onOrAfter between, by day."""
    d, x = F.col(column).cast("date"), F.lit(a).cast("date")
    return {"on": d == x, "before": d < x, "after": d > x, "onOrBefore": d <= x, "onOrAfter": d >= x, "between": d.between(x, F.lit(b or a).cast("date"))}[op]


def exclude(condition: Column, invert: bool = False) -> Column:
    """Rows that a chart keeps: not matching; rows that cannot be judged stay."""
    return F.coalesce(condition if invert else ~condition, F.lit(True))


def apply(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def versus_average(df: DataFrame, column: str, above: bool = True, base: DataFrame | None = None) -> DataFrame:
    """Rows strictly above (below) the mean over all rows of ``base``."""
    mean = (base if base is not None else df).agg(F.avg(finite(F.col(column))).alias("_mean"))
    out = df.join(F.broadcast(mean))
    return out.where(F.col(column) > F.col("_mean") if above else F.col(column) < F.col("_mean")).drop("_mean")


def in_duplicate_group(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of which the table holds another copy (in ``columns``).

    Copies are counted where they lie, and rows are kept by a semi-join with the
    repeated keys, which Spark splits when a key is hot: no list of copies is made.
    """
    columns = columns or df.columns
    many = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    keys = many.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)])
    same = [df[f"`{c}`"].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(columns)]
    return df.join(keys, same, "left_semi")


def any_null(df: DataFrame) -> DataFrame:
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | F.col(f"`{c}`").isNull()
    return df.where(cond)


# -- search ------------------------------------------------------------------

#: Least Jaro-Winkler similarity; fixed values.
LEVELS = {"strict": 0.94, "normal": 0.88, "loose": 0.80}


def _grams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))


def fuzzy(df: DataFrame, column: str, query: str, level: str = "normal") -> DataFrame:
    """Rows where each word of the query matches some word of the cell.

    Distinct words are matched, not cells: candidates share enough letter pairs
    and a similar length, then Jaro-Winkler decides; short query words match by
    containment.  Rows are kept by a semi-join on their distinct values.
    """
    words = T.query_words(query)
    if not words:
        return df
    cells = df.select(F.col(column).cast("string").alias("_v")).distinct()
    pairs = cells.select("_v", F.explode(T.tokens(F.col("_v"))).alias("_w")).distinct()
    distinct = pairs.select("_w").distinct()
    kept = cells
    for q in words:
        w = F.col("_w")
        if len(q) < 3:
            hit = distinct.where(w.startswith(q) | w.contains(q))
        else:
            grams = [q[i : i + 2] for i in range(len(q) - 1)]
            shared = F.size(F.array_intersect(F.array(*[F.lit(g) for g in dict.fromkeys(grams)]), _grams(w)))
            near = (F.abs(F.char_length(w) - len(q)) <= 2) & (shared >= max(1, len(set(grams)) - 4))
            hit = distinct.where(w.startswith(q) | near).where(w.startswith(q) | (T.jaro_winkler_udf(w, F.lit(q)) >= LEVELS[level]))
        kept = kept.join(pairs.join(hit, "_w", "left_semi").select("_v"), "_v", "left_semi")
    return df.join(kept, df[column].cast("string") == kept["_v"], "left_semi")


def phonetic(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows where each word of the query has a Double Metaphone code of some word of the cell; either code may match."""
    words = T.query_words(query)
    if not words:
        return df
    cells = df.select(F.col(column).cast("string").alias("_v")).distinct()
    pairs = cells.select("_v", F.explode(T.tokens(F.col("_v"))).alias("_w")).distinct()
    codes = pairs.select("_w").distinct().withColumn("_codes", phonetics.codes_udf("_w"))
    kept = cells
    for q in words:
        own = F.array(*[F.lit(c) for c in dict.fromkeys(phonetics.double_metaphone(q)) if c]).cast("array<string>")
        kept = kept.join(pairs.join(codes.where(F.arrays_overlap("_codes", own)), "_w", "left_semi").select("_v"), "_v", "left_semi")
    return df.join(kept, df[column].cast("string") == kept["_v"], "left_semi")


def suggestions(df: DataFrame, column: str, query: str, limit: int = 10) -> DataFrame:
    """Distinct values for type-ahead: beginnings first, then containment, then similarity."""
    q = T.normalize_full(query)
    values_ = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    n = T.normalize(F.col("value"))
    score = F.when(n == q, 4.0).when(n.startswith(q), 3.0).when(n.contains(q), 2.0)
    sure = values_.withColumn("score", score).where("score is not null")
    # Python sees only values that share a letter pair with the query.
    shared = F.arrays_overlap(_grams(n), F.array(*[F.lit(q[i : i + 2]) for i in range(max(1, len(q) - 1))]))
    alike = values_.where(score.isNull() & shared).withColumn("score", T.jaro_winkler_udf(n, F.lit(q))).where(F.col("score") >= LEVELS["loose"])
    return sure.unionByName(alike).orderBy(F.col("score").desc(), F.col("n").desc(), "value").limit(limit)


# -- facets and histograms ---------------------------------------------------


def facets(df: DataFrame, filters: dict[str, Column], columns: list[str]) -> DataFrame:
    """Counts of each label under the filters of all other columns, in one scan.

    A row is expanded only to the facets whose other filters it passes, and all
    are counted in one aggregate.  A null condition does not pass; missing and
    blank cells are ``(empty)``; without rows there is no label.
    """
    held = df.withColumns({f"_f{k}": F.coalesce(f, F.lit(False)) for k, f in enumerate(filters.values())})
    entries = []
    for c in columns:
        passed = F.lit(True)
        for k, name in enumerate(filters):
            if name != c:
                passed = passed & F.col(f"_f{k}")
        label = F.coalesce(F.trim(F.col(c).cast("string")), F.lit("(empty)"))
        entries.append(F.when(passed, F.struct(F.lit(c).alias("facet"), label.alias("label"))))
    each = held.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e"))
    return each.groupBy(F.col("e.facet").alias("facet"), F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


#: A span of so many interquartile ranges is a heavy tail; a chart of fewer numbers than ``LEAST_NUMBERS`` is not scaled; fixed values.
HEAVY_TAIL, LEAST_NUMBERS = 200, 100


def symlog(x: Column) -> Column:
    """Logarithm of 1 + the size, with the number's sign."""
    return F.signum(x) * F.log1p(F.abs(x))


def histogram(df: DataFrame, column: str, bins: int = 64, base: DataFrame | None = None, clip: bool = True, scale: str = "linear") -> DataFrame:
    """Counts in equal bins over the base table's range (p1 to p99 when clipped); values beyond go to the outer bins.

    ``scale="auto"``: when the base table's span is over ``HEAVY_TAIL`` times its
    interquartile range the bins are equal in ``symlog`` and cover the whole
    range, else they are clipped.  Both come from one row of quantiles.  A table
    without numbers has no bin; equal numbers all fall into bin 0.
    """
    x = finite(F.col(column))
    whole = base if base is not None else df
    if scale == "auto":
        q = quantiles(whole, x, [0.0, 0.01, 0.25, 0.75, 0.99, 1.0], name="_q", rows="_n")
        at = [F.get("_q", F.lit(i)) for i in range(6)]
        heavy = (at[3] > at[2]) & (at[5] - at[0] > HEAVY_TAIL * (at[3] - at[2])) & (F.col("_n") >= LEAST_NUMBERS)
        clipped = (at[4] > at[1]) & (F.col("_n") >= LEAST_NUMBERS)
        ends = q.select(heavy.alias("_s"), F.when(heavy, symlog(at[0])).when(clipped, at[1]).otherwise(at[0]).alias("_lo"), F.when(heavy, symlog(at[5])).when(clipped, at[4]).otherwise(at[5]).alias("_hi"))
    elif clip:
        ends = quantiles(whole, x, [0.01, 0.99], name="_q").select(F.lit(False).alias("_s"), F.get("_q", F.lit(0)).alias("_lo"), F.get("_q", F.lit(1)).alias("_hi"))
    else:
        ends = whole.agg(F.lit(False).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_s"), symlog(x)).otherwise(x) if scale == "auto" else x
    at = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((place - F.col("_lo")) / width)))).otherwise(F.lit(0))
    return df.join(F.broadcast(ends)).where(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- order and pages ---------------------------------------------------------


def ordered(df: DataFrame, column: str, order: str, descending: bool = False) -> DataFrame:
    """Missing values last ascending, first descending; ties in row order, reversed when descending."""
    c, o = F.col(column), F.col(order)
    return df.orderBy(c.desc_nulls_first(), o.desc()) if descending else df.orderBy(c.asc_nulls_last(), o.asc())


def page(df: DataFrame, column: str, order: str, start: int, stop: int, descending: bool = False) -> DataFrame:
    """Rows start..stop-1 of an order: a bounded top-k, not a numbering of the table."""
    return ordered(df, column, order, descending).limit(stop).offset(start)


def shuffled(df: DataFrame, order: str, seed: int = 7) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(order)), order)


def copies_together(df: DataFrame, order: str) -> DataFrame:
    """Copies of a row next to each other, groups by their hash, copies in row order."""
    rest = [c for c in df.columns if c != order]
    return df.orderBy(F.xxhash64(*rest), order)


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """By sound; when nothing sounds alike, by spelling."""
    found = phonetic(df, column, query)
    return fuzzy(df, column, query) if found.isEmpty() else found
