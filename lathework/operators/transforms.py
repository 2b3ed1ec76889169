"""Ordered table transforms: each takes and gives a DataFrame.

Row order is semantic: operations that depend on it take the name of an order
column (``_row_id`` of a loaded table, or a natural key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleans
from .aggregate import finite
from .order import carry
from .quantiles import quantiles, with_quantiles


def unique_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name (2)`` and so on when it is taken in any case."""
    taken = {c.lower() for c in df.columns}
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name} ({n})", n + 1
    return out


def drop(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def round_column(df: DataFrame, column: str, decimals: int) -> DataFrame:
    """Half away from zero for decimals, half up for tens; decimals are clamped to 12 either way."""
    d = max(-12, min(12, decimals))
    x = F.col(column)
    out = F.round(x, d) if d >= 0 else F.floor(x / 10**-d + 0.5) * float(10**-d)
    return df.withColumn(column, out)


def clip(df: DataFrame, column: str, low: float | None = None, high: float | None = None, mode: str = "limit") -> DataFrame:
    """Values beyond the limits become the limit, or null with ``blank``."""
    x = F.col(column)
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(float(low)) if mode == "limit" else F.lit(None)).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(float(high)) if mode == "limit" else F.lit(None)).otherwise(out)
    return df.withColumn(column, out)


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row: the values at rank round((n-1) q) of the sorted column, as q0, q1, ...

    The k-th of n sorted values is the exact percentile at k / (n - 1).
    """
    x = finite(F.col(column))
    values = df.select(x.alias("v")).where("v is not null")
    n = values.count()
    # At a whole rank the interpolated quantile is the value itself.
    ranks = [int((n - 1) * q + 0.5) / (n - 1) if n > 1 else 0.0 for q in shares]
    found = quantiles(values, F.col("v"), ranks, name="_q")
    return found.select(*[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(shares))])


def winsorize(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Values beyond the nearest-rank fences become the fences; fewer than 20 numbers are left alone."""
    p = max(0.1, min(25.0, percent)) / 100
    fences = nearest_rank(df, column, [p, 1 - p])
    n = F.count(finite(F.col(column)))
    fences = fences.crossJoin(F.broadcast(df.agg(n.alias("_n"))))
    x = F.col(column)
    return (
        df.join(F.broadcast(fences))
        .withColumn(column, F.when((F.col("_n") >= 20) & x.isNotNull(), F.least(F.greatest(x, F.col("q0")), F.col("q1"))).otherwise(x))
        .drop("q0", "q1", "_n")
    )


def dedupe(df: DataFrame, keep: str = "first", order: str = "_row_id", columns: list[str] | None = None) -> DataFrame:
    """Whole-row duplicates: the first or last copy stays, or none of them."""
    columns = columns or [c for c in df.columns if c != order]
    rest = [c for c in df.columns if c not in columns]
    # One row of each group is kept by an aggregate, so copies come together where they lie
    # and no group of them has to fit in one task.  A null order value is the first.
    ahead = [order] if order in rest else []
    row = F.struct(*[F.col(f"`{c}`") for c in (*ahead, *(c for c in rest if c != order))]) if rest else F.lit(0)
    kept = {"first": F.min, "last": F.max, "none": F.any_value}[keep](row)
    out = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(kept.alias("_kept"), F.count(F.lit(1)).alias("_n"))
    if keep == "none":
        out = out.where("_n = 1")
    return out.select(*[F.col("_kept")[c].alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def impute(df: DataFrame, column: str, method: str, value=None, by: list[str] | None = None, order: str = "_row_id") -> DataFrame:
    """Fill nulls: constant mean median mode, by group with the whole table behind it; forward and backward in row order."""
    c = F.col(column)
    if method == "constant":
        return df.withColumn(column, F.coalesce(c, F.lit(value)))
    if method in ("forward", "backward"):
        return carry(df, column, order, method == "forward")
    how = {"mean": lambda: F.round(F.avg(finite(c)), 6), "median": None, "mode": lambda: F.mode(c, True)}[method]

    def found(keys: list[str], name: str) -> DataFrame:
        if method != "median":
            return df.groupBy(*keys).agg(how().alias(name))
        middle = quantiles(df, finite(c), [0.5], keys, name)
        return middle.select(*[F.col(f"`{k}`") for k in keys], F.round(F.get(name, F.lit(0)), 6).alias(name))

    out = df.join(F.broadcast(found([], "_all")))
    fill = F.col("_all")
    if by:
        groups = found(by, "_own")
        groups = groups.select(*[F.col(b).alias(f"_{b}") for b in by], "_own")
        cond = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        out = out.join(groups, cond, "left").drop(*[f"_{b}" for b in by])
        fill = F.coalesce("_own", "_all")
    return out.withColumn(column, F.coalesce(c, fill)).drop("_all", "_own")


def combine_date(df: DataFrame, roles: dict[str, str], name: str = "date") -> DataFrame:
    """Parts to one date or date-time; the day defaults to 1, an impossible date is null."""
    part = lambda r, d: F.coalesce(F.expr(f"try_cast(`{roles[r]}` as int)"), F.lit(d)) if r in roles else F.lit(d)
    year = F.expr(f"try_cast(`{roles['year']}` as int)")
    month, day = part("month", 1), part("day", 1)
    if not {"hour", "minute", "second"} & set(roles):
        out = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    else:
        out = F.try_make_timestamp(year, month, day, part("hour", 0), part("minute", 0), part("second", 0)).cast("timestamp_ntz")
    return df.withColumn(unique_name(df, name), out)


def derive(df: DataFrame, name: str, value: Column, at: int | None = None) -> DataFrame:
    """A new column at a position, under a free name."""
    name = unique_name(df, name)
    cols = [F.col(f"`{c}`") for c in df.columns]
    at = len(cols) if at is None else at
    return df.select(*cols[:at], value.alias(name), *cols[at:])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def group_simple(df: DataFrame, dim: str, agg: str, column: str | None = None) -> DataFrame:
    """One dimension, one measure; the key is the raw text."""
    x = finite(F.col(column)) if column else None
    how = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "median": None}[agg]
    title = f"{agg.title()}({column})" if column else "Count"
    if agg == "median":
        one = df.groupBy(dim).agg(F.count(F.lit(1)).alias("_n"))
        return with_quantiles(one, df, x, [0.5], [dim], title).select(dim, F.get(F.col(f"`{title}`"), F.lit(0)).alias(title))
    return df.groupBy(dim).agg(how().alias(title))


def append(parts: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Tables one after the other, aligned by folded header, with their source in ``_input_filename``."""
    out = None
    first: dict[str, str] = {}
    for i, p in enumerate(parts):
        mapping = {}
        for c in p.columns:
            k = "".join(ch for ch in c.lower() if ch.isalnum())
            first.setdefault(k, c)
            mapping[c] = first[k]
        p = p.withColumnsRenamed(mapping)
        if names:
            p = p.withColumn("_input_filename", F.lit(names[i]))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def flag(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """A Yes/No column."""
    return df.withColumn(unique_name(df, name), F.when(F.coalesce(condition, F.lit(False)), "Yes").otherwise("No"))


def flag_anomalies(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A Yes/No column from the fence of a number (or of a text's length)."""
    from . import profile

    if profile.is_number(df, column):
        fence = profile.value_fence(df, column).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
        bad = (F.col(column) < F.col("_low")) | (F.col(column) > F.col("_high"))
    else:
        n = F.char_length(F.col(column).cast("string"))
        fence = with_quantiles(df.agg(F.count(n).alias("_high")), df, n, [0.9], [], "_low")
        bad = (F.col("_high") >= 8) & (n > 3 * F.get("_low", F.lit(0)))
    return flag(df.join(F.broadcast(fence)), name or f"{column} anomaly", bad).drop("_low", "_high")


# -- casts that tell what failed ----------------------------------------------


_CAST = ("_empty", "_value", "_failed")


def _cast_cells(df: DataFrame, column: str, target: str, comma: bool = False, order: str = "dmy") -> DataFrame:
    """``df`` with ``_empty`` (a null or a null token), ``_value`` (canonical text, null if none) and ``_failed``, each computed once."""
    c = F.col(f"`{column}`")
    out = df.withColumn("_empty", cleans.is_missing(c))
    out = out.withColumn("_value", F.when(~F.col("_empty"), cleans.canonical(c, target, comma, order)))
    return out.withColumn("_failed", ~F.col("_empty") & F.col("_value").isNull())


def cast_column(df: DataFrame, column: str, target: str, on_fail: str = "coerce", **how) -> DataFrame:
    """``df`` with ``column`` cast and ``<column>_failed`` beside it.

    ``coerce`` blanks what fails (null), ``keep`` leaves its text, ``reject``
    leaves the whole column when any cell fails: one row of counts is broadcast.
    Missing cells keep their text and never fail; a column of the flag's name is
    replaced; an empty table stays empty.
    """
    raw, failed = F.col(f"`{column}`").cast("string"), F.col("_failed")
    out = _cast_cells(df, column, target, **how)
    value = F.when(F.col("_empty"), raw).when(~failed, F.col("_value"))
    if on_fail != "coerce":
        value = value.otherwise(raw)
    if on_fail == "reject":
        out = out.join(F.broadcast(out.agg(F.count_if(failed).alias("_fails"))))
        value = F.when(F.col("_fails") > 0, raw).otherwise(value)
    return out.withColumns({column: value, f"{column}_failed": failed}).drop(*_CAST, "_fails")


def cast_failures(df: DataFrame, column: str, target: str, **how) -> DataFrame:
    """The rows whose cell does not parse under the cast."""
    return _cast_cells(df, column, target, **how).where("_failed").drop(*_CAST)


def cast_report(df: DataFrame, column: str, target: str, on_fail: str = "coerce", **how) -> DataFrame:
    """One row: ``non_empty``, ``failed``, ``changed``, ``digits_lost``, ``applied`` and ``examples`` (five failing texts, the most frequent first).

    Equal texts are counted first, so each is cast once.
    """
    empty, failed = F.col("_empty"), F.col("_failed")
    texts = _cast_cells(df.groupBy(F.col(f"`{column}`").cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "_v", target, **how)
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).alias(name)
    changed = ~empty & ~failed & (F.col("_value") != F.col("_v")) | (failed if on_fail == "coerce" else F.lit(False))
    lost = ~empty & cleans.loses_digits(F.col("_v")) if target in ("integer", "number") else F.lit(False)
    counts = texts.agg(total(~empty, "non_empty"), total(failed, "failed"), total(changed, "changed"), total(lost, "digits_lost"))
    some = texts.where(failed).orderBy(F.desc("_n"), "_v").limit(5).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))).alias("_e"))
    applied = (F.col("failed") == 0) if on_fail == "reject" else F.lit(True)
    out = counts.join(F.broadcast(some)).withColumn("applied", applied).withColumn("examples", F.col("_e.v")).drop("_e")
    return out.withColumn("changed", F.when(F.col("applied"), F.col("changed")).otherwise(F.lit(0)))
