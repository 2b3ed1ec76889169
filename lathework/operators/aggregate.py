"""Grouped views: dimensions, measures, gap fill, partial periods, sort, top-N, post operations.

A view is declared and compiled to one grouped aggregation; Catalyst plans it.
Missing numbers are nulls throughout; a group without a finite value has sum 0
and null elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import buckets
from .quantiles import quantiles

MISSING = "(missing)"


# -- dimensions --------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """The raw value; null is ``(missing)``."""

    column: str

    def key(self, df: DataFrame) -> Column:
        return F.coalesce(F.col(self.column).cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class Time:
    column: str
    grain: str
    every: int = 1
    week_start: int = 1
    fiscal_start: int = 1
    zone: str | None = None

    def key(self, df: DataFrame) -> Column:
        return buckets.bucket(F.col(self.column), self.grain, self.every, self.week_start, self.fiscal_start, self.zone)


@dataclass(frozen=True)
class DatePart:
    column: str
    part: str

    def key(self, df: DataFrame) -> Column:
        return F.coalesce(buckets.date_part(F.col(self.column), self.part)[0], F.lit(MISSING))


@dataclass(frozen=True)
class BinEdges:
    """Bins between explicit edges, left-closed; values outside go to the outer bins."""

    column: str
    edges: tuple[float, ...]

    def key(self, df: DataFrame) -> Column:
        x = F.col(self.column).cast("double")
        out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int"))
        for i, edge in enumerate(self.edges[1:-1]):
            out = out.when(x < edge, F.lit(i))
        return out.otherwise(F.lit(max(0, len(self.edges) - 2)))


@dataclass(frozen=True)
class BinWidth:
    """Bins of one width from floor(min / width) * width on, 1024 at most."""

    column: str
    width: float

    def key(self, df: DataFrame) -> Column:
        low = F.floor(F.col("_low") / self.width)
        return F.least(F.floor(F.col(self.column) / self.width) - low, F.lit(1023)).cast("int")


@dataclass(frozen=True)
class BinQuantile:
    """Bins between interpolated quantiles, left-closed, the last one closed."""

    column: str
    n: int

    def key(self, df: DataFrame) -> Column:
        q = F.col("_edges")
        x = F.col(self.column).cast("double")
        inner = F.slice(q, 2, max(1, self.n - 1)) if self.n > 1 else F.array().cast("array<double>")
        return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(inner, lambda e: e <= x))).cast("int")


@dataclass(frozen=True)
class Cohort:
    """The first period of the entity."""

    entity: str
    column: str
    grain: str

    def key(self, df: DataFrame) -> Column:
        return F.min(buckets.bucket(F.col(self.column), self.grain)).over(Window.partitionBy(F.trim(F.col(self.entity).cast("string"))))


@dataclass(frozen=True)
class Since:
    """Periods since the entity's first one: P0, P1, ..."""

    entity: str
    column: str
    grain: str

    def key(self, df: DataFrame) -> Column:
        n = buckets.period_number(F.col(self.column), self.grain)
        first = F.min(n).over(Window.partitionBy(F.trim(F.col(self.entity).cast("string"))))
        return F.concat(F.lit("P"), (n - first).cast("string"))


# -- measures ----------------------------------------------------------------


@dataclass(frozen=True)
class Where:
    """A measure's condition: trimmed values, a closed range, or blankness."""

    column: str
    values: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None
    blank: bool | None = None

    def predicate(self) -> Column:
        c = F.col(self.column)
        if self.values is not None:
            return F.coalesce(F.trim(c.cast("string")).isin(*self.values), F.lit(False))
        if self.blank is not None:
            return c.isNull() if self.blank else c.isNotNull()
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c >= self.low)
        if self.high is not None:
            out = out & (c <= self.high)
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Measure:
    """``agg`` of ``column``: count distinct sum min max mean stddev variance median pN first last mode wmean wsum expr."""

    agg: str
    column: str | None = None
    name: str | None = None
    weight: str | None = None
    where: Where | None = None
    expr: str | None = None
    order: str | None = None

    @property
    def title(self) -> str:
        return self.name or (f"{self.agg}({self.column})" if self.column else self.agg)


def finite(c: Column) -> Column:
    """The number, or null when it is missing or not finite."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def measure(m: Measure) -> Column:
    """The aggregate expression of a measure."""
    if m.agg == "expr":
        return compile_expression(m.expr, m.where, m.order)
    cond = m.where.predicate() if m.where else None
    pick = (lambda c: F.when(cond, c)) if cond is not None else (lambda c: c)
    if m.agg == "count" and m.column is None:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    c = pick(F.col(m.column))
    x = finite(c)
    if m.agg == "count":
        return F.count(c)
    if m.agg == "distinct":
        return F.countDistinct(c)
    if m.agg == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if m.agg in ("min", "max", "median"):
        return getattr(F, m.agg)(x)
    if m.agg == "mean":
        return F.avg(x)
    if m.agg in ("stddev", "std"):
        return F.stddev_samp(x)
    if m.agg in ("variance", "var"):
        return F.var_samp(x)
    if m.agg in ("first", "last"):
        pair = F.when(x.isNotNull(), F.col(m.order))
        return (F.min_by if m.agg == "first" else F.max_by)(x, pair)
    if m.agg == "mode":
        # The most frequent text; of equally frequent ones the smallest.  Spark's mode with deterministic order.
        return F.mode(c.cast("string"), True)
    if m.agg == "wmean":
        w = pick(F.col(m.weight)).cast("double")
        both = x.isNotNull() & (w > 0)
        return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))
    if m.agg == "wsum":
        return F.coalesce(F.sum(x * finite(pick(F.col(m.weight)))), F.lit(0.0))
    q = re.fullmatch(r"p(\d+(?:\.\d+)?)", m.agg)
    if q and 0 <= float(q[1]) <= 100:
        return F.percentile(x, float(q[1]) / 100)
    raise ValueError(f"unknown aggregate {m.agg!r}")


_TERM = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*(?:\.\d+)?)\s*\(\s*(?:\[([^\]]*)\]|([\w ]*?|\*))\s*\)|([-+*/()]))")


def compile_expression(text: str, where: Where | None = None, order: str | None = None) -> Column:
    """``sum(a) / count(*)``: arithmetic over at most 8 aggregate terms; a result that is not finite is null."""
    if len(text) > 240:
        raise ValueError("expression is longer than 240 characters")
    parts, at = [], 0
    while text[at:].strip():
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        parts.append(m)
        at = m.end()
    if sum(1 for m in parts if m[2]) > 8:
        raise ValueError("more than 8 aggregate terms")
    parts.reverse()

    def factor() -> Column:
        if not parts:
            raise ValueError("expression ends early")
        m = parts.pop()
        if m[5] == "(":
            out = total()
            if not parts or parts.pop()[5] != ")":
                raise ValueError("missing )")
            return out
        if m[5] == "-":
            return -factor()
        if m[5] == "+":
            return factor()
        if m[1]:
            return F.lit(float(m[1]))
        if m[2]:
            column = (m[3] or m[4] or "").strip()
            agg = {"avg": "mean", "nunique": "distinct"}.get(m[2].lower(), m[2].lower())
            return measure(Measure(agg, None if column in ("", "*") else column, where=where, order=order)).cast("double")
        raise ValueError(f"unexpected {m[0]!r}")

    def product() -> Column:
        out = factor()
        while parts and parts[-1][5] in ("*", "/"):
            op, right = parts.pop()[5], factor()
            out = out * right if op == "*" else F.try_divide(out, right)
        return out

    def total() -> Column:
        out = product()
        while parts and parts[-1][5] in ("+", "-"):
            op, right = parts.pop()[5], product()
            out = out + right if op == "+" else out - right
        return out

    out = total()
    if parts:
        raise ValueError(f"unexpected {parts[-1][0]!r}")
    return finite(out)


_LAMBDA = re.compile(r"\s*lambda\s+(\w+)\s*:\s*(.+)\s*\Z", re.S)
_METHOD = {"mean": "mean", "median": "median", "sum": "sum", "min": "min", "max": "max", "count": "count", "nunique": "distinct", "std": "stddev", "var": "variance", "first": "first", "last": "last"}


def lambda_expression(text: str, column: str) -> str:
    """``lambda x: x.sum() / x.count()`` as an aggregate expression over ``column``."""
    m = _LAMBDA.match(text)
    if not m:
        raise ValueError("not a lambda of one argument")
    name, body = m[1], m[2]
    body = re.sub(rf"\b{name}\.size\b(?:\(\))?", "count(*)", body)
    body = re.sub(rf"\b{name}\.quantile\(\s*(0?\.\d+|0|1)\s*\)", lambda q: f"p{float(q[1]) * 100:g}([{column}])", body)

    def method(q: re.Match) -> str:
        if q[1] not in _METHOD:
            raise ValueError(f"unknown method {q[1]!r}")
        return f"{_METHOD[q[1]]}([{column}])"

    body = re.sub(rf"\b{name}\.(\w+)\(\)", method, body)
    if re.search(rf"\b{name}\b(?!\])", re.sub(r"\[[^\]]*\]", "", body)):
        raise ValueError("the argument is used outside an aggregate")
    return body


# -- views -------------------------------------------------------------------


@dataclass(frozen=True)
class View:
    dims: tuple
    measures: tuple[Measure, ...]
    fill: str | None = None
    sort: tuple[str, str] | None = None
    limit: int | None = 500
    names: tuple[str, ...] = ()
    filters: tuple[Column, ...] = field(default_factory=tuple)

    def dim_names(self) -> list[str]:
        return [self.names[i] if i < len(self.names) else f"d{i}" for i in range(len(self.dims))]


def _with_scalars(df: DataFrame, dims: tuple) -> DataFrame:
    """The whole-table numbers that a bin needs: one row, so it is broadcast."""
    for d in dims:
        if isinstance(d, BinWidth):
            df = df.join(F.broadcast(df.agg(F.min(finite(F.col(d.column))).alias("_low"))))
        if isinstance(d, BinQuantile):
            q = [i / d.n for i in range(d.n + 1)]
            df = df.join(F.broadcast(quantiles(df, finite(F.col(d.column)), q, name="_edges")))
    return df


def aggregate(df: DataFrame, view: View) -> DataFrame:
    """One row for each group: dimension columns and measure columns."""
    for f in view.filters:
        df = df.where(f)
    df = _with_scalars(df, view.dims)
    names = view.dim_names()
    keyed = df
    for n, d in zip(names, view.dims, strict=True):
        keyed = keyed.withColumn(n, d.key(df))
    out = _grouped(keyed, names, view.measures)
    if view.fill:
        out = fill_gaps(out, names[0], view.dims[0], view)
    if view.sort:
        column, way = view.sort
        c = F.col(f"`{column}`")
        first = c.asc_nulls_last() if way == "asc" else c.desc_nulls_last()
        out = out.orderBy(first, *[F.col(n).asc_nulls_last() for n in names])
        if view.limit:
            out = out.limit(view.limit)
    return out


def _share(m: Measure) -> float | None:
    """The share of rows below a quantile measure's value; None for other measures."""
    q = re.fullmatch(r"p(\d+(?:\.\d+)?)", m.agg)
    return 0.5 if m.agg == "median" else float(q[1]) / 100 if q and float(q[1]) <= 100 else None


def _grouped(df: DataFrame, names: list[str], measures: tuple[Measure, ...]) -> DataFrame:
    """The measures by group; quantiles are taken apart, as an aggregate would hold every distinct value."""
    plain = [m for m in measures if _share(m) is None]
    out = df.groupBy(*names).agg(*[measure(m).alias(m.title) for m in plain] or [F.count(F.lit(1)).alias("_rows")])
    parts: dict[tuple, list[Measure]] = {}
    for m in measures:
        if _share(m) is not None:
            parts.setdefault((m.column, m.where), []).append(m)
    for (column, where), ms in parts.items():
        x = finite(F.col(column))
        x = F.when(where.predicate(), x) if where else x
        q = quantiles(df, x, [_share(m) for m in ms], names, "_q").withColumnsRenamed({n: f"_of_{n}" for n in names})
        found = [F.get("_q", F.lit(i)).alias(m.title) for i, m in enumerate(ms)]
        if names:
            joined = out.join(q, [out[n].eqNullSafe(q[f"_of_{n}"]) for n in names], "left")
        else:
            joined = out.join(F.broadcast(q))
        out = joined.select(*[F.col(f"`{c}`") for c in out.columns], *found)
    return out.select(*names, *[F.col(f"`{m.title}`") for m in measures])


def totals(df: DataFrame, view: View) -> DataFrame:
    """The measures over all rows (not over groups)."""
    for f in view.filters:
        df = df.where(f)
    return _grouped(df, [], view.measures)


def fill_gaps(out: DataFrame, name: str, dim: Time, view: View) -> DataFrame:
    """Every bucket between the first and the last one.

    zero: an inserted bucket has sums and counts of 0; carry: the bucket before;
    gaps: nulls.  The calendar comes from the grouped (small) table.
    """
    step = {"week": f"INTERVAL {7 * dim.every} DAYS", "quarter": f"INTERVAL {3 * dim.every} MONTHS"}.get(dim.grain, f"INTERVAL {dim.every} {dim.grain.upper()}S")
    ends = out.agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    calendar = ends.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias(name))
    filled = calendar.join(out, name, "left")
    if view.fill == "gaps":
        return filled
    for m in view.measures:
        c = F.col(f"`{m.title}`")
        if view.fill == "zero" and m.agg in ("sum", "count", "distinct", "wsum"):
            filled = filled.withColumn(m.title, F.coalesce(c, F.lit(0)))
        elif view.fill == "carry":
            # One row for each bucket, so one task is enough.
            filled = filled.withColumn(m.title, F.last(c, ignorenulls=True).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    return filled


def partial_periods(df: DataFrame, column: str, dim: Time, now: str) -> DataFrame:
    """Each bucket with its rows and flags: starts inside, not over at ``now``, thin (under half the median)."""
    grouped = df.withColumn("bucket", dim.key(df)).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("first_at"), F.max(column).alias("last_at"))
    step = {"week": f"INTERVAL {7 * dim.every} DAYS", "quarter": f"INTERVAL {3 * dim.every} MONTHS"}.get(dim.grain, f"INTERVAL {dim.every} {dim.grain.upper()}S")
    ends = grouped.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.median("n").alias("mid"), F.count(F.lit(1)).alias("k"))
    after = F.expr(f"bucket + {step}")
    return grouped.join(F.broadcast(ends)).select(
        "bucket",
        "n",
        ((F.col("bucket") == F.col("lo")) & (F.col("first_at").cast("date") > F.col("bucket").cast("date"))).alias("starts_inside"),
        ((F.col("bucket") == F.col("hi")) & (F.lit(now).cast("timestamp_ntz") < after)).alias("not_over"),
        ((F.col("k") >= 4) & (F.col("mid") >= 4) & (F.col("n") < 0.5 * F.col("mid")) & F.lit(dim.grain in ("week", "month", "quarter", "year"))).alias("thin"),
    )


# -- post operations ---------------------------------------------------------


def post(out: DataFrame, op: str, column: str, order: str, by: tuple[str, ...] = (), width: int = 3, total: float | Column | None = None, name: str | None = None) -> DataFrame:
    """Add a window over a grouped table: rolling cumulative diff pctChange pctTotal rank yoy.

    ``order`` is the time dimension, ``by`` the other dimensions (each series
    has its own window).
    """
    x = F.col(f"`{column}`").cast("double")
    series = Window.partitionBy(*by) if by else Window.partitionBy()
    w = series.orderBy(order)
    name = name or f"{op}({column})"
    if op == "rolling":
        return out.withColumn(name, F.avg(x).over(w.rowsBetween(-(width - 1), 0)))
    if op == "cumulative":
        return out.withColumn(name, F.sum(F.coalesce(x, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if op == "diff":
        return out.withColumn(name, x - F.lag(x).over(w))
    if op == "pctChange":
        before = F.lag(x).over(w)
        return out.withColumn(name, F.try_divide(x - before, before))
    if op in ("pctTotal", "pctRows"):
        return out.withColumn(name, F.try_divide(x, total if isinstance(total, Column) else F.lit(total)))
    if op == "rank":
        return out.withColumn(name, F.when(x.isNotNull(), F.row_number().over(series.orderBy(x.desc_nulls_last(), F.col(order)))))
    if op == "yoy":
        earlier = out.select(*[F.col(b).alias(f"_{b}") for b in by], F.add_months(F.col(order).cast("date"), 12).cast("timestamp_ntz").alias("_at"), x.alias("_then"), F.col(order).alias("_was"))
        # Feb 29 and 28 both lead to Feb 28 a year on; the later one stands for it.
        latest = Window.partitionBy(*[f"_{b}" for b in by], "_at").orderBy(F.col("_was").desc())
        earlier = earlier.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_was")
        on = [F.col(order).cast("timestamp_ntz") == F.col("_at"), *[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]]
        joined = out.join(earlier, on, "left")
        return joined.withColumn(name, F.try_divide(x - F.col("_then"), F.col("_then"))).drop("_at", "_then", *[f"_{b}" for b in by])
    raise ValueError(f"unknown post operation {op!r}")
