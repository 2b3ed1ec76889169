"""Exact interpolated quantiles without holding a column's values.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer.  Here a sketch (``percentile_approx``, whose rank error is bounded by
rows / ``ACCURACY``) brackets each quantile.  One more pass counts the rows
beyond every bracket by how many brackets they lie above, and the different
values inside one by value: each row adds to one count, before any shuffle.
What is left, some ten-thousandths of the rows, is put in order with running
counts; nothing is gathered into a list but the quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
_MARGIN = 3 / ACCURACY
SMALL = 20_000
#: A group with more than one in HOT_SHARE of the rows is hot.
HOT_SHARE = 1024


def quantiles(df: DataFrame, x: Column, qs: list[float], keys: list[str] | None = None, name: str = "q", least: str | None = None, rows: str | None = None) -> DataFrame:
    """``keys`` and ``name``: the quantiles (at (n - 1) q, interpolated) of the numbers of each group, as an array.

    ``least`` and ``rows`` name columns for the least number and how many there
    are, which the first pass knows.  A group without a number has no row;
    without keys a table without a number has one row of nulls.
    """
    keys = keys or []
    own = [f"_k{i}" for i in range(len(keys))]
    m = len(qs)
    base = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], x.cast("double").alias("_x")).where("_x is not null")
    ends = [p for q in qs for p in (max(0.0, q - _MARGIN), min(1.0, q + _MARGIN))]
    sketch = base.groupBy(*own).agg(F.expr("count(_x) as _n"), F.expr("min(_x) as _least"), F.expr("max(_x) as _most"), F.percentile_approx("_x", ends, ACCURACY).alias("_p"))
    # Of few rows the margin is less than the two ranks that are interpolated: all their values are candidates.
    sketch = sketch.withColumn("_p", F.expr(f"if(_n < {SMALL}, transform(_p, (v, k) -> if(k % 2 = 0, _least, _most)), _p)"))
    sketch = sketch.selectExpr(*[f"{o} as {o}s" for o in own], "_n", "_least", "_p", *[f"_p[{k}] as _p{k}" for k in range(2 * m)])

    inside = " or ".join(f"_x between _p{2 * i} and _p{2 * i + 1}" for i in range(m))
    # A bit for each bracket that the value is not below.
    above = " + ".join(f"if(_x >= _p{2 * i}, {1 << i}L, 0L)" for i in range(m))
    # A row of the counts is below quantile i (no value), among its candidates, or beyond.
    near = f"filter(sequence(0, {m - 1}), i -> if(_x is null, (shiftright(_b, i) & 1L) = 0L, _x <= _p[2 * i + 1]))"

    def counted(held: DataFrame, known: DataFrame, on: list[Column]) -> DataFrame:
        told = held.join(known, *on).selectExpr(*own, f"if({inside}, _x, null) as _x", f"if({inside}, null, {above}) as _b")
        told = told.groupBy(*own, "_x", "_b").agg(F.expr("count(1) as _c"))
        return told.join(known, *on).selectExpr(*own, "_n", "_least", "_p", "_x", "_c", f"explode({near}) as i")

    if keys:
        # Hot groups meet their brackets where their rows lie (by key, a few groups would be a few tasks); fewer than
        # HOT_SHARE can be hot.
        large = F.col("_n") * HOT_SHARE > F.col("_all")
        sized = sketch.join(F.broadcast(sketch.agg(F.expr("sum(_n) as _all"))))
        hot, rest = F.broadcast(sized.where(large).drop("_all")), sized.where(~large).drop("_all")
        same = F.expr(" and ".join(f"{o} <=> {o}s" for o in own))
        others = base.join(F.broadcast(sized.where(large).select(*[f"{o}s" for o in own])), same, "left_anti")
        told = counted(base, hot, [same]).unionByName(counted(others, rest, [same]))
    else:
        told = counted(base, F.broadcast(sketch), [])  # one row
    order = Window.partitionBy(*own, "i").orderBy(F.expr("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = told.selectExpr(*own, "_n", "_least", "i", "_c", "if(_x >= _p[2 * i], _x, null) as v").withColumn("_upto", F.expr("sum(_c)").over(order))
    share = f"array({', '.join(f'{float(q)!r}D' for q in qs)})[i] * (_n - 1)"
    # A rank that misses a whole number by rounding only is that number.
    upto = upto.selectExpr(*own, "_n", "_least", "i", "v", "_upto", f"if(abs({share} - round({share})) < 1e-7, round({share}), {share}) as at")
    found = upto.groupBy(*own, "i").agg(
        F.expr("min(if(_upto > floor(at), v, null)) as a"), F.expr("min(if(_upto > floor(at) + 1, v, null)) as b"), F.expr("max(at - floor(at)) as part"), F.expr("max(_n) as _n"), F.expr("max(_least) as _least")
    )
    out = found.groupBy(*own).agg(F.expr("array_sort(collect_list(struct(i, a + (coalesce(b, a) - a) * part as v))) as _q"), F.expr("max(_n) as _n"), F.expr("max(_least) as _least"))
    more = [F.col(own_).alias(n) for own_, n in (("_least", least), ("_n", rows)) if n]
    out = out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.expr("_q.v").alias(name), *more)
    if keys:
        return out
    nothing = F.array(*[F.lit(None).cast("double") for _ in qs])
    one = out.agg(F.first(name).alias(name), *[F.first(n).alias(n) for n in (least, rows) if n])
    return one.select(F.when(F.size(name) > 0, F.col(name)).otherwise(nothing).alias(name), *[F.coalesce(F.col(n), F.lit(0)).alias(n) if n == rows else F.col(n) for n in (least, rows) if n])


def with_quantiles(grouped: DataFrame, df: DataFrame, x: Column, qs: list[float], keys: list[str], name: str = "q") -> DataFrame:
    """``grouped`` (one row for each ``keys``, null keys too) with the quantiles of ``x`` in ``df`` by these keys."""
    q = quantiles(df, x, qs, keys, "_found")
    if not keys:
        return grouped.join(F.broadcast(q)).withColumnRenamed("_found", name)
    q = q.withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(keys)})
    same = [grouped[k].eqNullSafe(q[f"_of_{i}"]) for i, k in enumerate(keys)]
    return grouped.join(q, same, "left").drop(*[f"_of_{i}" for i in range(len(keys))]).withColumnRenamed("_found", name)
