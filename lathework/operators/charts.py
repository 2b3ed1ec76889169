"""Aggregates behind charts: boxes, crosstabs, grids, error bars, fits, frames, regions, class breaks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import finite
from .quantiles import quantiles, with_quantiles
from .pivot import top_n_other


def box(df: DataFrame, column: str, group: str, top: int = 20) -> DataFrame:
    """Quartiles, whiskers at the data within 1.5 IQR, and outlier counts by group; the rest as Other."""
    x = finite(F.col(column))
    g = top_n_other(df.where(x.isNotNull()), group, top, "_group")
    q = quantiles(g, x, [0.25, 0.5, 0.75], ["_group"]).join(g.groupBy("_group").agg(F.count(x).alias("n")), "_group")
    iqr = F.col("q")[2] - F.col("q")[0]
    q = q.withColumn("lo", F.col("q")[0] - 1.5 * iqr).withColumn("hi", F.col("q")[2] + 1.5 * iqr)
    inside = x.between(F.col("lo"), F.col("hi"))
    w = g.join(q.select("_group", "lo", "hi"), "_group").groupBy("_group").agg(
        F.min(F.when(inside, x)).alias("low_whisker"), F.max(F.when(inside, x)).alias("high_whisker"), F.count_if(~inside).alias("outliers")
    )
    return q.join(w, "_group").select(F.col("_group").alias("group"), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low_whisker", "high_whisker", "outliers")


def crosstab(df: DataFrame, a: str, b: str, top_a: int = 20, top_b: int = 20) -> DataFrame:
    t = top_n_other(top_n_other(df, a, top_a, "x"), b, top_b, "y")
    return t.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def grouped_bins(df: DataFrame, column: str, group: str, bins: int, top: int = 5) -> DataFrame:
    """Histogram counts by the most frequent groups and Other."""
    x = finite(F.col(column))
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    t = top_n_other(df.where(x.isNotNull()), group, top, "_group").join(F.broadcast(ends))
    return t.groupBy("_group", _bin(x, F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_group", "group")


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    at = F.floor(F.try_divide((x - lo) * bins, hi - lo))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)), F.lit(0)).cast("int")


def grid(df: DataFrame, a: str, b: str, bins: int = 20, value: str | None = None) -> DataFrame:
    """Counts (and sum, mean of a value) over a grid of equal bins."""
    x, y = finite(F.col(a)), finite(F.col(b))
    known = df.where(x.isNotNull() & y.isNotNull())
    ends = known.agg(F.min(x).alias("_xl"), F.max(x).alias("_xh"), F.min(y).alias("_yl"), F.max(y).alias("_yh"))
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs += [F.sum(finite(F.col(value))).alias("sum"), F.avg(finite(F.col(value))).alias("mean")]
    return known.join(F.broadcast(ends)).groupBy(_bin(x, F.col("_xl"), F.col("_xh"), bins).alias("bx"), _bin(y, F.col("_yl"), F.col("_yh"), bins).alias("by")).agg(*aggs)


#: Two-sided 95 % points of Student's t by degrees of freedom (the last for all larger ones); fixed values.
T95 = ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306), (9, 2.262), (10, 2.228), (15, 2.131), (20, 2.086), (30, 2.042), (60, 2.0), (120, 1.98))


def t95(df_: Column) -> Column:
    out = None
    for n, t in T95:
        out = F.when(df_ <= n, t) if out is None else out.when(df_ <= n, t)
    return out.otherwise(1.96)


def error_bars(df: DataFrame, column: str, group: str, kind: str = "ci") -> DataFrame:
    """Mean with its bars: ci (95 %, Student), se, sd or range (p2.5 to p97.5)."""
    x = finite(F.col(column))
    known = df.where(x.isNotNull())
    g = known.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    half = {"ci": t95(F.col("n") - 1) * se, "se": se, "sd": F.col("sd")}.get(kind)
    if half is None:
        return with_quantiles(g, known, x, [0.025, 0.975], [group], "_q").select(group, "n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
    return g.select(group, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


#: Up to so many rows the ranks are exact; beyond, by the normal approximation; fixed values.
EXACT_RANKS, Z975 = 1000, 1.959964


def median_ranks(n: int) -> tuple[int, int] | None:
    """Ranks (from 0) of the order statistics between which the median lies with 95 % or more; None below six rows."""
    if n < 6:
        return None
    if n > EXACT_RANKS:
        half = 0.5 * Z975 * math.sqrt(n)
        return max(0, math.floor(n / 2 - half) - 1), min(n - 1, math.ceil(n / 2 + half))
    below, k = 0, -1
    # Binomial tails in whole numbers: 2 P(X <= k) <= 0.05.
    while 40 * (below + math.comb(n, k + 1)) <= 1 << n:
        k += 1
        below += math.comb(n, k)
    return k, n - 1 - k


def median_bars(df: DataFrame, column: str, group: str) -> DataFrame:
    """``group``, ``n``, ``median`` and the distribution-free 95 % interval ``low``, ``high`` (null below six numbers).

    The bounds are order statistics: the values at two ranks that depend on the
    group's count alone.  They are taken from the running counts of the group's
    different values, in ranges cut at literal quantiles, so a group of any size
    is never one task and no list of values is made.  Missing numbers do not
    count; a group without a number has no row.
    """
    x = finite(F.col(column))
    known = df.where(x.isNotNull()).select(F.col(group), x.alias("_x"))
    counts = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    exact = df.sparkSession.createDataFrame([(n, *pair) for n in range(EXACT_RANKS + 1) if (pair := median_ranks(n))], "n bigint, _a bigint, _b bigint")
    half = 0.5 * Z975 * F.sqrt("n")
    a = F.when(F.col("n") > EXACT_RANKS, F.greatest(F.lit(0), F.floor(F.col("n") / 2 - half) - 1)).otherwise(F.coalesce("_a", F.lit(-1)))
    b = F.when(F.col("n") > EXACT_RANKS, F.least(F.col("n") - 1, F.ceil(F.col("n") / 2 + half))).otherwise(F.coalesce("_b", F.lit(-1)))
    ranks = F.array(a.cast("long"), b.cast("long"), F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    wanted = counts.join(F.broadcast(exact), "n", "left").select(group, "n", ranks.alias("_ranks"))
    picked = order_statistics(known, group, wanted)
    at = [F.get("_v", F.lit(i)) for i in range(4)]
    return picked.select(group, "n", ((at[2] + at[3]) / 2).alias("median"), at[0].alias("low"), at[1].alias("high"))


#: Ranges of a group's values by the sketch; each is ordered by itself.
RANGES = 256


def order_statistics(known: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (group, n, ``_ranks`` from 0) with ``_v``: the values of ``known`` (group, ``_x``) at these ranks, null for a negative one.

    A sketch cuts each group into ``RANGES`` ranges.  Their counts tell in which
    range each rank lies; only the different values of these ranges are put in
    order, each range for itself, with running counts.
    """
    cuts = known.groupBy(group).agg(F.percentile_approx("_x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts")).withColumnRenamed(group, "_g")
    values = known.groupBy(group, "_x").agg(F.count(F.lit(1)).alias("_c"))
    # How many cuts are not above the value.
    placed = values.join(cuts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_r", F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))).drop("_cuts", "_g")
    sizes = placed.groupBy(group, "_r").agg(F.sum("_c").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows a group
    ranks = wanted.select(F.col(group).alias("_g"), F.posexplode("_ranks").alias("_i", "_k"))
    met = sizes.withColumn("_before", before).join(ranks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_m")))
    met = met.select("_g", F.col("_r").alias("_at"), "_i", (F.col("_k") - F.col("_before")).alias("_k"))
    ordered = Window.partitionBy("_g", "_at", "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.join(met, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_at"))).withColumn("_upto", F.sum("_c").over(ordered))
    found = inside.where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_m"))
    out = wanted.join(found, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn("_v", F.transform(F.sequence(F.lit(0), F.size("_ranks") - 1), lambda i: F.col("_m")[i])).drop("_m", "_g")


def bootstrap(df: DataFrame, column: str, group: str, rounds: int = 1000, seed: int = 20261103) -> DataFrame:
    """95 % bars of the mean by the Poisson bootstrap: each row counts a Poisson(1) number of times in each round.

    A task draws for a few hundred of its rows at a time, seeded by its place, so
    equal rows draw apart; partial sums are taken where the rows lie and a group
    of any size is never gathered.
    """
    rows = df.select(F.col(group).cast("string").alias("group"), finite(F.col(column)).alias("x")).where("x is not null")

    def partial(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for g, part in pdf.groupby("group", dropna=False, sort=True):
                s, n = held.setdefault(g, (np.zeros(rounds), np.zeros(rounds)))
                x = part["x"].to_numpy()
                for lo in range(0, len(x), 512):
                    some = x[lo : lo + 512]
                    w = rng.poisson(1.0, (rounds, len(some))).astype(float)
                    s += w @ some
                    n += w.sum(1)
        out = [(g, i, float(s[i]), float(n[i])) for g, (s, n) in held.items() for i in range(rounds)]
        yield pd.DataFrame(out, columns=["group", "round", "s", "n"])

    sums = rows.mapInPandas(partial, "group string, round int, s double, n double").groupBy("group", "round").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    return sums.groupBy("group").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("group", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = finite(F.col(x)), finite(F.col(y))
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def summary(df: DataFrame, column: str) -> DataFrame:
    x = finite(F.col(column))
    one = df.agg(F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quantiles(one, df, x, [0.25, 0.5, 0.75], [], "_q").select("n", "sum", "mean", "sd", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")


def frames(df: DataFrame, frame: Column, category: str, column: str) -> DataFrame:
    """Sums by frame and category, with each frame's rank (animation bars)."""
    from pyspark.sql import Window

    g = df.groupBy(frame.alias("frame"), F.col(category).alias("category")).agg(F.sum(finite(F.col(column))).alias("value"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("value").desc_nulls_last(), "category")))


def slices(df: DataFrame, column: str, ranges: list[tuple[str, float, float]], value: str) -> DataFrame:
    """Count and sum within named ranges; where two touch, the first one takes the value."""
    x = F.col(column)
    label = None
    for name, lo, hi in ranges:
        label = F.when(x.between(lo, hi), name) if label is None else label.when(x.between(lo, hi), name)
    return df.groupBy(label.otherwise("(outside)").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum(finite(F.col(value))).alias("sum"))


def places(df: DataFrame, lat: str, lon: str, value: str, limit: int = 500) -> DataFrame:
    """Points rounded to 1e-5 degrees: count, sum and mean; the busiest ones."""
    known = df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    g = known.groupBy(F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon")).agg(F.count(F.lit(1)).alias("n"), F.sum(finite(F.col(value))).alias("sum"), F.avg(finite(F.col(value))).alias("mean"))
    return g.orderBy(F.col("n").desc(), "lat", "lon").limit(limit)


def class_breaks(df: DataFrame, column: str, n: int, how: str = "quantile", edges: list[float] | None = None, exact: int = 20_000) -> list[float]:
    """Class edges: quantile, equal, stddev, pretty (round steps), log, manual (``edges``), or natural.

    Natural breaks (Fisher-Jenks) weigh each different value by its rows: the
    sum of squared deviations in the classes is least over all divisions.  They
    are the first values of the classes and the last value.  Up to ``exact``
    different values the division is exact; of more, the values of ``exact / 2``
    ranges of about equal counts go as one with their exact sums, and the ranges
    beside a break are cut again until each holds one value, so that breaks fall
    between single values; the driver holds ranges only.
    """
    x = finite(F.col(column))
    lo, hi, mean, sd = df.agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x)).first()
    if lo is None:
        return []
    if how == "manual":
        return sorted({lo, hi, *(e for e in edges or () if lo < e < hi)})
    if how == "pretty":
        raw = (hi - lo) / n or 1.0
        size = 10.0 ** np.floor(np.log10(raw))
        step = float(size * next(m for m in (1, 2, 5, 10) if m * size >= raw * (1 - 1e-9)))
        first = np.floor(lo / step + 1e-9) * step
        return [float(round(first + i * step, 12)) for i in range(int(np.ceil((hi - first) / step - 1e-9)) + 1)]
    if how == "log" and lo > 0:
        return [float(lo * (hi / lo) ** (i / n)) for i in range(n + 1)]
    if how in ("equal", "log"):
        return [lo + (hi - lo) * i / n for i in range(n + 1)]
    if how == "stddev":
        return sorted({min(hi, max(lo, mean + sd * k)) for k in range(-(n // 2), n // 2 + 1)} | {lo, hi})
    if how == "quantile":
        return list(quantiles(df, x, [i / n for i in range(n + 1)]).first()[0])
    counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.orderBy("v").limit(exact + 1).collect()  # bounded by ``exact``
    if len(held) <= exact:
        v, w = np.array([r["v"] for r in held]), np.array([r["n"] for r in held], float)
        return _natural(v, v, w, w * v, w * v * v, n)
    return _natural_of_many(counts, n, exact)


def _ranged(counts: DataFrame, borders: list[float]) -> DataFrame:
    """``counts`` with ``i``, the place of the last border that is not above ``v``."""
    held = np.array(borders)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, v.to_numpy(), "right") - 1).astype("int32")

    return counts.withColumn("i", place("v"))


#: Parts into which a range beside a break is cut again.
OPENED = 64


def _natural_of_many(counts: DataFrame, n: int, exact: int) -> list[float]:
    """Breaks of more different values than fit: over ranges, of which those beside a break are cut again until they hold one value."""
    m = exact // 2
    borders = sorted(set(counts.agg(F.percentile_approx("v", [i / m for i in range(m + 1)], 4 * m)).first()[0]))
    v = F.col("v")
    while True:
        placed = _ranged(counts, borders)
        parts = placed.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("w"), F.sum(F.col("n") * v).alias("s1"), F.sum(F.col("n") * v * v).alias("s2"))
        rows = sorted(parts.collect(), key=lambda r: r["lo"])  # one for each range
        lo, hi, w, s1, s2 = (np.array([r[c] for r in rows], float) for c in ("lo", "hi", "w", "s1", "s2"))
        edges = _natural(lo, hi, w, s1, s2, n)
        beside = {k for e in edges[1:-1] for k in (int(np.searchsorted(lo, e)) - 1, int(np.searchsorted(lo, e)))}
        wide = [k for k in beside if lo[k] < hi[k]]
        if not wide:
            return edges
        finer = placed.where(F.col("i").isin([rows[k]["i"] for k in wide])).groupBy("i").agg(F.percentile_approx("v", [i / OPENED for i in range(OPENED + 1)], 4 * OPENED).alias("q"))
        borders = sorted({*borders, *(x for r in finer.collect() for x in r["q"]), *(rows[k]["hi"] for k in wide)})


def _natural(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: int) -> list[float]:
    """The best division of ordered units (weight, sum, sum of squares) into ``n`` runs, by divide and conquer over each class's last unit."""
    m, n = len(lo), min(n, len(lo))
    shift = s1.sum() / w.sum()
    # About the mean, so that differences of sums keep their digits.
    s2, s1 = s2 - 2 * shift * s1 + shift * shift * w, s1 - shift * w
    cw, c1, c2 = (np.concatenate([[0.0], np.cumsum(a)]) for a in (w, s1, s2))
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    starts = []
    for k in range(1, n + 1):
        new, start = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        todo = [(k, m, k - 1, m - 1)]
        while todo:
            a, b, first, last = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            d = c1[j] - c1[i]
            cost = best[i] + (c2[j] - c2[i] - d * d / (cw[j] - cw[i]))
            at = int(np.argmin(cost))
            new[j], start[j] = cost[at], i[at]
            # Where the best start of j lies bounds those of its neighbours.
            todo += [(a, j - 1, first, start[j]), (j + 1, b, start[j], last)]
        best = new
        starts.append(start)
    edges, j = [float(hi[-1])], m
    for start in reversed(starts):
        j = int(start[j])
        edges.append(float(lo[j]))
    return edges[::-1]


def points_in_polygons(points: DataFrame, lon: str, lat: str, polygons: list[tuple[str, list[list[tuple[float, float]]]]]) -> DataFrame:
    """``points`` with the name of the first polygon (rings by the even-odd rule) that holds each; polygons are a bounded parameter.

    A grid over all polygons knows which of them each cell meets, so a point is
    tried against these alone, a cell's points together.
    """
    boxes = [(min(x for r in rings for x, _ in r), min(y for r in rings for _, y in r), max(x for r in rings for x, _ in r), max(y for r in rings for _, y in r)) for _, rings in polygons]
    x0, y0 = (min((b[i] for b in boxes), default=0.0) for i in (0, 1))
    x1, y1 = (max((b[i] for b in boxes), default=0.0) for i in (2, 3))
    side = int(np.clip(np.ceil(np.sqrt(4 * len(polygons))), 1, 256))
    width, height = (x1 - x0) / side or 1.0, (y1 - y0) / side or 1.0
    cells: dict[int, list[int]] = {}
    at = lambda v, lo, step: min(side - 1, max(0, int((v - lo) / step)))
    for k, (a, b, c, d) in enumerate(boxes):
        for i in range(at(a, x0, width), at(c, x0, width) + 1):
            for j in range(at(b, y0, height), at(d, y0, height) + 1):
                cells.setdefault(i * side + j, []).append(k)
    edges = [np.array([(*p, *q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[1] != q[1]], float).reshape(-1, 4) for _, rings in polygons]
    names = np.array([n for n, _ in polygons] + [None], object)

    def locate(x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy(float), y.to_numpy(float)
        found = np.full(len(px), len(polygons))
        near = np.flatnonzero((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
        i = np.clip(((px[near] - x0) / width).astype(int), 0, side - 1)
        j = np.clip(((py[near] - y0) / height).astype(int), 0, side - 1)
        cell = i * side + j
        order = np.argsort(cell, kind="stable")
        for own in np.split(near[order], np.flatnonzero(np.diff(cell[order])) + 1) if len(near) else ():
            i, j = (min(side - 1, max(0, int((v - lo) / step))) for v, lo, step in ((px[own[0]], x0, width), (py[own[0]], y0, height)))
            for k in cells.get(i * side + j, ()):
                left = own[found[own] == len(polygons)]
                if not len(left):
                    break
                ax, ay, bx, by = edges[k].T
                for lo in range(0, len(left), 4096):
                    some = left[lo : lo + 4096]
                    u, v = px[some][:, None], py[some][:, None]
                    cross = ((by > v) != (ay > v)) & (u < (bx - ax) * (v - ay) / (by - ay) + ax)
                    found[some[cross.sum(1) % 2 == 1]] = k
        return pd.Series(names[found])

    return points.withColumn("region", F.pandas_udf(locate, "string")(F.col(lon), F.col(lat)))


def region_key(c: Column) -> Column:
    """A region name's join key: lower case, single spaces, no leading zeros or ``.0``."""
    out = F.trim(F.regexp_replace(F.lower(c.cast("string")), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(out, r"\.0+$", ""), r"^0+(?=.)", "")


def density(df: DataFrame, x: str, y: str, bins: int = 60) -> DataFrame:
    """A two-way histogram over the 1st to 99th percentiles; what lies beyond is left out."""
    a, b = finite(F.col(x)), finite(F.col(y))
    ends = quantiles(df, a, [0.01, 0.99], name="_qx").crossJoin(F.broadcast(quantiles(df, b, [0.01, 0.99], name="_qy")))
    inside = df.join(F.broadcast(ends)).where(a.between(F.col("_qx")[0], F.col("_qx")[1]) & b.between(F.col("_qy")[0], F.col("_qy")[1]))
    return inside.groupBy(_bin(a, F.col("_qx")[0], F.col("_qx")[1], bins).alias("bx"), _bin(b, F.col("_qy")[0], F.col("_qy")[1], bins).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, x: str, y: str, limit: int = 5000, seed: int = 1) -> DataFrame:
    """At most ``limit`` points, taken by hash, so that a chart of any table is the same each time."""
    known = df.where(finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull())
    return known.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(limit).select(x, y)


def region_aggregate(df: DataFrame, region: Column, value: str, frame: Column | None = None) -> DataFrame:
    """Count, sum, mean, median, min and max of a value by region (and frame)."""
    v = finite(F.col(value))
    named = df.withColumn("region", region)
    keys = ["region"]
    if frame is not None:
        named = named.withColumn("frame", frame)
        keys.append("frame")
    one = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    one = with_quantiles(one, named, v, [0.5], keys, "_mid")
    return one.select(*keys, "n", "sum", "mean", F.get("_mid", F.lit(0)).alias("median"), "min", "max")
