"""Exact nearest neighbours as a join of cells around pivots, and the local outlier factor on it.

Each point goes to its nearest pivot (a hash sample of about one point in
``CELL``, at most ``PIVOTS``).  A point first looks through its own cell; the
distance of its k-th neighbour there bounds the rest: by the triangle inequality
a cell can hold a nearer point only if the point's distance to the pivot lies
within that bound of the cell's least and greatest distances, and the plane
midway between the two pivots is not further than it.  Only these cells are
visited, so every neighbour is found.  Cells and their visitors meet in blocks
of about ``CELL`` rows, whatever a cell holds.

Points are different ones with how many rows have them (``w``): a third of the
table at one place is one point.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import finite
from .durable import durable
from .quantiles import quantiles

CELL, PIVOTS = 2048, 4096
_TRIPLE = "id bigint, other bigint, d double, w bigint"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dimension by dimension: equal differences give equal distances wherever the points lie."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(out)


def nearest(points: DataFrame, k: int, cell: int = CELL, seed: int = 5) -> DataFrame:
    """``id``, ``other``, ``d``, ``w``: of ``points`` (id, x, w) all rows within each point's k-th nearest distance.

    A point's own other copies are its neighbours at distance 0 (with ``w`` one
    less).  Equally distant points at the edge are all neighbours; with fewer
    than ``k`` other rows all are.
    """
    rows = points.count()
    n_pivots = min(PIVOTS, math.ceil(rows / cell))
    share = n_pivots / max(1, rows)
    mark = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40))
    pivots = _matrix(points.where(mark < int(share * (1 << 40))).select("x").toArrow()["x"]) if n_pivots > 1 else np.empty((0, 1))
    if len(pivots) == 0:  # one cell: any point is its pivot
        pivots = _matrix(points.select("x").limit(1).toArrow()["x"])
    if len(pivots) == 0:
        return points.sparkSession.createDataFrame([], _TRIPLE)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            away = np.concatenate([_distances(x[lo : lo + 256], pivots) for lo in range(0, len(x), 256)]) if len(x) else np.empty((0, len(pivots)))
            at = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(away[np.arange(len(x)), at])], ["id", "x", "w", "cell", "away"])

    placed = durable(points.select("id", "x", "w").mapInArrow(place, "id bigint, x array<double>, w bigint, cell int, away double"))
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # one for each pivot
    cells = np.array(sorted(sizes))
    low, high = (np.array([sizes[c][name] for c in cells.tolist()]) for name in ("low", "high"))
    between = _distances(pivots[cells], pivots[cells])

    def others(batches):
        for batch in batches:
            x, home, bound = _matrix(batch.column(1)), np.searchsorted(cells, batch.column(2).to_numpy()), batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), np.inf, bound)
            for lo in range(0, len(x), 256):
                some = slice(lo, lo + 256)
                away, own, far = _distances(x[some], pivots[cells]), home[some], bound[some, None] * (1 + 1e-9)
                mine = away[np.arange(len(own)), own][:, None]
                apart = between[own]
                plane = np.where(apart > 0, (away**2 - mine**2) / np.where(apart > 0, 2 * apart, 1), 0)
                go = (away - high <= far) & (low - away <= far) & (plane <= far)
                go[np.arange(len(own)), own] = False
                who, at = np.nonzero(go)
                part = batch.slice(lo, 256).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells[at], pa.int32()), part.column(3)], ["id", "x", "cell", "bound"])

    best = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")

    def within(found: DataFrame) -> DataFrame:
        """The rows up to the k-th distance, and that distance in ``kth`` (null with fewer rows)."""
        upto = found.withColumn("_upto", F.sum("w").over(best))
        return upto.withColumn("kth", F.min(F.when(F.col("_upto") >= k, F.col("d"))).over(whole)).where("kth is null or d <= kth").drop("_upto")

    home = placed.select("id", "x", "cell", F.lit(None).cast("double").alias("bound"))
    near = durable(within(_visit(placed, sizes, home, k, cell)))
    bounds = near.groupBy("id").agg(F.max("kth").alias("bound"))
    visits = placed.select("id", "x", "cell").join(bounds, "id", "left").select("id", "x", "cell", "bound").mapInArrow(others, "id bigint, x array<double>, cell int, bound double")
    far = _visit(placed, sizes, durable(visits), k, cell)
    return within(near.drop("kth").unionByName(far)).drop("kth")


def _visit(placed: DataFrame, sizes: dict, visits: DataFrame, k: int, cell: int) -> DataFrame:
    """Of each block that a point visits, its rows up to the k-th distance there and no further than the bound."""
    spark = placed.sparkSession
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(int(c), math.ceil(s["n"] / (2 * cell)), math.ceil(asked[c] / (4 * cell))) for c, s in sizes.items() if c in asked]
    plan = F.broadcast(spark.createDataFrame(shape, "cell int, blocks int, chunks int"))  # one row for each pivot
    rows = placed.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "x", "w")
    asks = visits.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int").alias("chunk"), "id", "x", "bound")
    asks = asks.select(*[F.col(c).alias(f"_{c}") for c in asks.columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, x, w = left["id"].to_numpy(), _matrix(left["x"]), left["w"].to_numpy()
            for lo in range(0, right.num_rows, 512):
                part = right.slice(lo, 512)
                own, bound = part["_id"].to_numpy(), part["_bound"].to_numpy().astype(float)
                d = _distances(_matrix(part["_x"]), x)
                count = w[None, :] - (own[:, None] == ids[None, :])
                first = np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1)] if d.shape[1] > k + 1 else np.full(len(d), np.inf)
                limit = np.fmin(first, bound)  # k + 1 different points hold at least k rows beside the point itself
                who, at = np.nonzero((d <= limit[:, None]) & (count > 0))
                for column, values in zip(out, (own[who], ids[at], d[who, at], count[who, at]), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64, np.int64)
        return pa.table({name: np.concatenate(c) if c else np.empty(0, t) for name, c, t in zip(("id", "other", "d", "w"), out, kinds, strict=True)})

    keys = ["cell", "block", "chunk"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*[f"_{c}" for c in keys])).applyInArrow(meet, _TRIPLE)


#: A column from 0 on whose largest number is over so many medians is taken by its logarithm, from so many numbers on; fixed values.
SKEW, LEAST_SKEWED = 12, 20


def robust(df: DataFrame, columns: list[str]) -> list[tuple[bool, float, float]]:
    """Of each column: whether its logarithm is taken, the median and the scale (1.4826 MAD, else IQR / 1.349, else the standard deviation, else 1)."""
    out = []
    for c in columns:
        x = finite(F.col(c))
        q, n = quantiles(df, x, [0.0, 0.5, 1.0], name="q", rows="n").first()
        log = bool(n and n >= LEAST_SKEWED and q[0] >= 0 and q[1] > 0 and q[2] > SKEW * q[1])
        y = F.log1p(x) if log else x
        q1, mid, q3 = quantiles(df, y, [0.25, 0.5, 0.75], name="q").first()[0]
        if mid is None:
            out.append((False, 0.0, 1.0))
            continue
        mad = quantiles(df, F.abs(y - mid), [0.5], name="q").first()[0][0]
        sd = df.agg(F.stddev_samp(y)).first()[0] or 0.0
        scale = next((s for s, least in ((1.4826 * mad, 1.4826e-12), ((q3 - q1) / 1.349, 1e-12 / 1.349), (sd, 1e-12)) if s > least), 1.0)
        out.append((log, mid, scale))
    return out


def local_outlier_factor(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """``df`` with ``outlier_score``: the mean density of a row's ``k`` neighbours over its own, every row against all rows.

    Columns are scaled by ``robust``.  Nothing is fitted on a sample and no
    distances beyond the neighbours' leave a task.  Defined results: a row with a
    missing or non-finite number has no score; rows of ``k`` or more copies have
    infinite density, score 0, and count with
    density 0 for others; with fewer than two rows there is no score; repeated
    rows have equal scores.
    """
    k = max(2, min(50, k))
    scales = robust(df, columns)
    keys = [finite(F.col(c).cast("double")) for c in columns]
    raw = df.select(*[x.alias(f"_k{i}") for i, x in enumerate(keys)]).na.drop()
    points = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("w"))
    x = F.array(*[((F.log1p(F.col(f"_k{i}")) if log else F.col(f"_k{i}")) - F.lit(mid)) / F.lit(scale) for i, (log, mid, scale) in enumerate(scales)])
    points = durable(points.withColumn("id", F.monotonically_increasing_id()).withColumn("x", x))
    near = durable(nearest(points.select("id", "x", "w"), k))
    reach = near.groupBy("id").agg(F.max("d").alias("_reach"))
    met = near.join(reach.withColumnRenamed("id", "other"), "other")
    density = met.groupBy("id").agg(F.sum("w").alias("_n"), F.sum(F.col("w") * F.greatest("_reach", "d")).alias("_s"))
    density = durable(density.select("id", F.when(F.col("_s") > 0, F.col("_n") / F.col("_s")).otherwise(0.0).alias("_lrd")))
    mean = near.join(density.withColumnsRenamed({"id": "other", "_lrd": "_o"}), "other").groupBy("id").agg((F.sum(F.col("w") * F.col("_o")) / F.sum("w")).alias("_mean"))
    scores = points.join(mean.join(density, "id"), "id").select(*raw.columns, F.when(F.col("_lrd") > 0, F.col("_mean") / F.col("_lrd")).otherwise(0.0).alias("outlier_score"))
    own = df.withColumns({f"_k{i}": v for i, v in enumerate(keys)}).drop("outlier_score")
    return own.join(scores, raw.columns, "left").drop(*raw.columns)
