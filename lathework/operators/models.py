"""Nearest-neighbour imputation from all rows; isolation forest and principal components on bounded samples, applied to every row.

The latter two are fitted on at most ``sample`` rows taken by hash; every row of
the table is then scored in Arrow batches.
"""

from __future__ import annotations

import copy
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .aggregate import finite
from .durable import durable, shared_path
from .neighbours import _matrix
from .order import drawn
from .quantiles import quantiles

#: Donors of a cell; cells at most; drawn donors for each cell to place the cuts.
CELL, CELLS, DRAWN = 2048, 4096, 32
#: Distances within this share of each other are equal, those below it are 0.
EQUAL = 1e-9
#: No weight is less than that of this distance.
FAR = 1e200
#: Answers that go to every task; more are joined by their predictors.
SENT = 20_000


def _sample(df: DataFrame, columns: list[str], n: int, seed: int, kind: str | None = "double") -> pd.DataFrame:
    some = df.select(*[F.col(c).cast(kind).alias(c) if kind else F.col(c) for c in columns]).na.drop()
    # Each row draws for itself, so copies of one row do not come together.
    return drawn(some, n, seed).toPandas()


class Neighbours:
    """Distances over what a row knows, scaled to all predictors: numbers in standard deviations, two labels differ by one."""

    def __init__(self, numeric: list[bool], scale: list[float]):
        self.numeric, self.scale = numeric, scale
        self.donors: list[pd.Series] = []

    def among(self, donors: list[pd.Series]) -> Neighbours:
        """The same distances, to these donors."""
        out = copy.copy(self)
        out.donors = donors
        return out

    def near(self, rows: list[pd.Series], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, donor and distance: the k nearest donors of each row and all that are as near as the k-th."""
        n, m = len(rows[0]), len(self.donors[0])
        square, seen = np.zeros((n, m)), np.zeros((n, 1))
        for v, own, number, scale in zip(rows, self.donors, self.numeric, self.scale, strict=True):
            known = v.notna().to_numpy()[:, None]
            if number:
                # Of differences, so that equal numbers are at distance 0.
                part = ((v.to_numpy(float)[:, None] - own.to_numpy(float)[None, :]) / scale) ** 2
            else:
                code = pd.factorize(pd.concat([own, v], ignore_index=True))[0]
                part = code[m:, None] != code[None, :m]
            square += np.where(known, part, 0.0)
            seen += known
        d = np.sqrt(square * (len(rows) / np.maximum(seen, 1)))
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < m else np.full(n, np.inf)
        who, at = np.nonzero(d <= kth[:, None] * (1 + EQUAL))
        return who, at, d[who, at]

    def least(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What no donor in a box is nearer than, for each spot and box."""
        square, seen = np.zeros((len(x), len(low))), np.zeros((len(x), 1))
        for j, (number, scale) in enumerate(zip(self.numeric, self.scale, strict=True)):
            v = x[:, j, None]
            out = np.maximum(np.maximum(low[None, :, j] - v, v - high[None, :, j]), 0)
            square += np.where(np.isnan(v), 0.0, (out / scale) ** 2 if number else out > 0)
            seen += ~np.isnan(v)
        return np.sqrt(square * (x.shape[1] / np.maximum(seen, 1)))


class _Cuts:
    """A tree of cuts that deals spots out to cells with about equal shares of the drawn ones."""

    def __init__(self, x: np.ndarray, model: Neighbours, cells: int):
        self.nodes: list[list] = []
        self.cells = 0
        self._grow(x, model, cells)
        self.of, self.cut = np.array([n[0] for n in self.nodes], int), np.array([n[1] for n in self.nodes], float)
        self.child = np.array([n[2:] for n in self.nodes], int).reshape(-1, 2)

    def _grow(self, x: np.ndarray, model: Neighbours, cells: int) -> int:
        """The number of a node, or -1 - cell."""
        spread = np.zeros(x.shape[1])
        if cells > 1 and len(x) > 1:
            for j, (number, scale) in enumerate(zip(model.numeric, model.scale, strict=True)):
                # The mean square of the difference of two rows.
                spread[j] = 2 * x[:, j].var() / scale**2 if number else 1 - ((np.unique(x[:, j], return_counts=True)[1] / len(x)) ** 2).sum()
        for j in np.argsort(-spread, kind="stable"):
            values = np.sort(x[:, j])
            other = np.flatnonzero(values[1:] > values[:-1]) + 1
            if spread[j] <= 0 or not len(other):
                continue
            cut = values[other[np.abs(other - len(x) / 2).argmin()]]
            right = x[:, j] >= cut
            at = len(self.nodes)
            self.nodes.append([j, cut, 0, 0])
            share = min(cells - 1, max(1, round(cells * right.mean())))
            self.nodes[at][2:] = [self._grow(x[~right], model, cells - share), self._grow(x[right], model, share)]
            return at
        self.cells += 1
        return -self.cells

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if self.nodes else -1)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            at[inner] = self.child[node, (x[inner, self.of[node]] >= self.cut[node]).astype(int)]
        return -1 - at


def knn_impute(df: DataFrame, target: str, predictors: list[str], k: int = 5, cell: int = CELL) -> DataFrame:
    """Null targets filled from the nearest of all complete rows: a number's inverse-distance mean, a label's vote.

    Predictors are numbers or labels (texts).  All rows as near as the k-th are
    neighbours, so no order of rows counts.  Exact matches win; of labels with
    equal votes the nearer one, then the smaller; the donors' median or commonest
    label when a row knows nothing.  Numbers that are not finite are unknown.

    Rows with equal predictors are one donor, or are asked for once.  Donors lie in cells of
    about ``cell``; a row looks into the nearest one, and then into each that
    can hold a donor as near as the k-th found there.
    """
    is_number = lambda c: df.schema[c].dataType.simpleString() != "string"
    numeric, number = [is_number(c) for c in predictors], is_number(target)
    names = [f"_knn{j}" for j in range(len(predictors))]
    y = F.col(target).cast("double" if number else "string")
    typed = {c: finite(F.col(p)) if n else F.col(p).cast("string") for c, p, n in zip(names, predictors, numeric, strict=True)}
    own = df.withColumns(typed | {"_y": y, "_gap": y.isNull() | F.isnan(y) if number else y.isNull()})
    all_known = reduce(and_, [F.col(c).isNotNull() for c in names], F.lit(True))
    any_known = reduce(or_, [F.col(c).isNotNull() for c in names], F.lit(False))

    value = finite(F.col("_y")) if number else F.col("_y")
    kinds = own.select(*names, "_gap", value.alias("value")).groupBy(*names, "_gap", *([] if number else ["value"]))
    kinds = durable(kinds.agg(F.count("value").alias("n"), *([F.avg("value").alias("value")] if number else [])))
    donors, asks = kinds.where((F.col("n") > 0) & all_known).select(*names, "value", "n"), kinds.where("_gap").select(*names)
    counted = [c for c, n in zip(names, numeric, strict=True) if n]
    sums = [F.expr(x) for c in counted for x in (f"sum(n * {c}) / sum(n)", f"min({c})", f"max({c})")]
    m, *sums = donors.agg(F.count(F.lit(1)), *sums).first()
    if not m:
        return df
    mean = dict(zip(counted, sums[::3], strict=True))
    square = donors.agg(F.lit(0), *[F.sum(F.col("n") * F.pow(F.col(c) - F.lit(mean[c]), F.lit(2))) / F.sum("n") for c in counted]).first()[1:]
    scale = {c: float(np.sqrt(v)) if low < high and 0 < v < np.inf else 1.0 for c, v, low, high in zip(counted, square, sums[1::3], sums[2::3], strict=True)}
    model = Neighbours(numeric, [scale.get(c, 1.0) for c in names])

    asked, blind = asks.agg(F.count_if(any_known), F.count_if(~any_known)).first()
    usual = None
    if blind and number:
        usual = quantiles(own.where(all_known), value, [0.5], name="q").first()[0][0]
    elif blind:
        usual = donors.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").first()["value"]
    kind = "double" if number else "string"
    filled = F.coalesce(F.when(~F.col("_gap"), F.col("_y")), F.lit(usual).cast(kind))
    if not asked:
        return own.withColumn(target, filled).drop(*names, "_y", "_gap")
    answers = _answers(donors, asks.where(any_known), model, names, kind, k, m, cell)
    answers = answers.select(*[F.col(c).alias(f"_of{c}") for c in names], F.col("value").alias("_answer"), F.lit(0).alias("_asks"))
    # Rows that ask nothing are dealt out by number and meet no answer.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) + 1
    own = own.withColumn("_turn", F.when(F.col("_gap"), F.lit(0)).otherwise(spread))
    same = [F.col("_turn") == F.col("_asks"), *[F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in names]]
    out = own.join(F.broadcast(answers) if asked <= SENT else answers, same, "left")
    return out.withColumn(target, F.coalesce(F.when(F.col("_gap"), F.col("_answer")), filled)).drop(*names, *answers.columns, "_y", "_gap", "_turn")


def _answers(donors: DataFrame, asks: DataFrame, model: Neighbours, names: list[str], kind: str, k: int, m: int, cell: int) -> DataFrame:
    """``names`` and ``value`` for each of ``asks``, from all ``m`` donors (names, value, n)."""
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 40)).cast("double"))
    spot = F.array(*[F.col(c) if n else hashed(c) for c, n in zip(names, model.numeric, strict=True)]).alias("spot")
    donors, asks = donors.select(*names, "value", "n", spot), asks.select(F.monotonically_increasing_id().alias("id"), *names, spot)
    cells = min(CELLS, -(-m // cell))
    some = _matrix(drawn(donors.select("spot"), cells * DRAWN).toArrow()["spot"]) if cells > 1 else np.empty((0, len(names)))
    cuts = _Cuts(some.reshape(-1, len(names)), model, cells)

    def place(batches):
        for batch in batches:
            at = cuts.cell(_matrix(batch.column("spot")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "cell"])

    with_cell = lambda df: StructType([*df.schema, StructField("cell", IntegerType())])
    placed = durable(donors.mapInArrow(place, with_cell(donors)))
    box = [F.expr(f"{f}(spot[{j}])") for f in ("min", "max") for j in range(len(names))]
    found = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)), F.sum("n"), *box).collect())  # one for each cell
    of, low, high = np.array([r[0] for r in found]), np.array([r[3 : 3 + len(names)] for r in found], float), np.array([r[3 + len(names) :] for r in found], float)
    sizes, enough = {r[0]: r[1] for r in found}, np.array([r[2] >= k for r in found])
    # The k-th distance is known from one cell if it has k rows.
    first = np.where(enough | ~enough.any(), 0.0, np.inf)

    def home(batches):
        for batch in batches:
            x = _matrix(batch.column("spot"))
            at = [(model.least(x[lo : lo + 256], low, high) + first).argmin(axis=1) for lo in range(0, len(x), 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of[np.concatenate(at)] if at else [], pa.int32())], [*batch.schema.names, "cell"])

    def others(batches):
        for batch in batches:
            x, own, bound = _matrix(batch.column("spot")), batch.column("cell").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), np.inf, bound) * (1 + 2 * EQUAL)
            for lo in range(0, len(x), 256):
                some = slice(lo, lo + 256)
                who, at = np.nonzero((model.least(x[some], low, high) <= bound[some, None]) & (own[some, None] != of[None, :]))
                part = batch.slice(lo, 256).take(pa.array(who))
                columns = [pa.array(of[at], pa.int32()) if c == "cell" else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    best = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")

    def within(found: DataFrame) -> DataFrame:
        """The rows up to the k-th distance, and that distance in ``kth`` (null with fewer rows)."""
        upto = found.withColumn("_upto", F.sum("n").over(best))
        return upto.withColumn("kth", F.min(F.when(F.col("_upto") >= k, F.col("d"))).over(whole)).where(f"kth is null or d <= kth * {1 + EQUAL!r}D").drop("_upto")

    asks = durable(asks.mapInArrow(home, with_cell(asks)))
    near = within(_visit(placed, sizes, asks.withColumn("bound", F.lit(None).cast("double")), model, names, kind, k, cell))
    if len(sizes) > 1:
        near = durable(near)
        bounds = near.groupBy("id").agg(F.max("kth").alias("bound"))
        visits = asks.join(bounds, "id").select(*asks.columns, "bound")
        visits = durable(visits.mapInArrow(others, visits.schema))
        near = within(near.drop("kth").unionByName(_visit(placed, sizes, visits, model, names, kind, k, cell)))
    weight = F.when(F.col("_best") < EQUAL, (F.col("d") < EQUAL).cast("double")).otherwise(1 / F.greatest(F.least("d", F.lit(FAR)), F.lit(EQUAL))) * F.col("n")
    near = near.withColumn("_best", F.min("d").over(whole)).select("id", "d", "value", weight.alias("w"))
    if kind == "double":
        told = near.groupBy("id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    else:
        votes = near.groupBy("id", "value").agg(F.sum("w").alias("w"), F.min("d").alias("d"))
        # Sums that differ by rounding only are equal.
        place_of = F.struct((-F.round(F.col("w") / F.sum("w").over(whole), 9)).alias("a"), F.round("d", 9).alias("b"), F.col("value").alias("c"))
        told = votes.select("id", "value", place_of.alias("at")).groupBy("id").agg(F.min_by("value", "at").alias("value"))
    return durable(asks.select("id", *names).join(told, "id").select(*names, "value"))


def _visit(placed: DataFrame, sizes: dict, visits: DataFrame, model: Neighbours, names: list[str], kind: str, k: int, cell: int) -> DataFrame:
    """``id``, ``d``, ``value``, ``n``: of each block that a row visits, the donors up to the k-th distance there and no further than the bound.

    Donors of one distance are one row (of a label, one each): no more than k distances leave a block.
    """
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(int(c), -(-n // (2 * cell)), -(-asked[c] // (4 * cell))) for c, n in sizes.items() if c in asked]
    plan = F.broadcast(placed.sparkSession.createDataFrame(shape, "cell int, blocks int, chunks int"))  # one row for each cell
    rows = placed.join(plan, "cell").select("cell", F.pmod(F.xxhash64(*names, "value"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *names, "value", "n")
    asks = visits.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "bound", *names)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            known = model.among([left[c] for c in names])
            for lo in range(0, len(right), 256):
                part = right.iloc[lo : lo + 256]
                who, at, d = known.near([part[c] for c in names], k)
                bound = part["bound"].to_numpy(float)[who]
                kept = ~(d > bound * (1 + 2 * EQUAL))
                who, at, d = who[kept], at[kept], d[kept]
                got = pd.DataFrame({"id": part["id"].to_numpy()[who], "d": d, "value": left["value"].to_numpy()[at], "n": left["n"].to_numpy()[at]})
                if kind == "double":
                    got["value"] *= got["n"]
                    got = got.groupby(["id", "d"], as_index=False, sort=False)[["value", "n"]].sum()
                    got["value"] /= got["n"]
                else:
                    got = got.groupby(["id", "d", "value"], as_index=False, sort=False)["n"].sum()
                out.append(got)
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "d", "value", "n"])

    keys = ["cell", "block", "chunk"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, f"id bigint, d double, value {kind}, n bigint")


def knn_holdout(df: DataFrame, target: str, predictors: list[str], ks: tuple[int, ...] = (1, 2, 3, 5, 8, 12, 20, 30, 50), sample: int = 2000, seed: int = 3) -> dict[int, float]:
    """Mean absolute error of each k on a held-out fifth of the sample."""
    d = _sample(df, [*predictors, target], sample, seed)
    x = d[predictors].to_numpy()
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    y = d[target].to_numpy()
    test = np.arange(len(y)) % 5 == 0
    dist = np.sqrt(((x[test][:, None, :] - x[~test][None, :, :]) ** 2).sum(2))
    order = np.argsort(dist, axis=1)
    return {k: float(np.mean(np.abs(y[~test][order[:, :k]].mean(1) - y[test]))) for k in ks if k < (~test).sum()}


def _scaled(df: DataFrame, columns: list[str], sample: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = _sample(df, columns, sample, seed).to_numpy()
    mid = np.median(d, axis=0)
    mad = 1.4826 * np.median(np.abs(d - mid), axis=0)
    mad = np.where(mad > 0, mad, 1.0)
    return (d - mid) / mad, mid, mad


def _score(df: DataFrame, columns: list[str], how, mid: np.ndarray, mad: np.ndarray) -> DataFrame:
    def run(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.astype(float).to_numpy() for c in cols])
        whole = np.isfinite(x).all(1)
        out = np.full(len(x), np.nan)
        if whole.any():
            out[whole] = how((x[whole] - mid) / mad)
        return pd.Series(out)

    return df.withColumn("outlier_score", F.pandas_udf(run, "double")(*[F.col(c).cast("double") for c in columns]))


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 100, size: int = 256, seed: int = 5) -> DataFrame:
    """``df`` with 2^(-path / c): near 1 for rows that few random cuts isolate."""
    x, mid, mad = _scaled(df, columns, trees * size, seed)
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, size))))

    def c(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(rows: np.ndarray, depth: int):
        if depth >= limit or len(rows) <= 1:
            return (c(len(rows)),)
        j = int(rng.integers(x.shape[1]))
        lo, hi = x[rows, j].min(), x[rows, j].max()
        if lo == hi:
            return (c(len(rows)),)
        cut = rng.uniform(lo, hi)
        left = x[rows, j] < cut
        return (j, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1))

    forest = [grow(rng.choice(len(x), min(size, len(x)), replace=False), 0) for _ in range(trees)] if len(x) else []
    norm = c(min(size, len(x))) or 1.0
    laid = [_laid_out(tree, limit) for tree in forest]

    def how(z: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(z.T).ravel()
        total = np.zeros(len(z))
        for of, cut, path in laid:
            total += path[_leaves(columns, len(z), of, cut, limit)]
        return 2.0 ** (-(total / max(1, len(forest))) / norm)

    return _score(df, columns, how, mid, mad)


def _laid_out(tree, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a full one: each inner node's column and cut (children of i: 2i + 1 and 2i + 2), each leaf's path.

    Below a leaf every value goes left, so it ends in the leaf's leftmost place.
    """
    inner = (1 << depth) - 1
    of, cut, path = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(inner + 1)

    def put(node, at: int, level: int) -> None:
        if len(node) == 1:
            while at < inner:
                at = 2 * at + 1
            path[at - inner] = level + node[0]
            return
        of[at], cut[at] = node[:2]
        put(node[2], 2 * at + 1, level + 1)
        put(node[3], 2 * at + 2, level + 1)

    put(tree, 0, 0)
    return of, cut, path


def _leaves(columns: np.ndarray, n: int, of: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row; ``columns`` holds the rows' finite values column after column."""
    start, row = of * np.int32(n), np.arange(n, dtype=np.int32)
    at = (columns[start[0] : start[0] + n] >= cut[0]) + np.int32(1)
    for _ in range(depth - 1):
        right = columns.take(start.take(at) + row) >= cut.take(at)
        at += at
        at += right
        at += 1
    return at - np.int32(len(of))


def pca_residual(df: DataFrame, columns: list[str], components: int = 8, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """``df`` with the distance from the space of the leading components."""
    x, mid, mad = _scaled(df, columns, sample, seed)
    mean = x.mean(0)
    _, _, v = np.linalg.svd(x - mean, full_matrices=False)
    v = v[: min(components, max(1, x.shape[1] - 1))]

    def how(z: np.ndarray) -> np.ndarray:
        y = z - mean
        return np.sqrt(((y - y @ v.T @ v) ** 2).sum(1))

    return _score(df, columns, how, mid, mad)


def _written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "scored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flag_top(df: DataFrame, share: float = 0.01) -> DataFrame:
    """``df`` with ``outlier``: the rows whose score is in the top share.

    ``df`` is written once: the cut takes two passes over the scores and the flags a third.
    """
    df = _written(df)
    cut = quantiles(df, F.col("outlier_score"), [1 - share], name="_cut").select(F.get("_cut", F.lit(0)).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("outlier", F.coalesce(F.col("outlier_score") > F.col("_cut"), F.lit(False))).drop("_cut")
