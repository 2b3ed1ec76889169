"""Approximate largest inner products by a few stable projections and kd-trees.

With M the largest norm, a vector x becomes ``(x / M, sqrt(1 - |x|^2 / M^2))``
and a query q ``(q / |q|, 0)``: both have length 1 and their squared distance
``2 - 2 (q.x) / (|q| M)`` falls as the inner product grows.  ``DIMS`` Gaussian
(2-stable) projections of a difference at distance d have a squared length of
``d^2`` times a chi-square variable with ``DIMS`` degrees of freedom, so with c
the chi-square quantile of ``TRUST`` a neighbour at distance d lies within
projected distance ``d sqrt(c)`` with that probability.

The index is a kd-tree over the projections.  Its upper levels (``cells``, at
most ``SAMPLE / 16``) are cut at medians of a sample of about ``SAMPLE`` rows by
hash; every row is in its cell, and each cell, in blocks of about ``block_rows``
rows, carries the lower levels.  A search goes through a block's leaves in order
of projected distance (incremental projected neighbours), verifies each leaf's
rows with full inner products, and stops when the next leaf's distance passes
``sqrt(c)`` times the distance of the k-th best so far: no neighbour better than
that one is missed with more than probability ``1 - TRUST``.

A query first searches its own cell; its k-th best there decides by the same
test which other cells it goes to.  Queries and rows meet by (cell, block,
chunk): a cell's queries are dealt to chunks of about ``chunk`` queries, and a
block of rows goes once to each chunk, so no task holds more than a block and a
chunk.  Of rows with one vector only the ``k + 1`` smallest ids can be in any
result and only these are indexed (exact); queries with one vector are searched
once, whatever their number.

Defined results: vectors that are null, zero, hold null or non-finite entries
or are not of the most frequent length (``vectors.usual_size``) take no part,
nor do rows without id; rows equal in id and vector are one row; other rows
with one id are rows of their own (a query takes the smallest of its id's
vectors and leaves out only itself); equal scores are ordered by id; with fewer
candidates all are returned; an empty table gives no row; vectors of any length
are taken whole; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import skewed_join, small_batches, written
from .vectors import usual_size, whole

DIMS = 6
TRUST = 0.95
SAMPLE = 1 << 14
LEAF = 64
SLICE = 2048
SPARE = 11


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable stays under with probability ``p``."""

    def below(x: float) -> float:
        a, half = dims / 2, x / 2
        term = total = 1.0
        for i in range(1, 500):
            term *= half / (a + i)
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half else 0.0

    lo, hi = 0.0, 200.0 + 4 * dims
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projections(dim: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Gaussian directions: ``dim`` for the vector's entries, one for the length that is left."""
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def cuts(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper levels of the kd-tree: for each inner node (heap order) its dimension and median."""
    dims, values = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    held = {0: np.arange(len(sample))}
    for node in range(len(dims)):
        at = held.pop(node)
        if len(at):
            d = int(np.ptp(sample[at], axis=0).argmax())
            dims[node], values[node] = d, np.median(sample[at, d])
        right = sample[at, dims[node]] >= values[node]
        held[2 * node + 1], held[2 * node + 2] = at[~right], at[right]
    return dims, values


def descend(p: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each projected row."""
    dims, values = tree
    node = np.zeros(len(p), np.int64)
    while len(p) and node[0] < len(dims):
        node = 2 * node + 1 + (p[np.arange(len(p)), dims[node]] >= values[node])
    return (node - len(dims)).astype(np.int32)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of the projected queries to boxes."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(low[:, d] - q[:, d, None], q[:, d, None] - high[:, d])
        out += np.maximum(gap, 0) ** 2
    return out


def _leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The lower levels: medians of the widest dimension down to leaves of ``size`` rows."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        d = int(np.ptp(p[at], axis=0).argmax())
        half = len(at) // 2
        at = at[np.argpartition(p[at, d], half)]
        todo += [at[half:], at[:half]]
    return out


class Block:
    """Rows of a cell with their kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: np.ndarray):
        leaves = _leaves(p)
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        p = p[order]
        self.low = np.minimum.reduceat(p, self.ends[:-1])
        self.high = np.maximum.reduceat(p, self.ends[:-1])
        self.verified = 0

    def search(self, q: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int, longest: float, test: float):
        """(query's place, row's place, score) of the ``k`` best found for each query.

        ``bound``: squared distances that the k-th best does not pass, infinite if none is known.
        """
        n, keep = len(q), k + SPARE
        size = np.linalg.norm(q, axis=1) * longest
        best, place = np.full((n, keep), -np.inf), np.zeros((n, keep), np.int64)
        gaps = box_distances(p, self.low, self.high)
        turn = np.argsort(gaps, axis=1, kind="stable")
        gaps = np.take_along_axis(gaps, turn, axis=1)
        bound = bound.copy()
        active = np.arange(n)
        for step in range(gaps.shape[1]):
            active = active[gaps[active, step] <= test * bound[active]]
            if not len(active):
                break
            leaf = turn[active, step]
            by = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[by], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = active[by[a:b]]
                lo, hi = self.ends[leaf[by[a]]], self.ends[leaf[by[a]] + 1]
                scores = q[at] @ self.vectors[lo:hi].T
                self.verified += scores.size
                better = np.flatnonzero(scores.max(axis=1) > best[at, -1])
                if not len(better):
                    continue
                at = at[better]
                both = np.hstack([best[at], scores[better]])
                rows = np.hstack([place[at], np.broadcast_to(np.arange(lo, hi), (len(at), hi - lo))])
                top = np.argpartition(-both, keep - 1, axis=1)[:, :keep] if both.shape[1] > keep else np.arange(both.shape[1])[None, :].repeat(len(at), 0)
                new = np.take_along_axis(both, top, axis=1)
                inner = np.argsort(-new, axis=1, kind="stable")
                best[at] = np.take_along_axis(new, inner, axis=1)
                place[at] = np.take_along_axis(np.take_along_axis(rows, top, axis=1), inner, axis=1)
            kth = best[active, k - 1]
            found = np.isfinite(kth)
            with np.errstate(invalid="ignore"):
                bound[active] = np.where(found, np.minimum(bound[active], 2 - 2 * kth / size[active]), bound[active])
        # Once more in one fixed order of summation: equal vectors have equal scores wherever they lie.
        who, rank = np.nonzero(np.isfinite(best))
        rows = place[who, rank]
        scores = (q[who] * self.vectors[rows]).sum(axis=1)
        order = np.lexsort([self.ids[rows], -scores, who])
        who, rows, scores = who[order], rows[order], scores[order]
        first = np.searchsorted(who, np.arange(n))
        chosen = np.arange(len(who)) - first[who] < k
        return who[chosen], rows[chosen], scores[chosen]


def _lists(column) -> np.ndarray:
    """A list column of one length, without nulls, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


class Index:
    """The projected rows, written in the shared folder, and the upper levels of the tree."""

    def __init__(self, points: DataFrame, dim: int, longest: float, k: int, dims: int, trust: float, block_rows: int, chunk: int, seed: int):
        self.points, self.dim, self.longest, self.k = points, dim, longest, k
        self.test = chi_square_quantile(trust, dims)
        self.basis, self.block_rows, self.chunk = projections(dim, dims, seed), block_rows, chunk
        rows = points.count()
        levels = min(max(0, math.ceil(math.log2(max(rows, 1) / block_rows))), int(math.log2(SAMPLE / 16)))
        share = min(1.0, SAMPLE / max(rows, 1))
        mark = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30))
        sample = points.where(mark < int(share * (1 << 30))).select("p").toArrow() if levels else pa.table({"p": pa.array([], pa.list_(pa.float64()))})
        self.tree = cuts(_lists(sample["p"]), levels)
        tree = self.tree

        def bounds(batches):
            held: dict[int, list] = {}
            for batch in batches:
                p = _lists(batch.column(0))
                cell = descend(p, tree)
                for c in np.unique(cell):
                    own = p[cell == c]
                    n, low, high = held.get(c, (0, np.inf, -np.inf))
                    held[c] = n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.list_(pa.float64())), pa.array([v[2] for v in held.values()], pa.list_(pa.float64()))],
                ["cell", "n", "low", "high"],
            )

        parts = points.select("p").mapInArrow(bounds, "cell int, n bigint, low array<double>, high array<double>").groupBy("cell")
        each = [F.min(F.col("low")[d]).alias(f"l{d}") for d in range(dims)] + [F.max(F.col("high")[d]).alias(f"h{d}") for d in range(dims)]
        found = sorted(parts.agg(F.sum("n").alias("n"), *each).collect())  # one row for each cell
        self.cells = np.array([r["cell"] for r in found], np.int32)
        self.counts = np.array([r["n"] for r in found], np.int64)
        self.low = np.array([[r[f"l{d}"] for d in range(dims)] for r in found]).reshape(-1, dims)
        self.high = np.array([[r[f"h{d}"] for d in range(dims)] for r in found]).reshape(-1, dims)


def _projected(rows: DataFrame, dim: int, longest: float, basis: np.ndarray, query: bool) -> DataFrame:
    """``id``, ``vector`` and the projections ``p`` of rows with whole vectors."""

    def project(batches):
        for batch in batches:
            v = _lists(batch.column(1)).reshape(-1, dim)
            if query:
                p = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ basis[:-1]
            else:
                v = v / longest
                p = v @ basis[:-1] + np.sqrt(np.maximum(1 - (v * v).sum(axis=1), 0))[:, None] * basis[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([*p], pa.list_(pa.float64()))], ["id", "vector", "p"])

    return rows.select("id", "vector").mapInArrow(project, f"id bigint, vector {rows.schema['vector'].dataType.simpleString()}, p array<double>")


def usable(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``id``, ``vector`` and ``norm`` of the rows that take part."""
    kind = rows.schema[vector].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            at, v = whole(batch.column(1), dim)
            norm = np.linalg.norm(v, axis=1)
            at, norm = at[norm > 0], norm[norm > 0]
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norm)], ["id", "vector", "norm"])

    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return named.mapInArrow(keep, f"id bigint, vector {kind}, norm double")


def build(rows: DataFrame, dim: int, k: int, dims: int = DIMS, trust: float = TRUST, block_rows: int = 4096, chunk: int = 1 << 15, seed: int = 11) -> Index:
    """Index of ``usable`` rows for searches of up to ``k`` neighbours beside the query itself."""
    longest = rows.agg(F.max("norm")).first()[0] or 1.0
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    return Index(written(_projected(few, dim, longest, projections(dim, dims, seed), False), "points"), dim, longest, k + 1, dims, trust, block_rows, chunk, seed)


def _visit(index: Index, visits: DataFrame) -> DataFrame:
    """``ask``, ``id``, ``score``, ``own`` (the row has the query's vector): the best of each block that a query visits."""
    tree, k, longest, test = index.tree, index.k, index.longest, index.test
    spark = visits.sparkSession
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(int(c), max(1, math.ceil(n / (2 * index.block_rows))), math.ceil(asked[c] / index.chunk)) for c, n in zip(index.cells.tolist(), index.counts.tolist(), strict=True) if c in asked]
    plan = F.broadcast(spark.createDataFrame(shape, "cell int, blocks int, chunks int"))  # a row for each cell

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(descend(_lists(batch.column(2)), tree), pa.int32())], ["id", "vector", "p", "cell"])

    kind = index.points.schema["vector"].dataType.simpleString()
    cells = index.points.mapInArrow(placed, f"id bigint, vector {kind}, p array<double>, cell int").join(plan, "cell")
    rows = cells.select("cell", F.pmod(F.xxhash64("id", "vector"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "vector", "p")
    asks = visits.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("ask"), "chunks").cast("int").alias("chunk"), "ask", "vector", "p", "bound")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            block = Block(left["id"].to_numpy(), _lists(left["vector"]), _lists(left["p"]))
            for lo in range(0, right.num_rows, SLICE):
                part = right.slice(lo, SLICE)
                q, ask = _lists(part["vector"]), part["ask"].to_numpy()
                who, at, scores = block.search(q, _lists(part["p"]), part["bound"].to_numpy(), k, longest, test)
                own = (q[who] == block.vectors[at]).all(axis=1)
                for column, values in zip(out, (ask[who], block.ids[at], scores, own), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64, bool)
        return pa.table({name: np.concatenate(c) if c else np.empty(0, t) for name, c, t in zip(("ask", "id", "score", "own"), out, kinds, strict=True)})

    keys = ["cell", "block", "chunk"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, "ask bigint, id bigint, score double, own boolean")


def search(index: Index, asked: DataFrame) -> DataFrame:
    """``ask``, ``id``, ``score``, ``own``: the ``index.k`` best rows of each query of ``asked`` (ask, vector)."""
    tree, cells, low, high, test, longest, k = index.tree, index.cells, index.low, index.high, index.test, index.longest, index.k
    kind = asked.schema["vector"].dataType.simpleString()
    asked = written(_projected(asked.select(F.col("ask").alias("id"), "vector"), index.dim, longest, index.basis, True).withColumnRenamed("id", "ask"), "asked")
    schema = f"ask bigint, vector {kind}, p array<double>, bound double, cell int"

    def nearest(gap: np.ndarray) -> np.ndarray:
        return np.argmin(gap, axis=1)

    def home(batches):
        for batch in batches:
            p = _lists(batch.column(2))
            at = nearest(box_distances(p, low, high)) if len(p) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(p), np.inf)), pa.array(cells[at], pa.int32())], ["ask", "vector", "p", "bound", "cell"])

    def others(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, kth = _lists(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.linalg.norm(_lists(batch.column(1)), axis=1) * longest
            bound = np.where(np.isnan(kth), np.inf, 2 - 2 * kth / size)
            gap = box_distances(p, low, high)
            first = nearest(gap)
            go = gap <= test * bound[:, None]
            go[np.arange(len(p)), first] = False
            who, at = np.nonzero(go)
            part = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(bound[who]), pa.array(cells[at], pa.int32())], ["ask", "vector", "p", "bound", "cell"])

    best = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    own = written(_visit(index, asked.select("ask", "vector", "p").mapInArrow(home, schema)).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k), "home")
    if len(cells) > 1:
        kth = own.where(F.col("at") == k).select("ask", F.col("score").alias("kth"))
        visits = written(asked.join(kth, "ask", "left").select("ask", "vector", "p", "kth").mapInArrow(others, schema), "visits")
        own = own.drop("at").unionByName(_visit(index, visits)).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    return own


def neighbours(rows: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 20, **settings) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` largest inner products found for each row whose id is a query."""
    spark = rows.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    with small_batches(spark):
        dim = usual_size(rows, vector)
        good = usable(rows, key, vector, dim) if dim else None
        if good is None or good.isEmpty():
            return spark.createDataFrame([], out)
        index = build(good, dim, k, **settings)
        queries = good.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"))
        # Queries with one vector are searched once, as the smallest of their ids.
        same = written(queries.withColumn("ask", F.min("id").over(Window.partitionBy("vector"))), "queries")
        found = search(index, same.where("id = ask").select("ask", "vector"))
        lists = found.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score", "own"))).alias("list"))  # k + 1 entries
        counts = same.groupBy("ask").agg(F.count(F.lit(1)).alias("n"))
        lists = written(lists.join(counts, "ask"), "lists")
        each = skewed_join(same.select("id", "ask"), lists, "ask", "n")
    # The row itself goes: the entry with its id and its vector.
    left = F.slice(F.filter("list", lambda e: ~((e["id"] == F.col("id")) & e["own"])), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(left).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))
