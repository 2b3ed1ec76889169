"""Embedding whitening by matrix-free block Lanczos.

Each entry c of a vector becomes the integer ``x = floor(SCALE * c) + SHIFT``
(entries beyond +-``LARGEST / SCALE`` are taken as that).  The covariance V of
the x-vectors (divisor n) is never formed: a pass over the table gives ``V Q``
for a block Q of ``BLOCK`` directions, as the sum over the partitions of
``C'(C Q) / n`` with centred rows ``C = (n x - S) / n``, whose numerators are
exact integers.  Spark adds the partitions' sums; the driver holds matrices of
(dimensions x directions) only, whatever the number of rows.

* Every new block is reorthogonalised against all earlier ones, twice.
* A direction of a block that vanishes (breakdown: the space is invariant) is
  replaced by a random one orthogonal to all that are held.
* The Ritz pairs come from ``Q'VQ`` with the passes' own ``VQ``; it ends when
  the residuals ``|V u - e u|`` of all wanted pairs are under ``TOLERANCE`` of
  the largest eigenvalue and a pass with fresh random directions changes none
  (an eigenvalue of higher multiplicity than a block would hide else), or when
  the directions span the whole space, where the pairs are exact.
* ``trace(V)`` is the exact sum of the rows' deviations over n cubed, so the
  explained shares need no further eigenvalue.

Defined results: a null vector, or one with null or non-finite entries, takes
no part and has no row; a vector that is not of the most frequent length
neither (``vectors.usual_size``); a zero vector takes part; a null id is kept;
repeated rows are rows of their own, in the fit and in the result; with fewer
dimensions, or a covariance of lower rank, there are as many components as
eigenvalues above ``RANK`` of the largest (none if all vectors are equal, or
there is one: no row); an empty table gives no row; a deviation beyond 64 bits
is null (the trace is summed in 38 digits); vectors of any length are taken
whole (a row is one Arrow value); other columns, whatever their names, are not
carried.
"""

from __future__ import annotations

import dataclasses
import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .vectors import usual_size, whole

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 46
BLOCK = 16
TOLERANCE = 1e-13
RANK = 1e-12
ROWS = 1024


@dataclasses.dataclass(frozen=True)
class Model:
    """What ``fit`` finds: ``vectors`` are columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def integers(c: np.ndarray) -> np.ndarray:
    """The x-vectors of a matrix of doubles."""
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exact: 64-bit integers where they and the sums of their squares fit, Python's else."""
    if len(x) and n * int(np.abs(x).max()) < 1 << 62:
        u = n * x - sums
        if x.shape[1] * float(np.abs(u).max(initial=0)) ** 2 < 2.0**62:
            return u
    return n * x.astype(object) - sums.astype(object)


def deviations(u: np.ndarray) -> np.ndarray:
    return (u * u).sum(axis=1)


def _batches(batches, at: int, dim: int):
    """(batch, places, x-vectors) in slices of few rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            places, held = whole(part.column(at), dim)
            if len(places):
                yield part, places, integers(held)


def _sums(rows: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray]:
    def add(batches):
        n, total = 0, np.zeros(dim, np.int64)
        for _, places, x in _batches(batches, 0, dim):
            n, total = n + len(places), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], ["i", "s", "n"])

    parts = rows.select(vector).mapInArrow(add, "i int, s bigint, n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = sorted(parts.collect())
    return found[0]["n"], np.array([r["s"] for r in found], np.int64)


def _pass(rows: DataFrame, vector: str, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """``V basis`` and the sum of all deviations: one pass, one row of sums for each dimension and partition."""
    dim, width = basis.shape

    def multiply(batches):
        out, total = np.zeros((dim, width)), 0
        for _, _, x in _batches(batches, 0, dim):
            u = numerators(x, n, sums)
            total += sum(deviations(u).tolist())
            c = u.astype(np.float64) / n
            out += c.T @ (c @ basis)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim), pa.int32()), pa.array([*out], pa.list_(pa.float64())), pa.array([decimal.Decimal(total)] + [decimal.Decimal(0)] * (dim - 1), pa.decimal128(38, 0))], ["i", "y", "total"]
        )

    parts = rows.select(vector).mapInArrow(multiply, "i int, y array<double>, total decimal(38,0)")
    found = parts.groupBy("i").agg(F.array(*[F.sum(F.col("y")[k]) for k in range(width)]).alias("y"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    found.sort(key=lambda r: r["i"])
    return np.array([r["y"] for r in found]) / n, int(found[0]["total"])


def orthogonal(block: np.ndarray, held: np.ndarray, rng, want: int) -> np.ndarray:
    """``want`` orthonormal directions orthogonal to ``held``: the block's own, random ones for those that vanish."""
    out = np.empty((held.shape[0], 0))
    fresh = 0
    for column in [*block.T, *[None] * (want + held.shape[0])]:
        if out.shape[1] == want:
            break
        if column is None:
            column, fresh = rng.standard_normal(held.shape[0]), fresh + 1
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            column = column - held @ (held.T @ column)
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-8:
            column = column / left
            column -= held @ (held.T @ column) + out @ (out.T @ column)
            out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
    return out


def lanczos(apply, dim: int, want: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 17):
    """The ``want`` largest eigenvalues and their vectors of the symmetric operator ``apply``; and the number of passes."""
    rng = np.random.default_rng(seed)
    want, block = min(want, dim), min(block, dim)
    held, image = np.empty((dim, 0)), np.empty((dim, 0))
    turn, passes, settled = orthogonal(rng.standard_normal((dim, block)), held, rng, block), 0, None
    while True:
        got = apply(turn)
        passes += 1
        held, image = np.hstack([held, turn]), np.hstack([image, got])
        small = held.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:want], inner[:, ::-1][:, :want]
        vectors = held @ inner
        residual = np.linalg.norm(image @ inner - vectors * values, axis=0)
        scale = max(values[0], 0.0)
        ended = len(values) == want and bool((residual <= tolerance * scale).all())
        if held.shape[1] >= dim or not scale and settled is not None:
            return values, vectors, passes
        if ended and settled is not None and np.allclose(values, settled, rtol=0, atol=tolerance * scale):
            return values, vectors, passes
        settled = values if ended else None
        width = min(block, dim - held.shape[1])
        # Settled pairs are tried with fresh directions, others go on along the residuals' space.
        turn = orthogonal(np.empty((dim, 0)) if ended else got, held, rng, width)


def fit(rows: DataFrame, vector: str = "embedding", components: int = 32, block: int = BLOCK) -> Model | None:
    """The whitening of ``rows``; None without a vector or without spread."""
    with small_batches(rows.sparkSession):
        dim = usual_size(rows, vector)
        if not dim:
            return None
        n, sums = _sums(rows, vector, dim)
        total = 0

        def apply(basis):
            nonlocal total
            out, total = _pass(rows, vector, n, sums, basis)
            return out

        values, vectors, passes = lanczos(apply, dim, components, block)
    kept = values > RANK * max(values[0], 0.0)
    if not total or not kept.any():
        return None
    trace = float(decimal.Decimal(total) / decimal.Decimal(n) ** 3)
    return Model(n, sums, values[kept], vectors[:, kept], trace, passes)


def _whitened(u: np.ndarray, model: Model) -> np.ndarray:
    return u.astype(np.float64) / model.n @ model.vectors / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Model, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by a pass of its own."""
    k, dim = len(model.values), len(model.sums)

    def gather(batches):
        out = np.zeros((k + 1, k))
        for _, _, x in _batches(batches, 0, dim):
            w = _whitened(numerators(x, model.n, model.sums), model)
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), pa.array([*out], pa.list_(pa.float64()))], ["i", "y"])

    with small_batches(rows.sparkSession):
        found = rows.select(vector).mapInArrow(gather, "i int, y array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(k)]).alias("y")).collect()
    out = np.array([r["y"] for r in sorted(found, key=lambda r: r["i"])]) / model.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding", error: float | None = None) -> DataFrame:
    """A row for each vector and component; ``error`` goes into ``identity_error``."""
    kind = rows.schema[key].dataType.simpleString()
    k, dim, explained = len(model.values), len(model.sums), model.explained

    def project(batches):
        for part, places, x in _batches(batches, 1, dim):
            u = numerators(x, model.n, model.sums)
            dev = deviations(u)
            dev = pa.array([v if abs(v) < 1 << 63 else None for v in dev.tolist()], pa.int64()) if dev.dtype == object else pa.array(dev)
            m = len(places)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(places)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    dev.take(each),
                    pa.array(_whitened(u, model).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, np.nan if error is None else error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, vector).mapInArrow(project, f"`{key}` {kind}, {SCHEMA}")


def whiten_all(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """Fit on all rows, measure, and whiten all rows."""
    model = fit(rows, vector, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, {SCHEMA}")
    return whiten(rows, model, key, vector, identity_error(rows, model, vector))
