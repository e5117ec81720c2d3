"""Embedding whitening: exact integer scatter, cyclic Jacobi rotations, projection on unit components.

1. Every usable vector becomes integers, floor(scale * entry). The fit list is each distinct integer vector once (combined on
   the map side, so a vector that a third of all rows share is one row per task).
2. Tasks sum the fit list per dimension, then the products of entries that are centred before they are multiplied: the
   nearest integers below the means are taken off, which keeps every product an exact integer. Sums of integers
   don't depend on order, so reruns and retried tasks agree to the last bit. The remainders of the means (under one)
   are taken off the summed products, again exactly; one division gives each covariance correctly rounded.
3. The driver holds one dimension x dimension matrix and turns it by cyclic Jacobi rotations (every pair of axes once per sweep, in
   rounds of disjoint pairs) until the off-diagonals vanish, then sorts the eigenvalues. Only means and the
   wanted components go to the tasks.
4. Rows are projected; the covariance of the projections over the fit list is summed in a pass of its own, and its largest
   difference from the identity is reported.

Results for odd input: rows whose vector is null, or holds a null or non-finite entry, or one beyond 2^53 / scale, are left out; the dimension is
the commonest length among the others (of equally common ones the greater), and rows of other lengths, empty vectors among them, are
left out as well; null ids and repeated rows take part, each for itself; with fewer dimensions than components
there are as many components as dimensions; a component without variance (relative to the largest under 1e-13)
has null ``whitened`` values; a deviation of 39 digits or more is null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.scratch import materialize

SCALE = 256
COMPONENTS = 4
SWEEPS = 60
#: Sums of integers whose absolute values add up to less than this are exact in doubles.
EXACT = float(1 << 53)
_BATCH = 4096
_WIDE, _WIDEST = Context(prec=38), 10**38


@dataclass
class Whitening:
    n: int  # vectors of the fit list
    sums: list[int]  # per dimension, over the fit list
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # a unit column per component
    trace: float
    identity_error: float | None = None

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): the integer form of every usable vector, all of one length (module docstring)."""
    entry = F.col(vector_col).cast("array<double>")
    limit = EXACT / scale
    # NaN sorts above every number, so both comparisons turn non-finite entries away.
    whole = F.forall(entry, lambda c: c.isNotNull() & (c < limit) & (c > -limit))
    x = F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole).select(F.col(id_col).alias("id"), x.alias("x"))


def commonest_length(rows: DataFrame) -> int | None:
    counts = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", "d")).alias("b")).first()["b"]
    return None if best is None else best["d"]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, _BATCH):
            batch = whole.slice(start, _BATCH)
            yield batch, batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y for integers, exactly: in doubles where no sum can reach 2^53, else in Python's integers."""
    top = float(np.abs(y).max(initial=0))
    if top * top * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _summed(fit: DataFrame, dim: int, width: int, partial) -> dict[tuple[int, int], int]:
    """Exact sums of what ``partial`` (block -> object array of ``width`` columns) gives, one array a task, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, dim):
            part = partial(x)
            total = part if total is None else total + part
        if total is None:
            return
        for i, row in enumerate(total):
            # A symmetric matrix is sent from its diagonal on.
            first = i if width > 1 else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (width - first), pa.int32()), pa.array(range(first, width), pa.int32()), pa.array([Decimal(int(v)) for v in row[first:]], pa.decimal128(38, 0))],
                names=["i", "j", "v"],
            )

    sums = fit.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}  # dimension squared, whatever the rows


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep meets every pair of axes once, in rounds of disjoint pairs (a round-robin tournament), whose rotations are
    applied together. An element is left alone once it is lost beside both its diagonals.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors = np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            live = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq))
            if live.any():
                turned = True
                p, q, off, app, aqq = p[live], q[live], off[live], app[live], aqq[live]
                tau = (aqq - app) / (2 * off)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = t * c
                left, right = a[:, p].copy(), a[:, q]
                a[:, p], a[:, q] = c * left - s * right, s * left + c * right
                left, right = a[p].copy(), a[q]
                a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = app - t * off, aqq + t * off
                left, right = vectors[:, p].copy(), vectors[:, q]
                vectors[:, p], vectors[:, q] = c * left - s * right, s * left + c * right
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order].copy(), vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)


def fit_whitening(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (x: integers, all of length ``dim``); None without any."""
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if not n:
        return None
    per_dim = _summed(fit, dim, 1, lambda x: x.sum(axis=0, dtype=object).reshape(-1, 1))
    sums = [per_dim[i, 0] for i in range(dim)]
    base = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    products = _summed(fit, dim, dim, lambda x: exact_products(x - base))
    covariance = np.zeros((dim, dim))
    for (i, j), v in products.items():
        covariance[i, j] = covariance[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    values, vectors = jacobi(covariance)
    model = Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(covariance)))
    model.identity_error = _identity_error(fit, dim, model)
    return model


def _live(model: Whitening) -> np.ndarray:
    return model.eigenvalues > 1e-13 * max(float(model.eigenvalues[0]), 0.0)


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    live = _live(model)
    scale = np.where(live, 1 / np.sqrt(np.where(live, model.eigenvalues, 1.0)), np.nan)
    centred, out = x - model.means, np.zeros((len(x), model.components.shape[1]))
    for column, axis in zip(centred.T, model.components, strict=True):
        # Added up dimension by dimension: the order in a library's product would depend on how many rows a batch has.
        out += column[:, None] * axis
    return out * scale


def _identity_error(fit: DataFrame, dim: int, model: Whitening) -> float | None:
    """The largest difference between the covariance of the projections over the fit list and the identity."""
    live = np.flatnonzero(_live(model))
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live) + 1))
        for _, x in _blocks(batches, dim):
            z = _projected(model, x)[:, live]
            total += np.column_stack([z.T @ z, z.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((len(live), len(live) + 1))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"] / model.n
    covariance = total[:, :-1] - np.outer(total[:, -1], total[:, -1])
    return float(np.abs(covariance - np.eye(len(live))).max())


def deviations(model: Whitening, x: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - sum)^2 for every row, exactly."""
    bound = float(model.n) * float(np.abs(x).max(initial=0)) + max(abs(float(s)) for s in model.sums)
    if bound * bound * x.shape[1] < float(1 << 62):
        y = x * model.n - np.array(model.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * model.n - np.array(model.sums, object)
    return (y * y).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: id, n, deviation, whitened and explained (an entry per component), identity_error."""
    rows = usable_vectors(vectors, id_col, vector_col, scale)
    dim = commonest_length(rows)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    model = None
    if dim is not None:
        rows = rows.filter(F.size("x") == dim)
        model = fit_whitening(rows, dim, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    explained = (model.eigenvalues / model.trace if model.trace > 0 else np.zeros(len(model.eigenvalues))).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dim):
            z = _projected(model, x)
            arrays = [
                batch.column(batch.schema.get_field_index("id")),
                pa.array([model.n] * len(x), pa.int64()),
                pa.array([_WIDE.create_decimal(v) if v < _WIDEST else None for v in deviations(model, x)], pa.decimal128(38, 0)),
                pa.FixedSizeListArray.from_arrays(pa.array(z.ravel(), from_pandas=True), z.shape[1]).cast(pa.list_(pa.float64())),
                pa.array([explained] * len(x), pa.list_(pa.float64())),
                pa.array([model.identity_error] * len(x), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained"))
    opened = whitened.select(id_col, "n", "deviation", "identity_error", pairs.alias("place", "c"))
    return opened.select(
        id_col, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )

