"""Whitening of vectors by the leading components of their covariance.

Entries become whole numbers, so equal vectors are exactly equal and sums are exact. The
fit goes over each distinct vector once. Sums are added per partition; the covariance is
centred before multiplying, one matrix per partition, and matrices are added row by row in
a sorted stream. Only sums, one matrix and its eigenvectors reach the driver: their size
follows the vectors' length, not their number. Eigenpairs come from ``eigen``. The
components are then sent to every task, which projects its rows.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, and
so are those without entries, which have no component. Vectors of different length are
fitted apart. Entries beyond ``REACH`` in size count as that. Components whose eigenvalue
is below ``LEAST`` of the largest are noise of rounding and are left out; where all vectors
are equal none is left and no row is returned. ``deviation`` is null where it exceeds a
long. Rows that share an id keep a set of rows each, null ids stay, other columns are not
looked at, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eigen import leading_pairs
from .matrices import by_length, finite_entries, list_array, summed_rows
from .tables import stored

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000
REACH = float(1 << 61)
LEAST = 1e-11


def _moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(vectors, exact sum of each entry) for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in by_length(batch.column(0)):
                n, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                found[x.shape[1]] = (n + len(rows), [s + (h << 32) + w for s, h, w in zip(sums, high, low, strict=True)])
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                names=["dim", "i", "n", "s"],
            )

    parts = fit.mapInArrow(run, "dim int, i int, n long, s decimal(38,0)")
    total = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s")).orderBy("dim", "i").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total:
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; whole numbers of any size where 64 bits are too few."""
    widest = max(int(x.max()), -int(x.min()), *map(abs, sums))
    if n * widest + max(map(abs, sums)) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(y: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; none beyond a long."""
    widest = max(int(y.max()), -int(y.min()))
    if y.dtype != object and widest**2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(axis=1)]


def _products(fit: DataFrame, moments: dict, projections: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Covariance for each length; of projected vectors, if projections are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                dim = x.shape[1]
                centred = deviations(x, *moments[dim]).astype(float) / moments[dim][0]
                if projections is not None:
                    centred = centred @ projections[dim].T
                found[dim] = found.get(dim, 0) + centred.T @ centred
        for dim, product in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(product), pa.int32()), pa.array(range(len(product)), pa.int32()), list_array(product)], names=["dim", "i", "values"]
            )

    rows = summed_rows(fit.mapInArrow(run, "dim int, i int, values array<double>")).orderBy("dim", "i").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dim, []).append(r["values"])
    return {dim: np.array(values) / moments[dim][0] for dim, values in out.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(REACH)), F.lit(-REACH))).cast("long") + OFFSET)
    rows = rows.filter(finite_entries("v") & (F.size("v") > 0)).select("vec_id", whole.alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    moments = _moments(fit)
    covariances = _products(fit, moments)
    shares, projections = {}, {}
    for dim, covariance in covariances.items():
        values, units = leading_pairs((covariance + covariance.T) / 2, components)
        kept = values > LEAST * max(values[0], 0)
        shares[dim] = values[kept] / np.trace(covariance) if kept.any() else values[:0]
        projections[dim] = units[kept] / np.sqrt(values[kept])[:, None]
    projections = {dim: p for dim, p in projections.items() if len(p)}
    whitened = _products(fit.filter(F.size("x").isin(list(projections))), moments, projections)
    error = max([float(np.abs(c - np.eye(len(c))).max()) for c in whitened.values()], default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                dim = x.shape[1]
                if dim not in projections:
                    continue
                (n, sums), r = moments[dim], len(projections[dim])
                y = deviations(x, n, sums)
                white = (y.astype(float) / n) @ projections[dim].T
                each = np.repeat(np.arange(len(at)), r)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), n)),
                        pa.array(square_sums(y), pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(shares[dim], len(at))), pa.array(np.full(len(each), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
