"""Arrow lists as matrices, and sums of matrix rows over all partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 1 << 20  # list entries handled at a time


def finite_entries(vector: str) -> Column:
    """The vector is there and has only finite entries."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their lists as a matrix) for each length in a column without nulls, in
    stretches of bounded size; lists of length zero are left out."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        step = max(1, STRETCH // int(size))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, flat[starts[some][:, None] + np.arange(size)]


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def summed_rows(parts: DataFrame) -> DataFrame:
    """(dim, i, values array<double>): the values of equal (dim, i) added up entry by entry,
    streamed in sorted order, so a task holds one row of a matrix however many parts there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(key, total):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), list_array(total[None, :])], names=["dim", "i", "values"])

        own, total = None, None
        for batch in batches:
            rows = np.empty(batch.num_rows, object)
            for at, values in by_length(batch.column(2)):
                rows[at] = list(values)
            for dim, i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows, strict=True):
                if own != (dim, i):
                    if own is not None:
                        yield record(own, total)
                    own, total = (dim, i), np.zeros(len(values))
                total += values
        if own is not None:
            yield record(own, total)

    return parts.repartition("dim", "i").sortWithinPartitions("dim", "i").mapInArrow(add, "dim int, i int, values array<double>")
