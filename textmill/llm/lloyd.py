"""What the operators that run Lloyd's rounds share: blocks of vectors, exact sums, a stored table a round.

The state of a round is a table with a row for each block of vectors: the vectors as a
packed matrix of whole numbers, what is known of each (assignment, bounds), and what the
round changed in the sums of its centres. A round reads the table of the last one and
writes the next, batch by batch and without a shuffle; only the changes of the sums,
a few numbers a task, are added up. Tables lie in the shared folder, so a lost executor
costs its tasks and no round is computed again; the table before the last is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import pack, unpack
from textmill.session import Rounds

__all__ = ["NEAR", "Rounds", "blocks", "changes", "floored", "mapped", "packed", "scaled", "squared", "summed", "unpacked", "whole"]

#: Vectors of a block; the largest whole number of a component, so that sums of squares fit 64 bits.
BLOCK, LARGEST = 4096, 1 << 27
#: Numbers that the centres may have: they are on the driver and in every task.
MOST_NUMBERS = 1 << 22
#: Bounds are kept as floating point: a bound must be passed by so much before it is trusted.
NEAR = 1e-9


def whole(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, has ``dim`` components if that is given, and none of them is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine if dim is None else fine & (F.size(vector) == dim), F.lit(False))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """The floors of ``scale`` times the components, as whole numbers."""
    out = np.floor(values.astype(np.float64) * scale)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit 64 bits")
    return out.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of ``size`` rows of batches whose second column are whole vectors, and their matrices."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            yield part, scaled(part.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, exactly, of points to one centre or to one each."""
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def floored(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The floors of the means, of Python's whole numbers; a centre of nothing stays."""
    return np.array([[int(s) // int(n) for s in row] if n else list(old) for row, n, old in zip(sums, counts, before, strict=True)], np.int64).reshape(before.shape)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, compressed."""
    least = np.min_scalar_type(int(np.abs(values).max()) * -2 - 1) if values.size else np.dtype(np.int8)
    return bytes([least.itemsize]) + pack(values.astype(least).ravel())


def unpacked(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], np.dtype(f"i{blob[0]}")).astype(np.int64)


def summed(state: DataFrame, column: str, cells: int) -> np.ndarray:
    """The sum over all blocks of a packed array of ``cells`` numbers: partial sums in each task, then in decimals, which are exact."""
    if cells > MOST_NUMBERS:
        raise ValueError(f"{cells} numbers are more than {MOST_NUMBERS}, which bounds what the driver holds of the centres")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += unpacked(blob)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    parts = state.select(column).mapInArrow(run, "cell long, n long")
    out = np.zeros(cells, object)
    for row in parts.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():  # ``cells`` rows at most
        out[row["cell"]] = int(row["n"])
    return out


def changes(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray:
    """What an assignment changes: for each centre the sum of its points and their number, against the assignment before."""
    out = np.zeros((k, points.shape[1] + 1), np.int64)
    moved = slice(None) if before is None else np.flatnonzero(before != after)
    ones = np.column_stack([points[moved], np.ones(len(after[moved]), np.int64)])
    np.add.at(out, after[moved], ones)
    if before is not None:
        np.subtract.at(out, before[moved], ones)
    return out


def mapped(state: DataFrame, step: Callable[[dict], dict], schema: str) -> DataFrame:
    """A step for each block: from its row to its next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([step(batch.slice(k, 1).to_pylist()[0])], batch.schema)

    return state.mapInArrow(run, schema)
