"""A frequency sketch that is merged across tasks, and exact counts of what it lets through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a sketch and the cells of each, a power of two; cells that are added up as one row.
DEPTH, WIDTH, SLICE = 4, 1 << 20, 1 << 16
#: Odd multipliers of the rows. Fixed values.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _cells(hashes: np.ndarray, depth: int, width: int) -> np.ndarray:
    """For each row of the sketch the cells of some 64-bit hashes: the upper bits of their products."""
    x = hashes.view(np.uint64)
    x = x ^ (x >> np.uint64(33))
    return ((x[None] * _ODD[:depth, None]) >> np.uint64(65 - width.bit_length())).astype(np.int64)


class Sketch:
    """Counts that are never too low (Count-Min): the least of an item's cells.

    Of n items in all, an estimate exceeds the count by ``e * n / width`` with a chance
    of ``exp(-depth)`` at most. Sketches of the same shape are added cell by cell.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = _cells(hashes, *self.cells.shape)
        return np.take_along_axis(self.cells, at, 1).min(0)

    @property
    def items(self) -> int:
        return int(self.cells[0].sum())

    @property
    def error(self) -> float:
        """What an estimate exceeds the count by in all but ``exp(-depth)`` of cases, at most."""
        return float(np.e * self.items / self.cells.shape[1])


def sketch(items: DataFrame, column: str, depth: int = DEPTH, width: int = WIDTH) -> Sketch:
    """The sketch of a column's 64-bit hashes: one a task, added up in slices of cells, so no task adds more than a slice of all.

    It is ``8 * depth * width`` bytes on the driver, 32 MB by default. A null is an item like any other.
    """
    if not 1 <= depth <= len(_ODD) or width & (width - 1) or width < 2:
        raise ValueError(f"a sketch has 1 to {len(_ODD)} rows and a power of two of cells")
    step = min(SLICE, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(depth * width, np.int64)
        for batch in batches:
            for r, at in enumerate(_cells(batch.column(0).to_numpy(zero_copy_only=False), depth, width)):
                cells[r * width : (r + 1) * width] += np.bincount(at, minlength=width)
        for k in range(0, depth * width, step):
            if (part := cells[k : k + step]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(blob, np.int64)
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])

    schema = "slice int, cells binary"
    parts = items.select(F.xxhash64(column).alias("h")).mapInArrow(run, schema)
    cells = np.zeros(depth * width, np.int64)
    for row in parts.repartition(depth * width // step, "slice").mapInArrow(added, schema).collect():  # the sketch
        cells[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["cells"], np.int64)
    return Sketch(cells.reshape(depth, width))


def frequent(items: DataFrame, column: str, least: int, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``column, n``: the exact counts of the items that occur ``least`` times or more.

    A first pass makes the sketch; a second drops what it holds for rarer and counts the
    rest. No item is lost, since estimates are never too low, and most rare ones, the
    bulk of distinct items, are never shuffled. Only hashes go to Python. ``items`` is read twice.
    """
    if least <= 1:
        return items.groupBy(column).agg(F.count("*").alias("n"))
    found = sketch(items, column, depth, width)
    sent = items.sparkSession.sparkContext.broadcast(np.packbits(found.cells >= least, axis=1))  # a bit for each cell

    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = sent.value
        for hashes in batches:
            keep = np.ones(len(hashes), bool)
            for row, at in zip(bits, _cells(hashes.to_numpy(zero_copy_only=False), depth, width), strict=True):
                keep &= (row[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            yield pa.array(keep)

    keep: Column = F.arrow_udf(_typed(passes), "boolean")(F.xxhash64(column))
    return items.where(keep).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _typed(run):
    """Type hints by which Spark knows an iterator of Arrow arrays, as types and not as text."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
