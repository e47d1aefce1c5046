"""Connected components: in one task where the graph is small, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.session import settle


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of a graph and the least vertex that each reaches: labels sink along edges and paths are halved."""
    vertex, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(vertex))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        while (short := new[new]).sum() != new.sum():
            new = short
        if (new == label).all():
            return vertex, vertex[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    vertex, label = least_labels(*(table.column(c).to_numpy().astype(np.int64) for c in "uv"))
    other = vertex != label
    yield pa.RecordBatch.from_arrays([pa.array(vertex[other]), pa.array(label[other])], names=["vertex", "label"])


def connected_components(edges: DataFrame, rounds: int = 60, share: int = 50_000, one_task: int = 1_000_000) -> DataFrame:
    """Label each vertex of an undirected graph with the least vertex it reaches.

    ``edges`` has columns ``u`` and ``v`` (long). Returns ``vertex, label`` for
    vertices that reach a lesser one; loops and edges with a null are
    ignored, repeated edges count once, no edge gives an empty result.

    A graph of ``one_task`` edges at most (16 MB) is labelled in one task, which
    spares it the jobs of the rounds. Of a larger one, each round rewires every vertex
    to the least vertex it knows; the number of rounds grows with the logarithm of the
    longest path, and nothing but two numbers a round comes to the driver. The tasks of
    a round follow the number of edges, ``share`` each.
    """
    now = settle(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    size = now.count()
    if size <= one_task:
        return settle(now.coalesce(1).mapInArrow(_in_one_task, "vertex long, label long"))
    parts = size // share + 1
    seen = None
    for _ in range(rounds):
        now = now.coalesce(parts)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).coalesce(parts)
        now = settle(small.union(least.select("u", F.col("m"))).where("u <> v").distinct().coalesce(parts))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
