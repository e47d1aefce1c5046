"""Clustering by Yinyang rounds: bounds of groups of centres spare most distances, the result is Lloyd's.

The centres are put into groups once. A vector keeps an upper bound of the distance to its
own centre and a lower bound for each group of the distance to any other centre in it.
When centres move, the bounds give way by as much. A vector whose upper bound stays under all
lower bounds is left alone (global filter); else its own distance is told exactly, and
only groups whose bound it reaches (group filter), and in these only centres that did
not move away from it too far (local filter), are compared exactly. A filter needs
a bound that is really greater, so ties are always compared and go to the lesser centre.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.lloyd import NEAR, Rounds, blocks, changes, floored, mapped, packed, scaled, squared, summed, unpacked, whole

STATE = "ids array<long>, points binary, own binary, upper binary, lower binary, moved binary, spread binary, compared long"


@dataclass
class Clustering:
    """``rows``: ``vec_id, cluster, distance``; the centres; what each cluster's squared distances sum up to; exact distances of each round."""

    rows: DataFrame
    centres: np.ndarray
    spread: list[int]
    compared: list[int]


def groups_of(centres: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """The centres in groups of neighbours, by a few rounds of Lloyd over the centres themselves; none is empty."""
    mean = centres[: max(1, min(groups, len(centres)))].astype(float)
    for _ in range(rounds):
        own = ((centres[:, None, :] - mean[None]) ** 2).sum(2).argmin(1)
        mean = np.array([centres[own == g].mean(0) if (own == g).any() else m for g, m in enumerate(mean)])
    return [np.flatnonzero(own == g) for g in range(len(mean)) if (own == g).any()]


class Yinyang:
    """The centres of a round, how far they moved to get there, and what becomes of a block of vectors with them."""

    def __init__(self, centres: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None = None):
        self.centres, self.groups = centres, groups
        self.group_of = np.empty(len(centres), int)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        self.drift = np.sqrt(squared(centres, before).astype(float)) if before is not None else None

    def first(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Assignment, upper and lower bounds of vectors of which nothing is known, and the number of distances."""
        exact = np.column_stack([squared(points, c) for c in self.centres])
        own = exact.argmin(1)
        rest = exact.astype(float)
        rest[np.arange(len(own)), own] = np.inf
        lower = np.column_stack([rest[:, g].min(1) for g in self.groups])
        return own, np.sqrt(exact[np.arange(len(own)), own]), np.sqrt(lower), exact.size

    def next(self, points: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the centres moved."""
        own, upper, kept = own.copy(), upper + self.drift[own], lower
        lower = np.column_stack([kept[:, g] - self.drift[members].max() for g, members in enumerate(self.groups)])

        def sure(bound: np.ndarray, reach: np.ndarray) -> np.ndarray:
            return bound > reach + NEAR * (1 + reach)

        rows = np.flatnonzero(~sure(lower.min(1), upper))
        mine = squared(points[rows], self.centres[own[rows]])
        upper[rows] = np.sqrt(mine)
        compared = len(rows)
        left = ~sure(lower[rows].min(1), upper[rows])
        rows, mine = rows[left], mine[left]
        # Exact distances of what is compared, and a bound of the distance of what is not.
        best, winner, start, told = mine.copy(), own[rows].copy(), own[rows], []
        for g, members in enumerate(self.groups):
            here = np.flatnonzero(~sure(lower[rows, g], upper[rows]))
            low = np.full(len(here), np.inf)
            seen: list[tuple[int, np.ndarray, np.ndarray]] = []
            for c in members:
                other = start[here] != c
                away = kept[rows[here], g] - self.drift[c]
                near = other & ~sure(away, upper[rows[here]])
                low = np.where(other & ~near, np.minimum(low, away), low)
                at = here[near]
                got = squared(points[rows[at]], self.centres[c])
                compared += len(at)
                seen.append((c, at, got))
                better = (got < best[at]) | ((got == best[at]) & (c < winner[at]))
                best[at[better]], winner[at[better]] = got[better], c
            # The two least that were seen or spared of the group: its bound is the second where the first wins.
            bound = np.full(len(rows), np.inf)
            bound[here] = low
            second, nearest = bound.copy(), np.full(len(rows), -1)
            for c, at, got in seen:
                d = np.sqrt(got)
                less = d < bound[at]
                second[at] = np.where(less, bound[at], np.minimum(second[at], d))
                nearest[at[less]] = c
                bound[at] = np.minimum(bound[at], d)
            told.append((g, here, bound[here], second[here], nearest[here]))
        for g, here, bound, second, nearest in told:
            lower[rows[here], g] = np.where(nearest == winner[here], second, bound)
        changed = winner != start
        # The centre that is left counts for its group from now on.
        g = self.group_of[start[changed]]
        lower[rows[changed], g] = np.minimum(lower[rows[changed], g], np.sqrt(mine[changed]))
        upper[rows], own[rows] = np.sqrt(best), winner
        return own, upper, lower, compared


def yinyang(vectors: DataFrame, seeds: DataFrame, rounds: int = 3, groups: int = 4, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering | None:
    """Clusters of vectors of ``dim`` whole components (floors of ``scale`` times x) around as many centres as there are seeds.

    ``seeds`` has the vectors that the centres start as, in their order. Each round assigns
    all vectors and moves each centre to the floors of its vectors' means, by exact sums;
    a centre of none stays; at last vectors are assigned once more. Vectors that are
    null, of another length, or hold a null or what is not finite are left out; ids may
    repeat and be null, other columns are ignored; repeated vectors count each. Without any seed there is no
    result. A component beyond 2**27 is an error. Centres are on the driver and in each task, 2**22 numbers at most.
    """
    vector = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(whole(F.col("vector"), dim))
    first = seeds.select(vector.alias("vector")).collect()  # the centres
    if not first:
        return None
    centres = scaled(np.array([r["vector"] for r in first], float), scale)
    k, sets, tables = len(centres), groups_of(centres, groups), Rounds(vectors)
    plan = Yinyang(centres, sets)

    def row(ids, points: np.ndarray, before: np.ndarray | None, found: tuple, plan: Yinyang, last: bool) -> dict:
        own, upper, lower, compared = found
        spread = np.zeros(k, np.int64)
        if last:
            np.add.at(spread, own, squared(points, plan.centres[own]))
        return {
            "ids": ids, "points": packed(points), "own": packed(own), "upper": upper.tobytes(), "lower": lower.tobytes(),
            "moved": packed(changes(points, before, own, k)), "spread": packed(spread), "compared": compared,
        }

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in blocks(batches, dim, scale):
            yield pa.RecordBatch.from_pylist([row(part.column(0).to_pylist(), points, None, plan.first(points), plan, not rounds)], _ARROW)

    state = tables.store(kept.mapInArrow(begin, STATE))
    sums = np.zeros((k, dim + 1), object)
    compared = [state.agg(F.sum("compared")).first()[0] or 0]
    for r in range(rounds):
        sums = sums + summed(state, "moved", k * (dim + 1)).reshape(k, dim + 1)
        moved = floored(sums[:, :dim], sums[:, dim], centres)
        plan = Yinyang(moved, sets, centres)
        centres = moved

        def step(x: dict, plan: Yinyang = plan, last: bool = r == rounds - 1) -> dict:
            own = unpacked(x["own"])
            points = unpacked(x["points"]).reshape(len(own), dim)
            upper, lower = np.frombuffer(x["upper"]), np.frombuffer(x["lower"]).reshape(len(own), len(plan.groups))
            return row(x["ids"], points, own, plan.next(points, own, upper, lower), plan, last)

        state = tables.store(mapped(state, step, STATE))
        compared.append(state.agg(F.sum("compared")).first()[0] or 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, p, o in zip(*(batch.column(c).to_pylist() for c in ("ids", "points", "own")), strict=True):
                own = unpacked(o)
                far = squared(unpacked(p).reshape(len(own), dim), centres[own])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = state.select("ids", "points", "own").mapInArrow(told, "vec_id long, cluster int, distance long")
    return Clustering(rows, centres, [int(x) for x in summed(state, "spread", k)], compared)


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("points", "own", "upper", "lower", "moved", "spread")), ("compared", pa.int64())])


def hashed_seeds(vectors: DataFrame, k: int = 16, seed: int = 1, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors with the least hash of ``seed:id``, in this order; rows of one id in the order of their vectors, null ids last."""
    rows = vectors.where(whole(F.col(vector_col).cast("array<double>"), dim))
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), vector_col).limit(k)


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    got = yinyang(vectors, hashed_seeds(vectors))
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if got is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    told = [(c, s, sum(got.spread), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, (s, x) in enumerate(zip(got.spread, got.centres.tolist(), strict=True))]
    return got.rows.join(F.broadcast(spark.createDataFrame(told, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> str:
    """The query in DuckDB's SQL, each round by all distances."""
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p, sha256('1:' || vec_id) AS h FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, p FROM (SELECT * FROM v ORDER BY h LIMIT {k}))"""]
    distance = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(p) AS p, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.vec_id, v.p, c.c, {distance} AS d FROM v, c{r} c) GROUP BY vec_id)")
        if r < rounds:
            mean = "list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i)"
            parts.append(
                f"s{r} AS (SELECT c, {mean} AS p FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.p, c.p) AS p FROM c{r} c LEFT JOIN s{r} s ON c.c = s.c)"
            )
    return (
        ",\n  ".join(parts)
        + f"\nSELECT vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"
    )


OP12_SQL = _sql()
