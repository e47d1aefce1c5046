"""Vector codes by product quantisation; codebooks by Lloyd's rounds with heaps of slacks.

Vectors are cut into equal consecutive parts, and each part position has a codebook. In a
block of vectors there is a heap for each entry of each codebook. It holds the parts that
are assigned to the entry, keyed by the least that entries must drift until another one may
be as near: lower bound minus upper bound, plus what the entry had drifted when the key was
made. A round adds to each entry's drift how far it and the farthest other moved, pops
only the parts whose key the drift has reached, rescans these exactly and pushes them
with a new key; all others are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import settle, table
from textmill.llm.lloyd import NEAR, Rounds, blocks, changes, floored, mapped, packed, scaled, squared, summed, unpacked, whole

STATE = "ids array<long>, labels array<string>, points binary, own binary, keys binary, members binary, sizes binary, moved binary, rescanned long"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *((c, pa.binary()) for c in ("points", "own", "keys", "members", "sizes", "moved")), ("rescanned", pa.int64())])
#: Labels whose sums may be broadcast, the most frequent first; rows of others are joined by a shuffle.
MOST_LABELS = 100_000


@dataclass
class Codes:
    """``rows``: ``vec_id, label, code, error``, codebooks by part, entry and component, and the parts that each round rescanned."""

    rows: DataFrame
    codebooks: np.ndarray
    rescanned: list[int]


class HeapLloyd:
    """The codebooks of a round and the drift of their entries so far, and what becomes of a block of vectors with them."""

    def __init__(self, books: np.ndarray, drift: np.ndarray):
        self.books, self.drift = books, drift

    @classmethod
    def moved(cls, books: np.ndarray, before: HeapLloyd) -> HeapLloyd:
        """The drift grows by how far an entry moved and how far the farthest other of its codebook did."""
        far = np.sqrt(((books - before.books) ** 2).sum(2).astype(float))
        drift = before.drift.copy()
        for p, part in enumerate(far):
            for e in range(len(part)):
                drift[p, e] += part[e] + max((x for i, x in enumerate(part) if i != e), default=0.0)
        return cls(books, drift)

    def nearest(self, part: int, points: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """The nearest entry of each point, exactly, the lesser of equals, and the key of it in that entry's heap."""
        exact = np.column_stack([squared(points, c) for c in self.books[part]])
        at = np.arange(len(points))
        own = exact.argmin(1)
        upper, rest = np.sqrt(exact[at, own]), exact.astype(float)
        rest[at, own] = np.inf
        return own, (np.sqrt(rest.min(1)) - upper + self.drift[part][own]).tolist()

    def first(self, points: np.ndarray) -> tuple[np.ndarray, list[list[list]], int]:
        """Assignment and heaps of parts ``points[row, part]`` of which nothing is known, and the number of them."""
        n, parts, _ = points.shape
        own, heaps = np.empty((n, parts), np.int64), [[[] for _ in book] for book in self.books]
        for p in range(parts):
            own[:, p], keys = self.nearest(p, points[:, p])
            for e, key, row in zip(own[:, p].tolist(), keys, range(n), strict=True):
                heaps[p][e].append((key, row))
            for heap in heaps[p]:
                heapq.heapify(heap)
        return own, heaps, n * parts

    def next(self, points: np.ndarray, own: np.ndarray, heaps: list[list[list]]) -> tuple[np.ndarray, list[list[list]], int]:
        """The same after the entries moved."""
        own, count = own.copy(), 0
        for p, part in enumerate(heaps):
            violated = []
            for e, heap in enumerate(part):
                reached = self.drift[p, e] + NEAR * (1 + abs(self.drift[p, e]))
                while heap and heap[0][0] <= reached:
                    violated.append(heapq.heappop(heap)[1])
            if violated:
                own[violated, p], keys = self.nearest(p, points[violated, p])
                for e, key, row in zip(own[violated, p].tolist(), keys, violated, strict=True):
                    heapq.heappush(part[e], (key, row))
                count += len(violated)
        return own, heaps, count


def _stored(heaps: list[list[list]]) -> dict:
    """Heaps as arrays, in the order in which they are heaps."""
    every = [x for part in heaps for heap in part for x in heap]
    return {
        "keys": np.array([k for k, _ in every], float).tobytes(),
        "members": packed(np.array([r for _, r in every], np.int64)),
        "sizes": packed(np.array([[len(h) for h in part] for part in heaps], np.int64)),
    }


def _heaps(x: dict, parts: int) -> list[list[list]]:
    every = list(zip(np.frombuffer(x["keys"]).tolist(), unpacked(x["members"]).tolist(), strict=True))
    ends = np.cumsum(unpacked(x["sizes"]))
    cut = [every[e - n : e] for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
    each = len(cut) // parts
    return [cut[p * each : (p + 1) * each] for p in range(parts)]


def heap_lloyd(
    vectors: DataFrame, entries: int = 16, rounds: int = 6, parts: int = 8, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Codes | None:
    """Codes of vectors of whole components (floors of ``scale`` times x): an entry index for each of ``parts`` parts.

    A codebook starts as that part of the vectors with the least ids (null ids last, rows of one id in the
    order of their vectors). Each round assigns every part and moves each entry to the
    floors of its parts' means, by exact sums; an unused one stays; at last parts are
    assigned again. Vectors that are null or hold a null or what is not finite are left
    out. The length is that of the vector with the least id whose length ``parts`` divides;
    vectors of another length can't be cut and have a null code and error. Ids and labels may repeat
    and be null; a label is returned as a string. Without any vector there is no result. A component beyond 2**27 is an
    error. Codebooks are on the driver and in each task, 2**22 numbers at most.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    kept = kept.where(whole(F.col("vector")))
    fit = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    one = fit.select(F.size("vector").alias("n")).first()
    if one is None:
        return None
    dim = one["n"]
    wide = dim // parts
    first = fit.where(F.size("vector") == dim).limit(entries).select("vector").collect()  # the codebooks
    start = scaled(np.array([r["vector"] for r in first], float), scale).reshape(-1, parts, wide).swapaxes(0, 1)
    k, tables = start.shape[1], Rounds(vectors)
    plan = HeapLloyd(start, np.zeros((parts, k)))

    def row(x: dict, points: np.ndarray, before: np.ndarray | None, found: tuple) -> dict:
        own, heaps, count = found
        moved = [changes(points[:, p], None if before is None else before[:, p], own[:, p], k) for p in range(parts)]
        return {"ids": x["ids"], "labels": x["labels"], "points": packed(points), "own": packed(own), **_stored(heaps), "moved": packed(np.array(moved)), "rescanned": count}

    def begin(batches: Iterator[pa.RecordBatch], plan: HeapLloyd = plan) -> Iterator[pa.RecordBatch]:
        for part, points in blocks(batches, dim, scale):
            points = points.reshape(-1, parts, wide)
            x = {"ids": part.column(0).to_pylist(), "labels": part.column(2).to_pylist()}
            yield pa.RecordBatch.from_pylist([row(x, points, None, plan.first(points))], _ARROW)

    def step(x: dict, plan: HeapLloyd) -> dict:
        points = unpacked(x["points"]).reshape(-1, parts, wide)
        own = unpacked(x["own"]).reshape(-1, parts)
        return row(x, points, own, plan.next(points, own, _heaps(x, parts)))

    state = tables.store(kept.where(F.size("vector") == dim).mapInArrow(begin, STATE))
    sums = np.zeros((parts, k, wide + 1), object)
    rescanned = [state.agg(F.sum("rescanned")).first()[0]]
    for _ in range(rounds):
        sums = sums + summed(state, "moved", sums.size).reshape(sums.shape)
        books = np.array([floored(s[:, :wide], s[:, wide], old) for s, old in zip(sums, plan.books, strict=True)], np.int64)
        plan = HeapLloyd.moved(books, plan)
        state = tables.store(mapped(state, lambda x, plan=plan: step(x, plan), STATE))
        rescanned.append(state.agg(F.sum("rescanned")).first()[0])
    books = plan.books

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, p, o in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "points", "own")), strict=True):
                points, own = unpacked(p).reshape(-1, parts, wide), unpacked(o).reshape(-1, parts)
                error = sum(squared(points[:, q], books[q][own[:, q]]) for q in range(parts))
                code = ["".join(f"{e:02x}" for e in x) for x in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    rows = state.select("ids", "labels", "points", "own").mapInArrow(told, "vec_id long, label string, code string, error long")
    uncut = kept.where(F.size("vector") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(settle(rows.unionByName(uncut)), books, rescanned)


def with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` of ``label, error`` at least with ``label_error``, the sum of the errors of its label; null labels are one.

    Sums of the ``MOST_LABELS`` commonest labels are broadcast, so that a label of a third
    of all rows is not sent to one task; rows of rarer ones are joined by a shuffle.
    """
    rows = rows.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))})
    sums = settle(rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    keys = ["_none", "_label"]
    if sums.count() <= MOST_LABELS:
        return rows.join(F.broadcast(sums.drop("_n")), keys).drop(*keys)
    common = settle(sums.orderBy(F.desc("_n"), *keys).limit(MOST_LABELS).drop("_n"))
    many = rows.join(F.broadcast(common), keys)
    few = rows.join(F.broadcast(common.select(keys)), keys, "left_anti").join(sums.drop("_n"), keys)
    return many.unionByName(few).drop(*keys)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    got = heap_lloyd(table(spark, sf_dir, "embeddings"))
    if got is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, got.codebooks.ravel().tolist())).encode()).hexdigest()
    return with_label_sums(got.rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(k: int = 16, rounds: int = 6, parts: int = 8, scale: int = 4096) -> str:
    """The query in DuckDB's SQL, each round by all distances."""
    out = [f"""WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  v AS MATERIALIZED (SELECT vec_id, label, q, list_slice(p, q * (len(p) // {parts}) + 1, (q + 1) * (len(p) // {parts})) AS p FROM e, (SELECT unnest(range({parts})) AS q)),
  c0 AS MATERIALIZED (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS c, p FROM v WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {k}))"""]
    distance = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, any_value(label) AS label, any_value(p) AS p, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.*, c.c, {distance} AS d FROM v JOIN c{r} c ON v.q = c.q) GROUP BY vec_id, q)")
        if r < rounds:
            out.append(
                f"s{r} AS (SELECT q, c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM (SELECT q, m.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT q, m, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY q, c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.q, c.c, coalesce(s.p, c.p) AS p FROM c{r} c LEFT JOIN s{r} s ON c.c = s.c AND c.q = s.q)"
            )
    return (
        ",\n  ".join(out)
        + f""",
  t AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', m.c)), '' ORDER BY q) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
  w AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY q, c, i)) AS codebooks_sha256 FROM (SELECT q, c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM t, w"""
    )


OP13_SQL = _sql()
