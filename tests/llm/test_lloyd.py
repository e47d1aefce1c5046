"""Clustering and vector codes: bounds and heaps against all distances, odd rows, exact means."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Row

from textmill.llm import centroid_clustering as cc
from textmill.llm import lloyd
from textmill.llm import vector_codes as vc


def brute(points, centres, rounds):
    """Lloyd's rounds with all distances in Python's whole numbers."""
    points, centres = [list(map(int, p)) for p in points], [list(map(int, c)) for c in centres]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres] for p in points]
        own = [d.index(min(d)) for d in far]
        if r < rounds:
            for c in range(len(centres)):
                of = [p for p, o in zip(points, own, strict=True) if o == c]
                if of:
                    centres[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return own, [min(d) for d in far], centres


def draws(seed, n, dim, values, blobs=0):
    rng = np.random.default_rng(seed)
    if blobs:
        middle = rng.integers(-200, 200, (blobs, dim))
        return middle[rng.integers(0, blobs, n)] + rng.integers(-3, 4, (n, dim))
    return rng.integers(-values, values + 1, (n, dim))


@pytest.mark.parametrize("seed,values,groups", [(0, 1, 4), (1, 2, 3), (2, 40, 4), (3, 1, 1), (4, 3, 8)])
def test_yinyang_filters(seed, values, groups):
    """Few values make ties: the bounds change nothing in any round, whatever the groups."""
    points = draws(seed, 300, 4, values)
    centres = points[:9].copy()
    sets = cc.groups_of(centres, groups)
    assert sorted(np.concatenate(sets).tolist()) == list(range(9))
    plan = cc.Yinyang(centres, sets)
    own, upper, lower, _ = plan.first(points)
    for r in range(1, 9):
        new = lloyd.floored(lloyd.changes(points, None, own, 9)[:, :4].astype(object), lloyd.changes(points, None, own, 9)[:, 4], plan.centres)
        plan = cc.Yinyang(new, sets, plan.centres)
        own, upper, lower, _ = plan.next(points, own, upper, lower)
        want, _, at = brute(points, centres, r)
        assert own.tolist() == want and new.tolist() == at
        exact = np.sqrt(((points[:, None] - new[None]) ** 2).sum(2))
        assert (upper + 1e-6 >= exact[np.arange(300), own]).all()
        exact[np.arange(300), own] = np.inf
        assert (lower <= np.column_stack([exact[:, g].min(1) for g in sets]) + 1e-6).all()


def test_yinyang_spares_distances(spark):
    """In data with clusters most distances are never told."""
    rows = [Row(vec_id=i, embedding=[float(x) for x in p]) for i, p in enumerate(draws(5, 2000, 8, 0, blobs=16))]
    df = spark.createDataFrame(rows)
    got = cc.yinyang(df, cc.hashed_seeds(df, dim=8), rounds=6, scale=1, dim=8)
    own, far, centres = brute([r.embedding for r in rows], [r.embedding for r in cc.hashed_seeds(df, dim=8).collect()], 6)
    found = {r.vec_id: (r.cluster, r.distance) for r in got.rows.collect()}
    assert [found[i] for i in range(2000)] == list(zip(own, far, strict=True))
    assert got.centres.tolist() == centres and sum(got.spread) == sum(far)
    assert got.compared[0] == 2000 * 16 and sum(got.compared[3:]) < 0.2 * 4 * 2000 * 16


@pytest.mark.parametrize("seed,values,blobs", [(0, 1, 0), (1, 30, 0), (2, 0, 5)])
def test_heaps(seed, values, blobs):
    points = draws(seed, 250, 6, values, blobs).reshape(250, 2, 3)
    start = points[:5].swapaxes(0, 1).copy()
    plan = vc.HeapLloyd(start, np.zeros((2, 5)))
    own, heaps, count = plan.first(points)
    assert count == 500
    counts = []
    for r in range(1, 8):
        books = np.array([lloyd.floored((x := lloyd.changes(points[:, p], None, own[:, p], 5))[:, :3].astype(object), x[:, 3], plan.books[p]) for p in range(2)])
        plan = vc.HeapLloyd.moved(books, plan)
        state = vc._stored(heaps)
        own, heaps, count = plan.next(points, own, vc._heaps(state, 2))
        counts.append(count)
        for p in range(2):
            want, _, at = brute(points[:, p], start[p], r)
            assert own[:, p].tolist() == want and books[p].tolist() == at
            assert sorted(row for h in heaps[p] for _, row in h) == list(range(250))
            assert all(own[row, p] == e for e, h in enumerate(heaps[p]) for _, row in h)
            for heap in heaps[p]:
                assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
    if blobs:
        assert counts[-1] < 100


def test_means_are_exact():
    assert lloyd.floored(np.array([[-7, 7]], object), np.array([2], object), np.zeros((1, 2), np.int64)).tolist() == [[-4, 3]]
    assert lloyd.floored(np.array([[0, 0]], object), np.array([0], object), np.array([[5, 6]])).tolist() == [[5, 6]]
    for values in ([], [0], [-128], [127, -129], [1 << 40, -(1 << 40)]):
        assert lloyd.unpacked(lloyd.packed(np.array(values, np.int64))).tolist() == values


NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls, what is not finite, other lengths, repeated and null ids, ties, clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64)], i % 3) for i in range(40)]
    rows += [(40, None, 1), (41, [], 1), (42, [0.1] * 63 + [None], 1), (43, [NAN] * 64, 2), (44, [INF] + [0.0] * 63, 2), (45, [0.5] * 63, 2), (46, [0.5] * 65, None)]
    rows += [(7, [0.25] * 64, None), (7, [0.25] * 64, None), (None, [0.125] * 64, 5), (None, [-0.125] * 64, 5), (47, [0.25] * 64, 0)]
    more = [(*r, "a", 1, "b", 2, "c") for r in rows]
    return spark.createDataFrame(more, "vec_id long, embedding array<float>, label int, cluster string, distance int, ids string, error int, code string").repartition(3)


def fit(rows, dim=64):
    return [r for r in rows if r.embedding is not None and len(r.embedding) == dim and all(x is not None and np.isfinite(x) for x in r.embedding)]


def test_clustering_odd(spark, vectors):
    kept = fit(vectors.collect())
    order = sorted((r for r in kept if r.vec_id is not None), key=lambda r: (hashlib.sha256(f"1:{r.vec_id}".encode()).hexdigest(), r.embedding))
    points = {id(r): np.floor(np.array(r.embedding) * 64) for r in kept}
    own, far, _ = brute([points[id(r)] for r in kept], [points[id(r)] for r in order[:16]], 3)
    got = cc.yinyang(vectors, cc.hashed_seeds(vectors))
    want = sorted(((-1 if r.vec_id is None else r.vec_id, c, d) for r, c, d in zip(kept, own, far, strict=True)))
    assert sorted(((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.rows.collect())) == want
    assert cc.yinyang(vectors.where("false"), cc.hashed_seeds(vectors.where("false"))) is None
    few = vectors.where("vec_id in (1, 2)")
    assert sorted(r.distance for r in cc.yinyang(few, cc.hashed_seeds(few)).rows.collect()) == [0, 0]


def test_codes_odd(spark, vectors):
    rows = vectors.collect()
    kept = [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    same = fit(rows)
    order = sorted(same, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.embedding))
    points = {id(r): np.floor(np.array(r.embedding) * 4096).reshape(8, 8) for r in same}
    code, error = [""] * len(same), [0] * len(same)
    for p in range(8):
        own, far, _ = brute([points[id(r)][p] for r in same], [points[id(r)][p] for r in order[:16]], 6)
        code, error = [c + f"{o:02x}" for c, o in zip(code, own, strict=True)], [e + f for e, f in zip(error, far, strict=True)]
    sums = {}
    for r, e in zip(same, error, strict=True):
        sums[r.label] = sums.get(r.label, 0) + e
    want = [(r.vec_id, c, e, sums[r.label]) for r, c, e in zip(same, code, error, strict=True)]
    want += [(r.vec_id, None, None, sums[r.label]) for r in kept if len(r.embedding) != 64]
    got = vc.with_label_sums(vc.heap_lloyd(vectors).rows)
    text = lambda rows: sorted(map(str, rows))
    assert text((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == text(want)
    assert vc.heap_lloyd(vectors.where("false")) is None and vc.heap_lloyd(vectors.where("vec_id in (40, 41)")) is None


def test_many_labels(spark, monkeypatch):
    """Labels beyond the bound of the broadcast have their sums too."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else str(i % 11), i) for i in range(200)], "vec_id int, label string, error long")
    monkeypatch.setattr(vc, "MOST_LABELS", 4)
    got = {r.vec_id: r.label_error for r in vc.with_label_sums(df).collect()}
    for i in range(200):
        mine = None if i % 5 == 0 else str(i % 11)
        assert got[i] == sum(j for j in range(200) if (None if j % 5 == 0 else str(j % 11)) == mine)


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        cc.yinyang(df, cc.hashed_seeds(df)).rows.collect()
