"""The frequency sketch: its error bound, merging, and exact counts of what is frequent."""

import random
from collections import Counter

import numpy as np
import pytest

from textmill.operators import sketch


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    return [f"w{int(rng.paretovariate(0.6))}" if rng.random() < 0.7 else f"rare{rng.random()}" for _ in range(20_000)] + [None] * 30


def test_error_bound(spark, items):
    df = spark.createDataFrame([(x,) for x in items], "item string").repartition(5)
    hashes = {r.item: r.h for r in df.selectExpr("item", "xxhash64(item) AS h").distinct().collect()}
    true = Counter(items)
    names = list(true)
    for depth, width in ((4, 1 << 10), (2, 1 << 12), (1, 16)):
        got = sketch.sketch(df, "item", depth, width)
        assert got.items == len(items) and got.cells.shape == (depth, width)
        over = got(np.array([hashes[x] for x in names])) - np.array([true[x] for x in names])
        assert (over >= 0).all()
        assert got.error == pytest.approx(np.e * len(items) / width)
        assert (over > got.error).mean() <= np.exp(-depth)


def test_sketches_add_up(spark, items):
    """Any dealing of the rows over tasks gives the same cells."""
    df = spark.createDataFrame([(x,) for x in items], "item string")
    a, b = (sketch.sketch(d, "item", 3, 1 << 9).cells for d in (df.coalesce(1), df.repartition(7)))
    assert (a == b).all()
    assert sketch.sketch(df.where("false"), "item", 2, 8).cells.sum() == 0
    with pytest.raises(ValueError, match="power of two"):
        sketch.sketch(df, "item", 2, 100)


@pytest.mark.parametrize("least,width", [(1, 8), (2, 1 << 20), (5, 1 << 8), (5, 2), (10_000_000, 1 << 8)])
def test_frequent(spark, items, least, width):
    """Exact whatever the width; a narrow sketch only lets more through."""
    df = spark.createDataFrame([(x,) for x in items], "item string").repartition(4)
    got = {r.item: r.n for r in sketch.frequent(df, "item", least, 3, width).collect()}
    assert got == {k: n for k, n in Counter(items).items() if n >= least}


def test_rare_items_are_not_shuffled(spark, items):
    """The rows that pass the filter are few more than those of frequent items."""
    df = spark.createDataFrame([(x,) for x in items], "item string")
    found = sketch.sketch(df, "item")
    hashes = np.array([r[0] for r in df.selectExpr("xxhash64(item)").collect()])
    frequent = sum(n for n in Counter(items).values() if n >= 5)
    assert (found(hashes) >= 5).sum() <= 1.01 * frequent
