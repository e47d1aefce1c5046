"""Murmur3 against its published values and a plain version, as a column and as a family."""

import random

import pyarrow as pa
import pytest

from textmill.functions.hashing import murmur3, murmur3_family
from textmill.operators import dedup

# Published values: text, seed, hash.
PUBLISHED = [
    ("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("test", 0, 0xBA6BD213), ("test", 0x9747B28C, 0x704B81DC), ("Hello, world!", 0, 0xC0363E43), ("Hello, world!", 0x9747B28C, 0x24884CBA),
    ("The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723), ("The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD),
    ("aaaa", 0x9747B28C, 0x5A97808A), ("aaa", 0x9747B28C, 0x283E0130), ("aa", 0x9747B28C, 0x5D211726), ("a", 0x9747B28C, 0x7FA09EA6), ("abc", 0, 0xB3DD93FA),
]


def plain(text, seed):
    data, h = text.encode(), seed
    turn = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
    fold = lambda k: turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = fold(int.from_bytes(data[i : i + 4], "little"))
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF if i + 4 <= len(data) else h ^ k
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def texts():
    rng = random.Random(2)
    return ["".join(rng.choice("ab é東😀") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 40]))) for _ in range(200)] + ["x" * 3000]


def test_published(spark):
    for text, seed, want in PUBLISHED:
        assert plain(text, seed) == want
    df = spark.createDataFrame([(t,) for t, _, _ in PUBLISHED] + [(None,)], "t string")
    got = df.select("t", *[murmur3("t", s).alias(f"s{s}") for s in (0, 1, 0x9747B28C, 0xFFFFFFFF)]).collect()
    told = {r.t: r for r in got}
    assert [told[t][f"s{s}"] for t, s, _ in PUBLISHED] == [h for _, _, h in PUBLISHED] and told[None]["s0"] is None


def test_columns_and_families(spark):
    rows = texts()
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", murmur3("t", 7).alias("h")).collect()}
    assert all(got[t] == plain(t, 7) for t in rows)
    family = murmur3_family(pa.array([None, *rows]).slice(1), 9)
    assert family.shape == (9, len(rows)) and all(int(family[s, i]) == plain(t, s) for i, t in enumerate(rows) for s in range(9))
    assert murmur3_family(pa.array([], pa.string()), 3).shape == (3, 0)


def test_signatures(spark):
    sets = [(1, ["a b c", "b c d"]), (2, []), (3, None), (4, ["é"] + [f"gram {k}" for k in range(5000)])]
    got = {r.doc_id: r.sig for r in dedup.murmur_minhash(spark.createDataFrame(sets, "doc_id long, grams array<string>"), 16).collect()}
    assert got == {i: [min(plain(g, s) for g in grams) for s in range(16)] for i, grams in sets if grams}


@pytest.mark.parametrize("family", [dedup.minhash, dedup.murmur_minhash])
def test_families_find_the_same(spark, family):
    words = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, " ".join(reversed(words))), (4, "short")]
    got = {r.doc_id: r.component for r in dedup.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), family=family).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
