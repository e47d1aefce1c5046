"""Winnowing against brute force, its match guarantee, the order of documents, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from textmill.llm import fingerprints as fp


def plain(text, k=fp.K, window=fp.WINDOW):
    """Choices of a text, window by window; a k-gram's hash is told by the library, as that of a text of k characters."""
    if not text:
        return []
    grams = [int(fp.rolling(np.array([ord(c) for c in text[i : i + k]], np.uint32), k)[0]) for i in range(max(1, len(text) - k + 1))]
    found = set()
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        found.add(max(j for j in range(i, i + len(part)) if grams[j] == min(part)))
    return [(grams[j], j) for j in sorted(found)]


@pytest.mark.parametrize("k,window", [(1, 1), (3, 4), (16, 35), (5, 1), (1, 7)])
def test_choices(k, window):
    rng = random.Random(k * 100 + window)
    for n in (0, 1, 2, k, k + 1, k + window - 1, k + window, 300):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        hashes, places = fp.fingerprint(text, k, window)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain(text, k, window)
    assert fp.winnowed(np.array([5, 1, 1, 9, 1], np.uint64), 3).tolist() == [2, 4]


def test_shared_passages_are_found():
    """Any 50 characters that two texts share have a choice in common, at matching places."""
    rng = random.Random(3)
    for _ in range(100):
        a, b, shared = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (rng.randint(0, 200), rng.randint(0, 200), fp.K + fp.WINDOW - 1))
        x, y = a + shared + b, b + shared + a
        common = {(h, p - len(a)) for h, p in zip(*(z.tolist() for z in fp.fingerprint(x)), strict=True)} & {(h, p - len(b)) for h, p in zip(*(z.tolist() for z in fp.fingerprint(y)), strict=True)}
        assert any(0 <= p <= len(shared) - fp.K for _, p in common)


def test_density():
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=50_000))
    assert 0.9 < len(fp.fingerprint(text)[0]) / (2 / (fp.WINDOW + 1) * 50_000) < 1.1


def expected(rows):
    """The query's rows by plain Python; equal rows are followed by their like."""
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    marks = {}
    out = []
    keyed = sorted(order, key=lambda r: (r[0], r[1], marks.setdefault(r[2], _mark(r[2])), r[2]))
    for j, (known, i, text) in enumerate(keyed):
        following = keyed[(j + 1) % len(keyed)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        sets = [{h for h, _ in plain(t)} for t in (text, edited, following)]
        near = [2 * len(sets[0] & s) / (len(sets[0]) + len(s)) if sets[0] or s else 1.0 for s in sets[1:]]
        told = [",".join(f"{h:016x}:{p}" for h, p in plain(t)) for t in (text, edited)]
        out.append((i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), *told, *near))
    return sorted(out, key=str)


_HASHES = {}


def _mark(text):
    return _HASHES[text]


def known_marks(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    _HASHES.update({r[0]: r[1] for r in df.selectExpr("t", "xxhash64(t)").collect()})


ODD = [(3, "one"), (1, None), (None, "no id " * 40), (None, None), (2, ""), (5, "many words here " * 300), (5, "many words here " * 300), (5, "others"), (4, "é😀  " * 50), (-7, "abcd"), (9, "many words here " * 300)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_odd_rows(spark, parts):
    """Null and repeated ids, null, empty, short and equal texts, in any number of ranges."""
    rows = ODD + [(5, "others")] * 5
    known_marks(spark, [t or "" for _, t in rows])
    df = spark.createDataFrame([(i, t, "a", 1, True, 2) for i, t in rows], "doc_id long, text string, mark string, n int, guest boolean, range int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((tuple(r) for r in fp.compared_with_next(df).collect()), key=str)
        assert got == expected(rows)
        assert fp.compared_with_next(df.where("false")).count() == 0
        one = fp.compared_with_next(df.where("doc_id = 3")).collect()
        assert len(one) == 1 and one[0].near_next == one[0].near_edited == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark, sf):
    """The whole table, against brute force."""
    from textmill.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    known_marks(spark, [t or "" for _, t in rows])
    got = sorted((tuple(r) for r in QUERIES["op11_document_fingerprints"](spark, sf).collect()), key=str)
    assert got == expected(rows)
    long = [r for r in got if r[1] > 1000]
    assert np.mean([r[5] for r in long]) > 0.7 and np.median([r[6] for r in long]) < 0.1


def test_fingerprints_of_all(spark):
    rows = [(1, "a shared passage of some length, more than fifty characters of it"), (2, None), (None, ""), (2, "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, hashes string")
    got = {(r.doc_id, r.n_chars): list(zip([h % (1 << 64) for h in r.hashes], r.places, strict=True)) for r in fp.fingerprints(df).collect()}
    assert got == {(i, len(t or "")): plain(t or "") for i, t in rows}


def test_ranges(spark):
    """Ranges follow the order of keys, also within one id, and cut sizes evenly."""
    rng = random.Random(2)
    keys = sorted((rng.choice([1, 5, 5, 5, 9]), rng.randrange(-(10**9), 10**9)) for _ in range(2000))
    df = spark.createDataFrame([(*k, 10) for k in keys], "id long, mark long, size int")
    ranges = fp.Ranges.sampled(df, 10)
    found = ranges.of(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
    assert (np.diff(found) >= 0).all() and len(set(found)) == 10 and np.bincount(found).max() < 500
