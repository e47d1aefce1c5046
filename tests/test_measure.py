"""The harness: warm-up, repeats, what it tells of runs."""

import statistics
import time

import pytest

from textmill.operators import bpe, measure


def test_runs(spark):
    built = []

    def slow():
        built.append(time.perf_counter())
        time.sleep(0.2)
        return spark.range(1000, numPartitions=4)

    runs = measure.measure(spark, {"slow": slow, "none": lambda: spark.range(0)}, warm=2, repeats=3, bytes_read={"slow": 4000}).collect()
    assert len(built) == 5 and [(r.name, r.repeat, r.rows) for r in runs] == [("slow", k, 1000) for k in range(3)] + [("none", k, 0) for k in range(3)]
    assert all(r.seconds > 0.2 and r.bytes == 4000 for r in runs[:3]) and all(r.bytes is None for r in runs[3:])
    assert all(r.peak_heap >= 0 for r in runs)


def test_report(spark):
    rows = [("a", k, s, 10, 100, k) for k, s in enumerate([1.0, 2.0, 6.0])] + [("b", 0, 2.0, 0, None, 5)]
    got = {r.name: r for r in measure.report(spark.createDataFrame(rows, measure.RUNS), 1000.0).collect()}
    a = got["a"]
    assert (a.n, a.mean, a.middle, a.peak_heap) == (3, 3.0, 2.0, 2) and a.deviation == pytest.approx(statistics.stdev([1, 2, 6]))
    assert a.rows_a_second == pytest.approx(30 / 9) and a.bytes_a_second == pytest.approx(300 / 9) and a.target_seconds == pytest.approx(1000 / (300 / 9))
    assert got["b"].deviation is None and got["b"].bytes_a_second is None and got["b"].target_seconds is None


def test_tokenizers(spark):
    docs = spark.createDataFrame([(1, "the the"), (2, None), (3, "x")], "doc_id long, text string")
    coders = {"bytes": bpe.Tokenizer([]), "words": bpe.Tokenizer([(b"t", b"h"), (b"th", b"e"), (b" ", b"the")])}
    got = {r.name: r for r in measure.tokenizer_report(spark, docs, coders, repeats=2).collect()}
    assert got["bytes"].bytes_a_token == 1 and got["words"].bytes_a_token == 8 / 3 and all(r.n == 2 and r.target_seconds > 0 for r in got.values())
