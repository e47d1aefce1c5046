"""A harness for plans: warm-up, repeats, rows, throughput, peak memory, and what a larger input would take."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "name string, repeat int, seconds double, rows long, bytes long, peak_heap long"


def peak_heap(spark: SparkSession) -> int:
    """The largest heap in bytes that any executor (the driver, where all runs in one process) has reported so far."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    told = [every.apply(k).peakMemoryMetrics() for k in range(every.size())]
    return max((int(m.get().getMetricValue("JVMHeapMemory")) for m in told if m.isDefined()), default=0)


def measure(spark: SparkSession, plans: dict[str, Callable[[], DataFrame]], warm: int = 1, repeats: int = 3, bytes_read: dict[str, int] | None = None) -> DataFrame:
    """A row for each run of each plan: ``name, repeat, seconds, rows, bytes, peak_heap``.

    A plan is built anew for each run, within its time, and run to the end with all its columns, without a sink.
    The first ``warm`` runs are not told. ``rows`` is what came out, observed on the way; ``bytes`` is the size of
    the input if it is given, else null; ``peak_heap`` is the session's until then.
    """
    told = []
    for name, plan in plans.items():
        for k in range(warm + repeats):
            seen, began = Observation(), time.perf_counter()
            plan().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if k >= warm:
                told.append((name, k - warm, took, seen.get["rows"], (bytes_read or {}).get(name), peak_heap(spark)))
    return spark.createDataFrame(told, RUNS)


def report(runs: DataFrame, target_bytes: float | None = None) -> DataFrame:
    """``name, n, mean, deviation, middle, rows_a_second, bytes_a_second, peak_heap`` of runs, and ``target_seconds``, what ``target_bytes`` would take in proportion.

    The deviation is that of a sample, null for one run.
    """
    out = runs.groupBy("name").agg(
        F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("deviation"), F.median("seconds").alias("middle"),
        F.try_divide(F.sum("rows"), F.sum("seconds")).alias("rows_a_second"), F.try_divide(F.sum("bytes"), F.sum(F.when(F.col("bytes").isNotNull(), F.col("seconds")))).alias("bytes_a_second"), F.max("peak_heap").alias("peak_heap"),
    )
    return out.withColumn("target_seconds", F.try_divide(F.lit(None if target_bytes is None else float(target_bytes)).cast("double"), "bytes_a_second"))


def tokenizer_report(spark: SparkSession, docs: DataFrame, tokenizers: dict, text_col: str = "text", repeats: int = 3, target_bytes: float = 825e9) -> DataFrame:
    """``report`` of encoding all texts by each of some tokenizers, with ``bytes_a_token``."""
    from textmill.operators.bpe import encode

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ratio = [(n, size, encode(docs, t, text_col=text_col).agg(F.sum(F.size("ids")).cast("long")).first()[0] or 0) for n, t in tokenizers.items()]
    runs = measure(spark, {n: lambda t=t: encode(docs, t, text_col=text_col) for n, t in tokenizers.items()}, repeats=repeats, bytes_read=dict.fromkeys(tokenizers, size))
    tokens = spark.createDataFrame(ratio, "name string, size long, tokens long").select("name", F.try_divide("size", "tokens").alias("bytes_a_token"))
    return report(runs, target_bytes).join(F.broadcast(tokens), "name")
