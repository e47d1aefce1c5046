"""Structured Streaming forms of the curation steps; an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import heuristics
from textmill.plans.text import ALL_RULES


def curate_stream(docs: DataFrame, time_col: str = "ts", delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """A stream of documents that pass the heuristics, each text once within the watermark.

    State is a digest for each text of the last ``delay``; older state is dropped.
    """
    kept = docs.withColumns(heuristics(F.col(text_col))).where(F.expr(ALL_RULES)).select(*docs.columns)
    return kept.withColumn("digest", F.sha2(text_col, 256)).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def activity(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; late events count until the watermark passes."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
