"""Byte ranges of files: Spark lists them, tasks open them by themselves and read a part each."""

from __future__ import annotations

import io
import re
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE = 256 << 20


def file_ranges(spark: SparkSession, path: str, size: int = RANGE, whole: str | None = None) -> DataFrame:
    """``path, begin, end``: ranges of ``size`` bytes of all files of a path or glob, each in a task of its own.

    Files whose names match the pattern ``whole`` are one range.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    step = F.lit(size).cast("long") if whole is None else F.when(F.col("path").rlike(whole), F.greatest("length", F.lit(1))).otherwise(F.lit(size).cast("long"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step)
    rows = files.select("path", "length", step.alias("step"), F.explode(begins).alias("begin")).select("path", "begin", F.least(F.col("begin") + F.col("step"), "length").alias("end"))
    # The reader packs files into few tasks; ranges are dealt one by one, by their place among all.
    parts = max(1, rows.count())
    return rows.withColumn("_no", F.row_number().over(_in_order()) - 1).repartitionById(parts, F.col("_no").cast("int")).drop("_no")


def _in_order():
    from pyspark.sql import Window

    # A row for each range of the input, of 256 MB each: a list of files with lengths, not their content.
    return Window.orderBy("path", "begin")


def opened(path: str) -> BinaryIO:
    """A file that Spark has listed, in any store that Arrow knows; it can be sought."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(at)


class Part(io.RawIOBase):
    """The bytes of a file from one place to another, as a stream."""

    def __init__(self, raw: BinaryIO, begin: int, end: int):
        raw.seek(begin)
        self.raw, self.left = raw, max(0, end - begin)

    def read(self, size: int = -1) -> bytes:
        got = self.raw.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(got)
        return got
