"""Text files as documents, and sinks for documents, training lines and tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import strip
from textmill.operators.bpe import END_OF_TEXT
from textmill.sources.ranges import RANGE, file_ranges, opened
from textmill.sources.sink import write_files


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``: a row for each line of the files of a path or glob."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = END_OF_TEXT) -> DataFrame:
    """``file, text``: documents between delimiters. The reader aligns its splits with the delimiter, so a large file is read in parallel."""
    rows = spark.read.text(path, lineSep=delimiter)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Training runs from JSON arrays."""
    return spark.read.schema("parameters long, compute_budget double, final_loss double").option("multiLine", True).json(path)


def read_token_files(spark: SparkSession, path: str, chunk: int = 1 << 16, size: int = RANGE) -> DataFrame:
    """``file, start, ids``: flat files of unsigned 16-bit little-endian ids, raw or as one-dimensional ``.npy``, in chunks.

    A file is read by a task for each ``size`` bytes, whatever its size, and a task holds a chunk of it;
    ``start`` is the place of a chunk's first id in its file.
    """
    import numpy as np

    def run(batches):
        for batch in batches:
            for file, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(file) as raw:
                    head, kind = 0, np.dtype("<u2")
                    if raw.read(6) == b"\x93NUMPY":
                        raw.seek(0)
                        version = np.lib.format.read_magic(raw)
                        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
                        if len(shape) != 1 or kind.kind not in "iu":
                            raise ValueError(f"{file} is no one-dimensional array of whole numbers")
                        head = raw.tell()
                    # The ids that begin in the range, in chunks that begin at multiples of the chunk.
                    total = (raw.size() - head) // kind.itemsize
                    first, last = (min(total, max(0, -(-(x - head) // kind.itemsize))) for x in (begin, end))
                    raw.seek(head + first * kind.itemsize)
                    while first < last:
                        n = min(chunk - first % chunk, last - first)
                        ids = np.frombuffer(raw.read(n * kind.itemsize), kind).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["file", "start", "ids"])
                        first += n

    return file_ranges(spark, path, size).mapInArrow(run, "file string, start long, ids array<int>")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_suffix(path: Column, old: str, new: str) -> Column:
    return F.when(path.endswith(old), F.concat(F.substring(path, 1, F.length(path) - len(old)), F.lit(new))).otherwise(path)


def write_documents(docs: DataFrame, path: str, by: str | None = "source", text_col: str = "text") -> None:
    """Stripped texts with a blank line after each, a folder for each value of ``by``."""
    rows = docs.select(*([by] if by else []), F.concat(strip(F.col(text_col)), F.lit("\n")).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_delimited(docs: DataFrame, path: str, delimiter: str = END_OF_TEXT, text_col: str = "text") -> None:
    docs.select(F.col(text_col).alias("value")).write.mode("overwrite").option("lineSep", delimiter).text(path)


def write_training_lines(rows: DataFrame, path: str) -> None:
    """``__label__NAME text`` with a space between, so that the label never joins the first word."""
    rows.select(F.concat(F.lit("__label__"), "label", F.lit(" "), "text").alias("value")).write.mode("overwrite").text(path)


def write_tokens(rows: DataFrame, path: str, bits: int = 16) -> None:
    """``doc_id, ids`` as Parquet, after a check that every id fits into so many bits."""
    most = (1 << bits) - 1
    worst = F.array_max("ids")
    checked = F.when(F.coalesce(worst, F.lit(0)) > most, F.raise_error(F.concat(F.lit("token id out of range: "), worst))).otherwise(F.col("ids"))
    rows.select("doc_id", checked.alias("ids")).write.mode("overwrite").parquet(path)


def write_token_file(rows: DataFrame, path: str) -> DataFrame:
    """Ids as flat unsigned 16-bit little-endian files, a file for each partition in its order of rows: ``file, n_tokens``.

    Files appear together when all are whole, and the folder holds nothing of an earlier
    write then (see ``write_files``). An id that does not fit stops the write, and the folder stays as it was.
    ``read_token_files`` reads it.
    """
    import numpy as np

    def run(batches):
        from pyspark import TaskContext

        name = f"tokens-{TaskContext.get().partitionId():05d}.bin"
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b""], pa.binary())], names=["name", "content"])
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                raise ValueError(f"token id out of range: {ids.max() if ids.max() > 0xFFFF else ids.min()}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids.astype("<u2").tobytes()], pa.binary())], names=["name", "content"])

    write_files(rows.select("ids").mapInArrow(run, "name string, content binary"), path)
    done = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(path)
    return done.select(F.col("path").alias("file"), (F.col("length") / 2).cast("long").alias("n_tokens"))


def write_by_file(rows: DataFrame, path: str, suffix: tuple[str, str] = ("", ""), separator: str = "\n", order: str = "rec_no", text_col: str = "text") -> None:
    """One output for each input file: the texts of a ``file`` in their order, each stripped and followed by ``separator`` twice.

    An output has the base name of its input, with its ``suffix`` changed from the first to the second. A file is written by
    one task, as its reader had it; outputs appear together (see ``write_files``).
    """
    name = with_suffix(base_name(F.col("file")), *suffix) if suffix[0] else base_name(F.col("file"))
    content = F.concat(strip(F.col(text_col)), F.lit(separator * 2)).cast("binary")
    parts = rows.select(name.alias("name"), F.col(order).alias("_order"), content.alias("content"))
    write_files(parts.repartition("name").sortWithinPartitions("name", "_order").select("name", "content"), path)
