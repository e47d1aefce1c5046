"""Things that several operators share: tables, checkpoints, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from textmill.session import settle, shared_folder, table

__all__ = ["SPACE", "WORD", "Words", "buckets_for", "mix", "pack", "parts_of", "runs", "settle", "shared_folder", "shuffle_partitions", "slices", "small_batches", "table", "text_buffers", "unpack"]

#: A word, wherever a contract speaks of words; in Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

MASK = (1 << 64) - 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(docs: DataFrame, each: int = 32 << 20) -> int:
    """Buckets in which about one byte of hashes a byte of text comes to ``each`` bytes a bucket.

    The optimizer's estimate of the input counts threefold, since files are
    compressed. There are four a shuffle partition at least, so that they fill the
    partitions evenly, and 64 at most, for inputs whose size it does not know.
    """
    parts = shuffle_partitions(docs.sparkSession)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(4 * parts, min(64 * parts, 3 * size // each))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Bound the rows of Arrow batches while something is run eagerly; the session's own bound is restored after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parts_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The parts of all batches: Arrow's are bounded at 64 MB, which is much as Python objects."""
    for batch in batches:
        yield from slices(batch, text)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a single longer text is a part of its own."""
    size = np.cumsum(np.diff(text_buffers(batch.column(text))[1]))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(0x5851F42D4C957F2D), Powers(0x2545F4914F6CDD1D)


class Words:
    """The words of a batch of texts: hash, document and byte range of each.

    Each byte's code is weighted by a power of an odd base; prefix sums then
    give the hash of any word in a few vector operations, without a Python
    object for a word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, at = text_buffers(column)
        self.raw, self.at = raw, at
        blank = _IS_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        gap = np.ones(len(raw) + 1, bool)
        gap[1:] = blank
        self.start = np.flatnonzero(~blank & (gap[:-1] | edge[:-1]))
        gap[:-1], gap[-1] = blank, True
        self.end = np.flatnonzero(~blank & (gap[1:] | edge[1:])) + 1
        up, down = _BYTE_POWERS(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[raw] if lower else raw] * up[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        #: The number of words before each document.
        self.first = np.searchsorted(self.start, at)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are in one document."""
        k = len(self.hash)
        if k < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = _WORD_POWERS(k + 1)
        total = np.zeros(k + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=total[1:])
        got = mix((total[n:] - total[:-n]) * down[: k - n + 1])
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return got, doc[: k - n + 1] == doc[n - 1 :]


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes: planes of equal significance lie together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length at the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)
