"""Seeded 32-bit Murmur3 of UTF-8 strings: in built-in functions for a column, in vectors for a family of seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published function (x86, 32 bits).
C1, C2, MORE, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _times(x: str, by: int) -> str:
    """SQL for a product modulo 2**32: 16 bits of the factor at a time, so that nothing overflows."""
    return f"((({x}) * {by & 0xFFFF}L + shiftleft((({x}) * {by >> 16}L) & 65535L, 16)) & {MASK}L)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _turned(x: str, bits: int) -> str:
    return f"((shiftleft({x}, {bits}) | shiftrightunsigned({x}, {32 - bits})) & {MASK}L)"


def _folded(k: str) -> str:
    return _let("k1", _times(k, C1), _times(_turned("k1", 15), C2))


def murmur3(column: str, seed: int = 0) -> Column:
    """The hash of a text column from 0 to 2**32 - 1, as a long; null gives null. The text is folded four bytes at a time."""

    def number(begin: str, size: str) -> str:
        """Up to four bytes from a place on, the first the least, of their digits."""
        return f"aggregate(sequence(1, 4), 0L, (a, j) -> a + CASE WHEN j <= {size} THEN shiftleft(cast(conv(substr(c.s, cast(2 * ({begin} + j) - 1 AS int), 2), 16, 10) AS bigint), 8 * (j - 1)) ELSE 0L END)"

    step = _let("t", f"h ^ {_folded(number('4 * i', '4'))}", f"({_times(_turned('t', 13), 5)} + {MORE}L) & {MASK}L")
    body = f"aggregate(filter(sequence(0L, c.n div 4), i -> i < c.n div 4), {seed & MASK}L, (h, i) -> {step})"
    tail = f"CASE WHEN c.n % 4 = 0 THEN 0L ELSE {_folded(number('4 * (c.n div 4)', 'c.n % 4'))} END"
    final = _let("p", f"({body}) ^ ({tail}) ^ c.n", _let("q", _times("p ^ shiftrightunsigned(p, 16)", MIX1), _let("r", _times("q ^ shiftrightunsigned(q, 13)", MIX2), "r ^ shiftrightunsigned(r, 16)")))
    value = f"named_struct('s', hex(encode({column}, 'UTF-8')), 'n', cast(octet_length({column}) AS bigint))"
    return F.expr(f"CASE WHEN {column} IS NOT NULL THEN {_let('c', value, final)} END")


def murmur3_family(texts: pa.Array, seeds: int) -> np.ndarray:
    """``[seeds, n]``: the hashes of n strings with the seeds from 0 on, as unsigned 32-bit numbers. Nulls count as empty."""
    raw = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    h = np.repeat(np.arange(seeds, dtype=np.uint32)[:, None], len(raw), 1)

    def fold(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(C1)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(C2)

    def bytes_at(rows: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        k = np.zeros(len(rows), np.uint32)
        for j in range(4):
            has = np.flatnonzero(j < n) if not np.isscalar(n) else np.arange(len(rows)) if j < n else np.zeros(0, int)
            k[has] |= data[at[has] + j].astype(np.uint32) << np.uint32(8 * j)
        return k

    # Strings in the order of their length: those that have a j-th word are the last ones.
    order = np.argsort(size, kind="stable")
    whole = size[order] // 4
    for j in range(int(whole.max(initial=0))):
        rows = order[np.searchsorted(whole, j, "right") :]
        x = h[:, rows] ^ fold(bytes_at(rows, offsets[rows] + 4 * j, 4))
        h[:, rows] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(MORE)
    rows = np.flatnonzero(size % 4)
    h[:, rows] ^= fold(bytes_at(rows, offsets[rows] + size[rows] // 4 * 4, size[rows] % 4))
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(MIX1)
    h = (h ^ h >> np.uint32(13)) * np.uint32(MIX2)
    return h ^ h >> np.uint32(16)
