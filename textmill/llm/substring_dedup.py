"""Removal of long repeated passages by difference-cover anchors.

The positions of a document that lie in a perfect difference set modulo a period
are its anchors. For every offset between two documents some residue is an anchor
in both, so two equal passages of ``window`` words share an anchor within the first
``period`` positions, and with it the ``window - period + 1`` words from there on.

1. Each batch of documents hashes these words at its anchors only and exchanges
   the hashes by bucket; it gets back the anchors that another batch has too.
2. The match is extended: every window of full length around a shared anchor is
   hashed and exchanged, once a batch and with the least document that has it.
   The batch gets back the windows that begin in a document with a smaller id.
3. The words that these windows cover go.

A passage that many documents share costs an entry a batch, not a pair of
documents. The input is read once: compressed batches of it, named by task and
number, are stored in the shared folder, and the text is hashed again where it is
needed. So the source may read its rows in another order each time, as a table does
that is dealt over the cores by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Words, buckets_for, pack, settle, slices, table, unpack

#: A perfect difference set: each residue but 0 modulo 31 is one difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SLICE = 2 << 20

_ROW = "batch string, bucket int, keys binary, places binary, texts binary, ids binary"
_SCHEMA = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "places", "texts", "ids"))])


def _out(rows: list[tuple], schema: pa.Schema = _SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class _Batch:
    """Documents of one batch: their words, ids and anchors."""

    def __init__(self, texts: pa.Array, ids: pa.Array, window: int):
        self.texts, self.ids, self.window = texts, ids, window
        self.words = Words(texts)
        first = self.words.first
        self.doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.known = np.asarray(ids.is_valid())
        self.id = ids.fill_null(0).to_numpy()

    @classmethod
    def load(cls, texts: bytes, window: int) -> _Batch:
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts)) as reader:
            part = reader.read_all().combine_chunks()
        return cls(part.column("text").combine_chunks(), part.column("id").combine_chunks(), window)

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows within a document with an id, and their hashes."""
        got, inside = self.words.windows(self.window)
        start = np.flatnonzero(inside & self.known[self.doc[: len(got)]])
        return start, got[start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.window - PERIOD + 1
        got, inside = self.words.windows(n)
        doc = self.doc[: len(got)]
        first = self.words.first
        at = np.zeros(PERIOD, bool)
        at[list(COVER)] = True
        long = np.diff(first) >= self.window
        place = np.flatnonzero(inside & self.known[doc] & long[doc] & at[(np.arange(len(got)) - first[doc]) % PERIOD])
        return place, got[place]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    for whole in batches:
        for part in slices(whole, "text", SLICE):
            part = pa.RecordBatch.from_arrays([part.column("id"), part.column("text").cast(pa.large_string())], names=["id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            yield _out([(f"{task}-{count}", -1, None, None, zstandard.ZstdCompressor(level=1).compress(sink.getvalue()), None)])
            count += 1


def _split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket and range of sorted keys."""
    edge = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), int(edge[b]), int(edge[b + 1])


def _many(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For sorted keys: whether the key is in more than one document."""
    if not len(keys):
        return np.zeros(0, bool)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(first)
    low, high = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
    return (low < high)[np.cumsum(first) - 1]


def _send_anchors(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in ((x.as_py(), y.as_py()) for b in batches for x, y in zip(b.column("batch"), b.column("texts"), strict=True)):
            batch = _Batch.load(texts, window)
            place, key = batch.anchors()
            order = np.argsort(key, kind="stable")
            place, key = place[order].astype(np.uint32), key[order]
            many = _many(key, batch.doc[place])
            rows = []
            for b, i, j in _split(key, buckets):
                # Anchors in several documents of the batch are known to be shared: only their hash goes out.
                own = ~many[i:j]
                rows.append((name, b, pack(key[i:j][own]), pack(place[i:j][own]), pack(np.unique(key[i:j][~own])), None))
            if rows:
                yield _out(rows)

    return run


def _share_anchors(sent: pa.Table) -> pa.Table:
    rows = sent.to_pydict()
    keys, known = [unpack(x, np.uint64) for x in rows["keys"]], [unpack(x, np.uint64) for x in rows["texts"]]
    every, count = np.unique(np.concatenate([*map(np.unique, keys), *known, *known]), return_counts=True)
    shared = every[count > 1]
    out = []
    for name, key, place in zip(rows["batch"], keys, rows["places"], strict=True):
        if len(key):
            at = np.minimum(np.searchsorted(shared, key), max(len(shared) - 1, 0))
            hit = shared[at] == key if len(shared) else np.zeros(len(key), bool)
            if hit.any():
                out.append((name, 0, None, pack(np.sort(unpack(place, np.uint32)[hit])), None, None))
    return pa.Table.from_batches([_out(out)], _SCHEMA)


def _load(got: pa.Table, window: int) -> tuple[str, _Batch, list[dict]]:
    rows = got.to_pylist()
    (text,) = (r["texts"] for r in rows if r["texts"] is not None)
    return rows[0]["batch"], _Batch.load(text, window), [r for r in rows if r["texts"] is None]


def _send_windows(window: int, buckets: int):
    def run(got: pa.Table) -> pa.Table:
        name, batch, back = _load(got, window)
        place, key = batch.anchors()
        order = np.argsort(key, kind="stable")
        shared = [place[order][_many(key[order], batch.doc[place[order]])], *(unpack(r["places"], np.uint32) for r in back)]
        place = np.concatenate(shared).astype(np.int64)
        step = np.zeros(len(batch.doc) + 2, np.int64)
        np.add.at(step, np.maximum(place - PERIOD + 1, batch.words.first[batch.doc[place]]), 1)
        np.add.at(step, place + 1, -1)
        near = np.cumsum(step) > 0
        start, key = batch.full()
        near = near[start]
        start, key = start[near], key[near]
        ids = batch.id[batch.doc[start]]
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        key, ids = key[first], ids[first]
        rows = [(name, b, pack(key[i:j]), None, None, pack(ids[i:j])) for b, i, j in _split(key, buckets)]
        return pa.Table.from_batches([_out(rows)], _SCHEMA)

    return run


def _judge_windows(sent: pa.Table) -> pa.Table:
    rows = sent.to_pydict()
    keys, ids = [unpack(x, np.uint64) for x in rows["keys"]], [unpack(x, np.int64) for x in rows["ids"]]
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, back, np.concatenate(ids))
    out, at = [], 0
    for name, key, own in zip(rows["batch"], keys, ids, strict=True):
        late = least[back[at : at + len(key)]] < own
        at += len(key)
        if late.any():
            out.append((name, 0, pack(key[late]), None, None, None))
    return pa.Table.from_batches([_out(out)], _SCHEMA)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _remove(window: int, digest: bool):
    def run(got: pa.Table) -> pa.Table:
        _, batch, back = _load(got, window)
        start, key = batch.full()
        late = np.isin(key, np.concatenate([np.zeros(0, np.uint64), *(unpack(r["keys"], np.uint64) for r in back)]))
        ids = batch.id[batch.doc[start]]
        order = np.lexsort((ids, key))
        sorted_key, sorted_id = key[order], ids[order]
        first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, bool)
        late[order] |= sorted_id > sorted_id[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else False
        step = np.zeros(len(batch.doc) + window + 1, np.int64)
        np.add.at(step, start[late], 1)
        np.add.at(step, start[late] + window, -1)
        gone = np.cumsum(step)[: len(batch.doc)] > 0
        edge, rows, raw = batch.words.first, [], batch.words.raw.tobytes()
        for i, (a, b) in enumerate(zip(batch.words.at[:-1], batch.words.at[1:], strict=True)):
            lost = gone[edge[i] : edge[i + 1]]
            words = raw[a:b].split()
            if lost.any():
                words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            text = b" ".join(words)
            rows.append((int(batch.id[i]) if batch.known[i] else None, len(lost), int(lost.sum()), hashlib.sha256(text).hexdigest() if digest else text.decode()))
        return pa.Table.from_batches([_out(rows, _RESULT)], _RESULT)

    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove each word in a window of ``window`` words that also begins in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept``, a row for each input row;
    ``kept`` is the kept words joined by one space, or their SHA-256 with
    ``digest``. Windows are judged on the input. Null and empty texts have no
    words; a row with a null id loses nothing and takes nothing from others; rows
    that share an id take nothing from each other. Texts are read whole. Other
    columns are ignored, an empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = buckets_for(docs)
    texts = settle(docs.mapInArrow(_texts, _ROW))
    anchors = texts.mapInArrow(_send_anchors(window, buckets), _ROW).groupBy("bucket").applyInArrow(_share_anchors, _ROW)
    windows = texts.unionByName(anchors).groupBy("batch").applyInArrow(_send_windows(window, buckets), _ROW)
    late = windows.groupBy("bucket").applyInArrow(_judge_windows, _ROW)
    return texts.unionByName(late).groupBy("batch").applyInArrow(_remove(window, digest), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS d FROM h GROUP BY k),
c AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS p FROM h JOIN m ON h.k = m.k AND m.d < h.doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
