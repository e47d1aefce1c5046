"""Document fingerprints by winnowing: rolling hashes of k-grams of code points, the least of each window with its place.

Of each window of consecutive k-grams the one with the least hash is chosen, of equal
ones the rightmost; neighbouring windows mostly choose the same, so about two in
``window + 1`` k-grams are kept. Whatever two texts share over ``k + window - 1`` characters
fills a window in both, so at least one choice is common to both and its places tell
where. Texts shorter than k are one k-gram as a whole.

A document is compared with the next one in the order of ids: rows are dealt by ranges of
their key, each range is read in order, and the first row of a range is also sent to the
range before it. The texts travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Powers, mix, parts_of, settle, shuffle_partitions, table

#: Characters of a k-gram, k-grams of a window: any passage of 50 characters that two texts share is found.
K, WINDOW = 16, 35
#: Rows a partition that are sampled for the bounds of ranges, which only balance the work.
SAMPLED = 32
_POWERS = Powers(0x9FB21C651E98DF25)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive codes, of all of them if they are fewer: sums of codes weighted by powers, rolled on by prefix sums."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    up, down = _POWERS(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the rightmost of equals; of all hashes if they are fewer. Windows are doubled until they are wide enough."""
    n = len(hashes)
    window = min(window, n)
    least, place, width = hashes, np.arange(n), 1
    while width < window:
        step = min(width, window - width)
        right = least[step:] <= least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    return place[np.concatenate([[True], place[1:] != place[:-1]])] if n else place


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes of a text and their places in code points, ascending."""
    hashes = rolling(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    at = winnowed(hashes, window)
    return hashes[at], at


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """``hash:place`` for each choice, 16 hexadecimal digits and a number, with commas between; empty for an empty text."""
    code = hashes.astype(">u8").tobytes().hex()
    return ",".join([f"{code[16 * i : 16 * i + 16]}:{p}" for i, p in enumerate(places.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes against the mean number of them, from 0 to 1; two empty fingerprints are alike. ``a`` and ``b`` are sorted sets."""
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, hashes, places``: the fingerprint of each text, whole and unchanged, without a shuffle.

    Hashes are 64 bits as a long. Null and empty texts have none; null and
    repeated ids are kept as they are, equal texts have equal fingerprints, other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [fingerprint(t, k, window) for t in texts]
            hashes, places = pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), hashes, places], names=["doc_id", "n_chars", "hashes", "places"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, places array<long>")


class Ranges:
    """Ranges of the order of rows, by id and then by a hash of the text. A null id counts as the least."""

    NONE = -(1 << 63)

    def __init__(self, bounds: list[tuple[int, int]]):
        self.ids, self.marks = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def of(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many bounds are at a row's key or before it."""
        low, high = (np.searchsorted(self.ids, ids, side) for side in ("left", "right"))
        # Where bounds have the row's own id, its mark decides.
        for a, b in {(int(low[i]), int(high[i])) for i in np.flatnonzero(low < high)}:
            rows = np.flatnonzero((low == a) & (high == b))
            low[rows] = a + np.searchsorted(self.marks[a:b], marks[rows], "right")
        return low

    @classmethod
    def sampled(cls, keys: DataFrame, parts: int) -> Ranges:
        """Bounds that cut the texts into ``parts`` of about the same size, from ``SAMPLED`` rows a part with the least hashes of their keys."""
        rows = keys.orderBy(F.xxhash64("mark", "id"), "id", "mark").limit(SAMPLED * parts).collect()
        rows = sorted((r["id"], r["mark"], r["size"]) for r in rows)
        size = np.cumsum([r[2] + 100 for r in rows])
        cut = np.searchsorted(size, size[-1] * np.arange(1, parts) / parts) if rows else []
        return cls(sorted({rows[i][:2] for i in cut}))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, none, n, guest, text``: rows in partitions by ranges and in order within them; equal rows are one row with their number.

    A partition that is not empty ends with one row or more that are ``guest``: the first
    of them is the first row of the next partition, of the first one at the end.
    """
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(number, F.lit(Ranges.NONE)).alias("id"), F.xxhash64(text).alias("mark"), number.isNull().alias("none"), text.alias("text"))
    keys = settle(rows.select("id", "mark", F.octet_length("text").alias("size")))
    ranges = Ranges.sampled(keys, parts)
    firsts = keys.select("id", "mark").mapInArrow(_first_of(ranges), "range int, id long, mark long").groupBy("range").agg(F.min(F.struct("id", "mark")).alias("first")).orderBy("range").collect()  # a row for each range
    guests: dict[tuple[int, int], list[int]] = {}
    for before, r in zip([firsts[-1], *firsts] if firsts else [], firsts, strict=False):
        guests.setdefault((r["first"]["id"], r["first"]["mark"]), []).append(before["range"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = {i for i, _ in guests}
        for part in parts_of(batches, "text"):
            ids, marks, none = (part.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            order = np.lexsort((none, marks, ids))
            ids, marks, none = ids[order], marks[order], none[order]
            texts = part.column(3).take(pa.array(order))
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (marks[1:] == marks[:-1]) & (none[1:] == none[:-1])
            for i in np.flatnonzero(same):
                same[i] = texts[int(i)] == texts[int(i) - 1]
            first = np.flatnonzero(~same)
            count = np.diff(np.append(first, len(ids)))
            to, guest, pick = [ranges.of(ids[first], marks[first])], [np.zeros(len(first), bool)], [np.arange(len(first))]
            for i in [i for i, x in enumerate(ids[first].tolist()) if x in edge]:
                for r in guests.get((int(ids[first[i]]), int(marks[first[i]])), ()):
                    to.append([r]), guest.append([True]), pick.append([i])
            pick = np.concatenate(pick)
            at = first[pick]
            columns = [pa.array(np.concatenate(to), pa.int32()), pa.array(np.concatenate(guest)), pa.array(ids[at]), pa.array(marks[at]), pa.array(none[at]), pa.array(count[pick], pa.int64()), texts.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "guest", "id", "mark", "none", "n", "text"])

    sent = rows.mapInArrow(run, "range int, guest boolean, id long, mark long, none boolean, n long, text string")
    return sent.repartitionById(parts, "range").sortWithinPartitions("guest", "id", "mark", "text", "none").select("id", "none", "n", "guest", "text")


def _first_of(ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in range(2))
            order = np.lexsort((marks, ids))
            ids, marks = ids[order], marks[order]
            found, at = np.unique(ranges.of(ids, marks), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(ids[at]), pa.array(marks[at])], names=["range", "id", "mark"])

    return run


class Document:
    """A text with its fingerprint."""

    def __init__(self, key: tuple, text: str, n: int, k: int, window: int):
        self.key, self.text, self.n, self.k, self.window = key, text, n, k, window
        self.hashes, self.places = fingerprint(text, k, window)
        self.set = np.unique(self.hashes)

    def against(self, other: Document) -> tuple:
        """What the query returns of this text when ``other`` is the next one."""
        cut = len(self.text) // 4
        edited = self.text[: len(self.text) - cut] + other.text[:cut]
        hashes, places = fingerprint(edited, self.k, self.window)
        return (
            None if self.key[1] else self.key[0], len(self.text), hashlib.sha256(edited.encode()).hexdigest(), written(self.hashes, self.places), written(hashes, places),
            likeness(self.set, np.unique(hashes)), likeness(self.set, other.set),
        )


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("copies", pa.int64())])


def compared_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness: a row for each document.

    The edited text has the last quarter of the code points (rounded down) replaced by the
    first as many, or all, of the next document's. Documents are ordered by id, the
    last is followed by the first; a null id counts as the least, rows of one id are in the
    order of a hash of their texts. A single document follows itself. Null texts are
    empty: they have an empty fingerprint, which is like another empty one (1) and unlike all
    others (0). Rows alike in id and text are worked on once and each returned; texts are read whole, other columns ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ended = None, False
        for part in parts_of(batches, "text"):
            rows = []
            for i, none, n, guest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if ended:
                    break
                if last is not None and not guest and last.key == (i, none) and last.text == text:
                    last.n += n
                    continue
                new = Document((i, none), text, n, k, window)
                if last is not None:
                    rows += _rows(last, new)
                last, ended = new, guest
                if sum(len(r[3]) + len(r[4]) for r in rows[-2:]) > 1 << 20:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    rows = in_order(docs, id_col, text_col).mapInArrow(run, f"{_COMPARED}, copies long")
    return rows.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")


def _rows(document: Document, following: Document) -> list[tuple]:
    """A row for the last of some equal rows, and one for all before it, which are followed by their like."""
    own = [(*document.against(document), document.n - 1)] if document.n > 1 else []
    return [*own, (*document.against(following), 1)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def op11_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
