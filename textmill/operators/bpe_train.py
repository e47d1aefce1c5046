"""Training of byte-pair vocabularies on the cluster, with the merges of the plain greedy algorithm.

The distinct pre-tokens with their counts are a table of blocks of symbol ids. A round
decides all merges of pairs that occur ``least`` times or more:

1. Pair counts are known: blocks tell them once, and then how each round changes them. Where two symbols stand side by side that do so less
   than ``least`` times, words are cut. No merge of the round reaches across a cut: whatever
   pair would lie across it occurs at most as often as the two symbols do.
2. The fragments of all words are counted. They are few, since they consist of frequent
   pairs only, and hold every occurrence of every pair that the round may choose. ``least`` is as low as
   the bound of distinct fragments allows.
3. One task merges the fragments greedily down to ``least``: these are the merges of the corpus.
4. Every block applies them by an index from pairs to words, and tells the changes of pair counts.

The bound of a pair holds as long as a symbol of the round has one way to be made of those
at its beginning. A merge that makes a string of bytes which was a symbol already ends the round.
The driver holds the merges alone. Blocks lie in the shared folder, a table a round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.bpe import END_OF_TEXT, Tokenizer
from textmill.session import Rounds, settle

#: Words of a block, distinct fragments of a round; the span of counts, from the greatest down, that a round tries first.
BLOCK, FRAGMENTS, SPAN = 50_000, 200_000, 8

Pair = tuple[int, int]


class Symbols:
    """Ids of byte strings: bytes first, then what merges make; equal strings are one symbol, however they came about."""

    def __init__(self, merges: Iterable[Pair] = ()):
        self.bytes = [bytes([b]) for b in range(256)]
        self.ids = {s: i for i, s in enumerate(self.bytes)}
        for pair in merges:
            self.merged(pair)

    def merged(self, pair: Pair) -> int:
        made = self.bytes[pair[0]] + self.bytes[pair[1]]
        if made not in self.ids:
            self.ids[made] = len(self.bytes)
            self.bytes.append(made)
        return self.ids[made]


class Words:
    """Words as lists of symbols, with an index of the words in which a pair may be."""

    def __init__(self, words: list[list[int]], weights: list[int]):
        self.words, self.weights = words, weights
        self.where: dict[Pair, set[int]] = defaultdict(set)
        for k, word in enumerate(words):
            for pair in zip(word, word[1:], strict=False):
                self.where[pair].add(k)

    def counts(self) -> dict[Pair, int]:
        total: dict[Pair, int] = defaultdict(int)
        for word, n in zip(self.words, self.weights, strict=True):
            for pair in zip(word, word[1:], strict=False):
                total[pair] += n
        return total

    def merge(self, pair: Pair, new: int) -> dict[Pair, int]:
        """Replace a pair from left to right in all words; returns how the pair counts change."""
        a, b = pair
        delta: dict[Pair, int] = defaultdict(int)
        where = self.where
        for k in where.pop(pair, ()):
            word, weight, begin = self.words[k], self.weights[k], 0
            while True:
                try:
                    at = word.index(a, begin)
                except ValueError:
                    break
                begin = at + 1
                if begin == len(word) or word[begin] != b:
                    continue
                # Only the pairs around this place change.
                if at:
                    left = word[at - 1]
                    delta[left, a] -= weight
                    delta[left, new] += weight
                    where[left, new].add(k)
                if at + 2 < len(word):
                    right = word[at + 2]
                    delta[b, right] -= weight
                    delta[new, right] += weight
                    where[new, right].add(k)
                delta[pair] -= weight
                word[at : at + 2] = [new]
        return delta


_FLIPPED = bytes(range(255, -1, -1))


def greedy(words: Words, symbols: Symbols, least: int, most: int) -> Iterator[Pair]:
    """At most so many merges of words while the most frequent pair occurs ``least`` times, the greatest of equals first.

    Ends behind a merge that makes a string which was a symbol already.
    """
    total = words.counts()
    flipped: dict[int, str] = {}

    def order(s: int) -> str:
        """A string whose order is the reverse of the symbol's: a symbol goes before all that begin it."""
        if s not in flipped:
            flipped[s] = symbols.bytes[s].translate(_FLIPPED).decode("latin-1") + "Ā"
        return flipped[s]

    heap = [(-n, order(p[0]), order(p[1]), p) for p, n in total.items() if n >= least]
    heapq.heapify(heap)
    while heap and most > 0:
        n, _, _, pair = heapq.heappop(heap)
        if total.get(pair) != -n:
            continue  # an entry that was overtaken
        yield pair
        most -= 1
        known = len(symbols.bytes)
        new = symbols.merged(pair)
        if new < known:
            return
        for p, change in words.merge(pair, new).items():
            now = total[p] = total.get(p, 0) + change
            if now < least:
                if not now:
                    del total[p]
            elif change:
                heapq.heappush(heap, (-now, order(p[0]), order(p[1]), p))


_COLUMNS = {"symbols": "int", "lengths": "int", "counts": "bigint", "pairs": "bigint", "changes": "bigint"}
_BLOCKS = ", ".join(f"{c} array<{t}>" for c, t in _COLUMNS.items())
_SCHEMA = pa.schema([(c, pa.list_(pa.int32() if t == "int" else pa.int64())) for c, t in _COLUMNS.items()])
_OWN = ["symbols", "lengths", "counts"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c.slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in batch.columns)


def _block(words: list[list[int]], counts: list[int], changes: dict[Pair, int] | None = None) -> pa.RecordBatch:
    """A block as a row, with the changes of its pair counts: at first these are all that it has."""
    symbols, lengths, counts = np.array([s for w in words for s in w], np.int32), np.array([len(w) for w in words], np.int32), np.array(counts, np.int64)
    if changes is None:
        pair, inside, word = _pairs(symbols, lengths)
        pairs, n = _summed(pair[inside], counts[word[:-1][inside]])
    else:
        some = [(a << 32 | b, n) for (a, b), n in changes.items() if n]
        pairs, n = np.array([p for p, _ in some], np.int64), np.array([n for _, n in some], np.int64)
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([symbols, lengths, counts, pairs, n], _SCHEMA, strict=True)], schema=_SCHEMA)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, n)
    return found, total


def _lists(symbols: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(lengths).tolist()
    flat = symbols.tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(size: int):
    """From tokens and counts to blocks of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = [], []
        for batch in batches:
            tokens += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(tokens) >= size:
                yield _block([list(t) for t in tokens[:size]], counts[:size])
                tokens, counts = tokens[size:], counts[size:]
        if tokens:
            yield _block([list(t) for t in tokens], counts)

    return run


def _pairs(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours as one number each, whether they are in one word, and the word of each symbol."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    return symbols[:-1].astype(np.int64) << 32 | symbols[1:], word[:-1] == word[1:], word


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pair, n``: the changes of all blocks of a task."""
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for own, changes in _rows(batches):
        pairs, n = _summed(np.concatenate([pairs, own]), np.concatenate([n, changes]))
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def _fragments(frequent: np.ndarray | None):
    """``fragment, n`` of each block: the parts of words of two symbols or more between pairs that are not among the sorted ``frequent`` ones; whole words without these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, lengths, counts in _rows(batches):
            pair, inside, word = _pairs(symbols, lengths)
            if frequent is not None:
                at = np.minimum(np.searchsorted(frequent, pair), max(len(frequent) - 1, 0))
                inside &= frequent[at] == pair if len(frequent) else False
            edge = np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(symbols)]]) if len(symbols) else np.zeros(1, np.int64)
            total: dict[bytes, int] = defaultdict(int)
            raw, begin = symbols.astype("<i4").tobytes(), edge[:-1]
            long = np.diff(edge) > 1
            for a, b, n in zip(begin[long].tolist(), edge[1:][long].tolist(), counts[word[begin[long]]].tolist(), strict=True):
                total[raw[4 * a : 4 * b]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["fragment", "n"])

    return run


def _merges(merges: list[Pair], least: int, most: int):
    """``step, left, right``: the merges of a round, from all fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("fragment", pa.binary()), ("n", pa.int64())]))
        words = Words([np.frombuffer(f, "<i4").tolist() for f in table.column(0).to_pylist()], table.column(1).to_pylist())
        found = list(greedy(words, Symbols(merges), least, most))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), *(pa.array([p[i] for p in found], pa.int32()) for i in (0, 1))], names=["step", "left", "right"])

    return run


def _applied(merges: list[tuple[Pair, int]]):
    """Blocks after the merges of a round; words of one symbol are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, lengths, counts in _rows(batches):
            words, changes = Words(_lists(symbols, lengths), counts.tolist()), defaultdict(int)
            for pair, new in merges:
                for p, n in words.merge(pair, new).items():
                    changes[p] += n
            left = [(w, n) for w, n in zip(words.words, words.weights, strict=True) if len(w) > 1]
            yield _block([w for w, _ in left], [n for _, n in left], changes)

    return run


def train(counts: DataFrame, vocab_size: int, specials: Iterable[str] = (END_OF_TEXT,), min_count: int = 1, fragments: int = FRAGMENTS, block: int = BLOCK) -> Tokenizer:
    """Greedy merges until the vocabulary is full or no pair is left; ties go to the greatest pair.

    ``counts`` has ``token, n``, a row for each distinct token; tokens that occur less than ``min_count`` times
    are left out (``frequent_pretokens`` finds the others without counting all). ``fragments`` bounds what
    one task holds: it decides how many rounds there are, never what is merged.
    """
    specials, merges = list(specials), []
    wanted = max(0, vocab_size - 256 - len(specials))
    words = counts.where((F.octet_length("token") > 1) & (F.col("n") >= min_count)).select(F.col("token").cast("binary").alias("token"), F.col("n").cast("long").alias("n"))
    tables, counted, span = Rounds(counts), Rounds(counts), SPAN
    state = tables.store(words.mapInArrow(_blocks(block), _BLOCKS))
    pairs = state.where("false").selectExpr("0L AS pair", "0L AS n")
    while len(merges) < wanted:
        changes = state.select("pairs", "changes").mapInArrow(_told, "pair long, n long")
        pairs = counted.store(pairs.unionByName(changes).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"))
        top = pairs.agg(F.max("n")).first()[0]
        if top is None:
            break
        held = state.agg(F.sum(F.size("counts"))).first()[0]
        symbols = Symbols(merges)
        least, found, limit = _round(state, pairs, top, 1 if held <= fragments else max(1, top // span), fragments, symbols)
        steps = found.coalesce(1).mapInArrow(_merges(merges, least, limit or wanted - len(merges)), "step int, left int, right int").collect()  # merges
        chosen = [(r["left"], r["right"]) for r in sorted(steps)]
        state = tables.store(state.select(_OWN).mapInArrow(_applied([(p, symbols.merged(p)) for p in chosen]), _BLOCKS))
        merges += chosen
        # Rounds reach as far down as fragments allow: four times as far each time that there is room.
        span = max(2, top // least) * (4 if found.count() <= fragments // 4 else 1)
    tables.close()
    counted.close()
    symbols = Symbols(merges)
    return Tokenizer([(symbols.bytes[a], symbols.bytes[b]) for a, b in merges], specials)


def _round(state: DataFrame, pairs: DataFrame, top: int, least: int, most: int, symbols: Symbols) -> tuple[int, DataFrame, int | None]:
    """The lowest count of a round, ``least`` or so much more that fragments and frequent pairs are ``most`` at most; the fragments, and a bound of merges."""

    def cut(frequent: np.ndarray | None) -> DataFrame:
        return settle(state.select(_OWN).mapInArrow(_fragments(frequent), "fragment binary, n long").groupBy("fragment").agg(F.sum("n").alias("n")))

    while True:
        rows = pairs.where(F.col("n") >= least).select("pair").limit(most + 1).toArrow() if least > 1 else None  # a bounded broadcast
        if rows is None or rows.num_rows <= most:
            found = cut(None if rows is None else np.sort(rows.column(0).to_numpy()))
            if found.count() <= most:
                return least, found, None
        if least >= top:
            # Too many pairs are equally frequent: the greatest of them is a round.
            return top, cut(np.array([_greatest(pairs.where(F.col("n") == top), symbols)])), 1
        least = min(top, max(least + 1, int((least * top) ** 0.5)))


def _greatest(pairs: DataFrame, symbols: Symbols) -> int:
    """The pair with the greatest bytes; of each batch one comes to the driver."""
    known = symbols.bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = max(batch.column(0).to_pylist(), key=lambda p: (known[p >> 32], known[p & 0xFFFFFFFF]), default=None)
            yield pa.RecordBatch.from_arrays([pa.array([] if best is None else [best], pa.int64())], names=["pair"])

    return max((r["pair"] for r in pairs.select("pair").mapInArrow(run, "pair long").collect()), key=lambda p: (known[p >> 32], known[p & 0xFFFFFFFF]))
