"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as words: lower case, letters and digits only. An
item of m words may differ from a passage in k = floor(rate * m) words. Cut into
k + 1 pieces, at least one piece of it then stands unchanged in the passage. One
Aho-Corasick automaton finds all pieces in one walk over a text; each hit
fixes where the item would lie, and Myers' bit-parallel algorithm, with an item's
words as symbols, gives the least edit distance of the item to any passage there.
Items go out in blocks of bounded size, so the benchmark may be larger than one
broadcast; the documents never shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import parts_of, settle, table

#: Words that may differ, per word of an item; characters of items in one broadcast.
RATE, BLOCK = 0.2, 2_000_000
_WORDS = re.compile(r"[^\W_]+")


def normal_words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def pieces_of(words: list[str], k: int) -> list[tuple[int, list[str]]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    n = min(k + 1, len(words))
    cut = [i * len(words) // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers(masks: dict[str, int], m: int, text: list[str], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern of m symbols to a substring of the text, and the first place where it ends.

    With ``anchored`` the substring begins where the text does.

    ``masks`` has for each symbol the bits of its positions in the pattern. Python's
    integers are the bit vectors, so a pattern may be of any length.
    """
    full = (1 << m) - 1
    last = 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        # Unless it is anchored the pattern may begin anywhere: the top row is 0 throughout.
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of a block, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, at = [], {}
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            budget, masks = int(rate * len(words)), {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            for offset, piece in pieces_of(words, budget):
                at.setdefault(" " + " ".join(piece) + " ", []).append((len(self.items), offset))
            self.items.append((item, len(words), budget, masks))
        self.finder = ahocorasick.Automaton()
        for piece, where in at.items():
            self.finder.add_word(piece, (len(piece), where))
        if at:
            self.finder.make_automaton()
        self.empty = not at

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, distance, first word, words)`` of the best passage for each item within its budget."""
        words = normal_words(text)
        if self.empty or not words:
            return []
        line = " " + " ".join(words) + " "
        tried: dict[int, list[list[int]]] = {}
        count, place = 0, 0  # words before a place in the line
        for end, (size, where) in self.finder.iter(line):
            begin = end - size + 1
            count += line.count(" ", place, begin) if begin >= place else -line.count(" ", begin, place)
            place = begin
            for k, offset in where:
                _, m, budget, _ = self.items[k]
                spans = tried.setdefault(k, [])
                low, high = max(0, count - offset - budget), min(len(words), count - offset + m + budget)
                # Hits of one item lie in growing order but for the offsets: ranges that meet become one.
                if spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    spans[-1] = [min(low, spans[-1][0]), max(high, spans[-1][1])]
                else:
                    spans.append([low, high])
        found = []
        for k, spans in tried.items():
            item, m, budget, masks = self.items[k]
            best = None
            for low, high in spans:
                distance, end = myers(masks, m, words[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                distance, end = best
                begin = end - self._length(masks, m, words[max(0, end - m - distance) : end])
                found.append((item, distance, begin, end - begin))
        return sorted(found)


    @staticmethod
    def _length(masks: dict[str, int], m: int, words: list[str]) -> int:
        """Words of the shortest passage at the end of some words that has the least distance: the item backwards over them."""
        back = {w: sum(1 << m - 1 - i for i in range(m) if bits >> i & 1) for w, bits in masks.items()}
        return myers(back, m, words[::-1], anchored=True)[1]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Benchmark items in texts: ``doc_id, item_id, distance, first_word, n_words``, the best passage of each pair.

    ``distance`` is the number of words that differ, ``rate`` times the item's words
    at most; ``first_word`` and ``n_words`` say where the passage lies among the
    normalised words of the text: the first that ends earliest, and the shortest of
    those with this end. Null and empty texts and items match nothing; rows with
    a null id are matched and keep it; repeated rows match each. Items with a null
    or repeated id are items of their own. Texts are read whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _matches(docs, benchmark, rate, block)


def _matches(docs: DataFrame, benchmark: DataFrame, rate: float, block: int) -> DataFrame:
    """The matches of ``docs`` with ``id, text``; an id may be of any type."""
    schema = f"doc_id {docs.schema['id'].dataType.simpleString()}, item_id long, distance long, first_word long, n_words long"
    out = None
    for items in _blocks(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        found = docs.mapInArrow(_finder(sent, rate), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read partition by partition."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1])
        if size >= block:
            yield items
            items, size = [], 0
    if items:
        yield items


#: The matcher of the last block that a worker process had: the tasks that follow one another there share it.
_HELD: dict[tuple, Matcher] = {}


def _finder(sent, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        key = (rate, len(items), hash(tuple(items)))
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Matcher(items, rate)
        matcher = _HELD[key]
        for batch in parts_of(batches, "text"):
            found = [(k, *x) for k, text in enumerate(batch.column(1).to_pylist()) for x in matcher.find(text)]
            ids = batch.column(0).take(pa.array([r[0] for r in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in found], pa.int64()) for k in range(1, 5))], names=["doc_id", "item_id", "distance", "first_word", "n_words"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns.

    A document is known by 128 bits of its text, so that every row is judged by its own
    text, whether its id is null or repeated.
    """
    key = "_decontamination_key"
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    found = _matches(keyed.select(F.col(key).alias("id"), F.col(text_col).alias("text")), benchmark, rate, BLOCK)
    hit = settle(found.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
