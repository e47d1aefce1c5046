"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: for the beginning of a word and for what
follows. Each node has a failure link, to the node of what is left after the
longest pieces are taken from the front of the node's string, and the number of
these pieces. A word then costs one step a character, and its pieces are counted
without being built. Words repeat, so a worker remembers the counts of the words
that it has seen.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import SPACE, parts_of, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the beginning of a word in the vocabulary.
BEGIN = "▁"
NONE = -1


class LongestMatch:
    """Greedy longest-match piece counts. Pieces that begin with ``BEGIN`` begin a word, all others continue one."""

    def __init__(self, pieces: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        ends = {}
        for piece in pieces:
            node = 0 if piece.startswith(BEGIN) else 1
            for c in piece:
                node = self.go[node].setdefault(c, len(self.go))
                if node == len(self.go):
                    self.go.append({})
            ends[node] = bool(piece)
        self.fail, self.popped = [NONE] * len(self.go), [0] * len(self.go)
        line = deque([0, 1])
        while line:
            parent = line.popleft()
            for c, node in self.go[parent].items():
                line.append(node)
                if ends.get(node):
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                back, count = self.fail[parent], self.popped[parent]
                while back != NONE and c not in self.go[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back != NONE:
                    self.fail[node], self.popped[node] = self.go[back][c], count

    def count(self, word: str) -> int | None:
        """Pieces of a word, or None if the greedy walk meets a character that no piece can take."""
        go, fail, popped = self.go, self.fail, self.popped
        node, count = 0, 0
        for c in BEGIN + word:
            while c not in go[node]:
                if fail[node] == NONE:
                    return None
                count += popped[node]
                node = fail[node]
            node = go[node][c]
        while node != 1:
            if fail[node] == NONE:
                return None
            count += popped[node]
            node = fail[node]
        return count


class _Seen(dict):
    """Counts of words that were seen, up to a bound; then it starts anew."""

    def __init__(self, automaton: LongestMatch, bound: int = 300_000, longest: int = 64):
        super().__init__()
        self.automaton, self.bound, self.longest = automaton, bound, longest

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        n = -1 if n is None else n
        if len(word) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a sentencepiece model that stand for text: no control, unknown or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", most_pieces: int = 2_000_000) -> DataFrame:
    """Words and greedy word pieces of each text: ``doc_id, n_words, n_tokens, n_unknown``.

    A word whose greedy walk gets stuck is one unknown token, counted in both.
    Null and empty texts have no words; null and repeated ids, and other columns,
    change nothing. Texts are read whole. More than ``most_pieces`` pieces are
    refused, since the vocabulary is broadcast.
    """
    if len(pieces) > most_pieces:
        raise ValueError(f"{len(pieces)} pieces are more than most_pieces={most_pieces}, which bounds the broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        seen, space = _Seen(LongestMatch(sent.value)), re.compile(SPACE)
        for batch in parts_of(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                got = [seen[w] for w in space.split(text or "") if w]
                lost = got.count(-1)
                rows.append((len(got), sum(got) + 2 * lost, lost))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces())
