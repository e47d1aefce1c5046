"""Byte-pair encoding: counts of pre-tokens, tokenizers, encoding in Arrow batches, windows. Training is in ``bpe_train``."""

from __future__ import annotations

import heapq
import io
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.text import PRETOKEN, PRETOKEN_JVM
from textmill.operators.sketch import frequent
from textmill.session import settle

END_OF_TEXT = "<|endoftext|>"
#: Bytes or characters up to which a pre-token is merged by plain search and remembered, pre-tokens that are remembered, rows a time.
SHORT, REMEMBERED, ROWS = 64, 500_000, 256


def without_specials(text: Column, specials: Iterable[str]) -> Column:
    """The parts of a text between special tokens, longest special first."""
    names = sorted(specials, key=len, reverse=True)
    return F.split(text, "|".join(f"\\Q{s}\\E" for s in names)) if names else F.array(text)


def pretokens(docs: DataFrame, specials: Iterable[str] = (END_OF_TEXT,), text_col: str = "text") -> DataFrame:
    """``token``: a row for each pre-token; special tokens are no part of any."""
    parts = F.flatten(F.transform(without_specials(F.coalesce(F.col(text_col), F.lit("")), specials), lambda x: F.regexp_extract_all(x, F.lit(PRETOKEN_JVM), F.lit(0))))
    return docs.select(F.explode(parts).alias("token"))


def pretoken_counts(docs: DataFrame, specials: Iterable[str] = (END_OF_TEXT,), text_col: str = "text") -> DataFrame:
    return pretokens(docs, specials, text_col).groupBy("token").agg(F.count("*").alias("n"))


def frequent_pretokens(docs: DataFrame, least: int, specials: Iterable[str] = (END_OF_TEXT,), text_col: str = "text") -> DataFrame:
    """``token, n``: as ``pretoken_counts``, of the tokens that occur ``least`` times or more; rarer ones are dropped by a sketch before the shuffle."""
    return frequent(pretokens(docs, specials, text_col), "token", least)


def symbols(token: Column) -> Column:
    """The bytes of a token as hexadecimal symbols."""
    code = F.hex(F.encode(token, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))


def pair_counts(counts: DataFrame) -> DataFrame:
    """``left, right, n``: how often two bytes stand side by side, weighted by the counts of the tokens."""
    pairs = F.transform(F.array(symbols(F.col("token"))), lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("left"), F.get(s, i + 1).alias("right"))), lambda p: p["right"].isNotNull()))[0]
    return counts.select(F.explode(pairs).alias("p"), "n").groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


@dataclass
class Tokenizer:
    """A vocabulary with its merges; without a stored vocabulary ids are bytes, then specials, then merges in their order.

    A special token that the vocabulary already has keeps its id; others get the next ids.
    """

    merges: list[tuple[bytes, bytes]]
    specials: list[str] = field(default_factory=lambda: [END_OF_TEXT])
    vocab: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        if not self.vocab:
            self.vocab = dict(enumerate([bytes([b]) for b in range(256)] + [s.encode() for s in self.specials] + [a + b for a, b in self.merges]))
        self.ids: dict[bytes, int] = {}
        for i, t in sorted(self.vocab.items()):
            self.ids.setdefault(t, i)
        for s in self.specials:
            if s.encode() not in self.ids:
                new = max(self.vocab, default=-1) + 1
                self.vocab[new], self.ids[s.encode()] = s.encode(), new
        #: For each pair of ids that is merged: its rank and the id that it becomes.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (a, b) in enumerate(self.merges):
            self.rank.setdefault((self.ids[a], self.ids[b]), (i, self.ids[a + b]))
        self.byte = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.seen: dict[str, list[int]] = {}

    def encode_token(self, token: bytes) -> list[int]:
        """Merge the pair of lowest rank, from left to right, until no pair has a rank."""
        parts = [self.byte[b] for b in token]
        return parts if len(parts) < 2 else self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        get, none = self.rank.get, (1 << 60, -1)
        while len(parts) > 1:
            (rank, new), at = min((get(p, none), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if new < 0:
                break
            pair = (parts[at], parts[at + 1])
            parts = parts[:at] + _replaced(parts, at, pair, new)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """As ``_short``, by a heap over a linked list: a token of n bytes costs n log n."""
        n, gone = len(parts), -2
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.rank[p], k, p) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, new, k, (x, y) = heapq.heappop(heap)
            right = after[k]
            if parts[k] != x or right < 0 or parts[right] != y:
                continue
            parts[k], parts[right] = new, gone
            after[k] = after[right]
            if after[right] >= 0:
                before[after[right]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] >= 0 and (p := (parts[at], parts[after[at]])) in self.rank:
                    heapq.heappush(heap, (*self.rank[p], at, p))
        return [x for x in parts if x != gone]

    def encode_cut(self, tokens: Iterable[str]) -> list[int]:
        """Ids of pre-tokens and special tokens. Short ones are remembered, up to a bound; then memory starts anew."""
        out: list[int] = []
        for t in tokens:
            got = self.seen.get(t)
            if got is None:
                got = [self.ids[t.encode()]] if t in self.specials else self.encode_token(t.encode())
                if len(t) <= SHORT:
                    if len(self.seen) >= REMEMBERED:
                        self.seen.clear()
                    self.seen[t] = got
            out += got
        return out

    def cut(self, text: str) -> Iterator[str]:
        """Pre-tokens and special tokens of one text, without Spark."""
        import regex

        marks = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        for part in regex.split(f"({marks})", text) if marks else [text]:
            yield from [part] if part in self.specials else regex.findall(PRETOKEN, part)

    def encode_iterable(self, texts: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of texts, one at a time; no token crosses two texts."""
        for text in texts:
            yield from self.encode_cut(self.cut(text))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, bad bytes replaced; an unknown id is an error."""
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", errors="replace")


def _replaced(parts: list[int], start: int, pair: tuple[int, int], new: int) -> list[int]:
    """What becomes of the parts from ``start`` on when each occurrence of a pair is replaced, from the left."""
    out, i, n = [], start, len(parts)
    x, y = pair
    while i < n:
        if parts[i] == x and i + 1 < n and parts[i + 1] == y:
            out.append(new)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    """The vocabulary as ``token_id, bytes, special`` and the merges as ``rank, left, right``, in Parquet."""
    special = {s.encode() for s in tokenizer.specials}
    spark.createDataFrame([(i, bytearray(b), b in special) for i, b in tokenizer.vocab.items()], "token_id int, bytes binary, special boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(tokenizer.merges)], "rank int, left binary, right binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """A tokenizer that ``save_tokenizer`` wrote."""
    vocab = spark.read.parquet(f"{path}/vocabulary").orderBy("token_id").collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return Tokenizer([(bytes(r["left"]), bytes(r["right"])) for r in merges], [bytes(r["bytes"]).decode() for r in vocab if r["special"]], {r["token_id"]: bytes(r["bytes"]) for r in vocab})


def unpickle_tokenizer(vocab: bytes, merges: bytes, specials: Iterable[str] = (END_OF_TEXT,)) -> Tokenizer:
    """A tokenizer from a pickled ``{id: bytes}`` and a pickled list of pairs of bytes; pickles that name any class or function are refused."""

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            raise pickle.UnpicklingError(f"{module}.{name} is no part of a vocabulary")

    return Tokenizer([tuple(p) for p in Plain(io.BytesIO(merges)).load()], list(specials), dict(Plain(io.BytesIO(vocab)).load()))


def cut_texts(text: Column, specials: Iterable[str]) -> Column:
    """Pre-tokens and special tokens of a text, in order."""
    names = sorted(specials, key=len, reverse=True)
    special = "|".join(f"\\Q{s}\\E" for s in names)
    # Parts and the specials between them alternate.
    parts = F.split(text, special) if names else F.array(text)
    marks = F.regexp_extract_all(text, F.lit(f"({special})"), F.lit(1)) if names else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(parts, lambda x, i: F.concat(F.regexp_extract_all(x, F.lit(PRETOKEN_JVM), F.lit(0)), F.when(F.get(marks, i).isNotNull(), F.array(F.get(marks, i))).otherwise(none))))


def _encoded(tokens: pa.ListArray, coder: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of pre-tokens and where each row ends: distinct pre-tokens are encoded once and put in place by vectors."""
    coded = tokens.flatten().dictionary_encode()
    each = [coder.encode_cut([t]) for t in coded.dictionary.to_pylist()]
    size = np.array([len(x) for x in each], np.int64)
    pool, start = np.array([i for x in each for i in x], np.int64), np.cumsum(size) - size
    at = coded.indices.to_numpy()
    n = size[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
    return ids, ends[np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", end: bool = False) -> DataFrame:
    """``doc_id, ids``: token ids of each text; special tokens are one id each; ``end`` appends the end-of-text id.

    Texts are cut into pre-tokens in the JVM and encoded in Arrow batches: no shuffle,
    and a worker encodes a distinct pre-token of some rows, or one that it remembers, once.
    """
    spark = docs.sparkSession
    tail = [tokenizer.ids[END_OF_TEXT.encode()]] if end else []
    sent = spark.sparkContext.broadcast((tokenizer.merges, tokenizer.specials, tokenizer.vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(*sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids, ends = _encoded(part.column(1), coder)
                if tail:
                    ids, ends = np.insert(ids, ends, tail[0]), ends + 1 + np.arange(len(ends))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), cut_texts(F.coalesce(F.col(text_col), F.lit("")), tokenizer.specials).alias("tokens")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``doc_id, text``: bytes that are no UTF-8 are replaced; an unknown id is an error."""
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if unknown := [i for i in ids or () if i not in vocab]:
                    raise ValueError(f"unknown token id {unknown[0]}")
                texts.append(b"".join(vocab[i] for i in ids or ()).decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def before_each(sized: DataFrame, bucket: int = 1024) -> DataFrame:
    """``sized``, of ``id`` and ``n`` at least, with ``before``: the sum of n over lesser ids; rows of one id in the order of n.

    Ids are whole numbers. Sums of buckets of ids are added up in two levels and then
    within each bucket, so no task sorts more than the buckets of a bucket of buckets:
    for 10**10 ids the topmost task has 10**4 rows.
    """
    rows = sized.withColumn("_low", F.floor(F.col("id") / bucket)).withColumn("_high", F.floor(F.col("_low") / bucket))
    low = settle(rows.groupBy("_high", "_low").agg(F.sum("n").alias("_n")))
    high = low.groupBy("_high").agg(F.sum("_n").alias("_n"))

    def earlier(order: Window) -> Column:
        return F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    high = high.select("_high", earlier(Window.orderBy("_high")).alias("_start"))
    low = low.join(high, "_high").select("_low", (F.col("_start") + earlier(Window.partitionBy("_high").orderBy("_low"))).alias("_start"))
    within = Window.partitionBy("_low").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(low, "_low").withColumn("before", F.col("_start") + F.sum("n").over(within) - F.col("n")).drop("_low", "_high", "_start")


def prefix(docs: DataFrame, characters: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, before``: the first documents by id until so many characters are full; the last one may go beyond."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n"))
    # Only ids and lengths are summed; the texts of the prefix are joined to what is left.
    first = before_each(rows.select("id", "n")).where(F.col("before") < characters).select("id", "before").distinct()
    return rows.join(first, "id").select(F.col("id").alias("doc_id"), "text", "before")


def pack(rows: DataFrame, length: int, order: str = "doc_id", bucket: int = 1024) -> DataFrame:
    """Training windows over the sequence of all tokens in the order of ids: ``win, x, y``; y is x shifted by one.

    A token's place is the number of tokens before it, as ``before_each`` counts. Each
    document is cut at the bounds of windows, and its slices travel, a row for each window that it
    reaches into. A window has one token more than its inputs, the last target, which is
    the first input of the next window. The last window that can't be filled is left out. Ids are whole numbers.
    """
    sized = rows.select(F.col(order).cast("long").alias("id"), "ids", F.size("ids").cast("long").alias("n")).where("n > 0")
    placed = before_each(settle(sized), bucket).withColumnRenamed("before", "start")
    first, last = F.greatest(F.floor((F.col("start") - 1) / length), F.lit(0)), F.floor((F.col("start") + F.col("n") - 1) / length)

    def piece(win: Column) -> Column:
        """What a document has of the tokens from the beginning of a window to the first of the next."""
        begin = F.greatest(win * length, F.col("start"))
        end = F.least((win + 1) * length, F.col("start") + F.col("n") - 1)
        return F.struct(win.alias("win"), begin.alias("at"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), (end - begin + 1).cast("int")).alias("part"))

    pieces = placed.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("p.*")
    whole = pieces.groupBy("win").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("all"))
    return whole.where(F.size("all") == length + 1).select("win", F.slice("all", 1, length).alias("x"), F.slice("all", 2, length).alias("y"))


def random_windows(rows: DataFrame, length: int, count: int, seed: int = 0, order: str = "doc_id") -> DataFrame:
    """``draw, start, x, y``: windows at drawn places of the sequence of all tokens; y is x shifted by one.

    Starts are uniform up to the last window that has a target, and depend on the seed
    only. A sequence that is too short gives no window. Only tokens near drawn windows
    travel.
    """
    sized = before_each(settle(rows.select(F.col(order).cast("long").alias("id"), "ids", F.size("ids").cast("long").alias("n"))))
    total = sized.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    places = total - length
    if places < 1:
        return rows.sparkSession.createDataFrame([], "draw long, start long, x array<int>, y array<int>")
    draws = rows.sparkSession.range(count).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(places)).alias("start"))
    step = 4096
    near = draws.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + length) / step))))

    def piece(cell: Column) -> Column:
        begin = F.greatest(cell * step, F.col("before"))
        end = F.least((cell + 1) * step, F.col("before") + F.col("n"))
        return F.struct(cell.alias("cell"), begin.alias("at"), F.slice("ids", (begin - F.col("before") + 1).cast("int"), (end - begin).cast("int")).alias("part"))

    cells = F.sequence(F.floor(F.col("before") / step), F.floor((F.col("before") + F.col("n") - 1) / step))
    pieces = sized.where("n > 0").select(F.explode(F.transform(cells, piece)).alias("p")).select("p.*")
    begin = F.greatest(F.col("at"), F.col("start"))
    end = F.least(F.col("at") + F.size("part"), F.col("start") + length + 1)
    hit = pieces.join(near, "cell").where(begin < end).select("draw", "start", begin.alias("at"), F.slice("part", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    built = hit.groupBy("draw", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("all"))
    return built.where(F.size("all") == length + 1).select("draw", "start", F.slice("all", 1, length).alias("x"), F.slice("all", 2, length).alias("y"))
