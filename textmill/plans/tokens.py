"""Queries over tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import bpe as B
from textmill.operators.bpe_train import train
from textmill.plans.text import WORDS
from textmill.session import stored, table

QUERIES: dict = {}
SQL: dict = {}

# RE2 has no look-ahead: a mark before the last space of a run that a word follows does its work.
_MARKED = r"regexp_replace(text, '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g')"
_TOKENS = rf"list_filter(regexp_extract_all({_MARKED}, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+|\x01'), lambda x: x <> chr(1))"
_COUNTS = f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token"
_BYTES = "SELECT hex(encode(token)) AS c, n FROM k"
_PAIRS = f"SELECT substr(c, 2 * i + 1, 2) AS \"left\", substr(c, 2 * i + 3, 2) AS \"right\", sum(n)::BIGINT AS n FROM (SELECT c, n, unnest(range(0, length(c) // 2 - 1)) AS i FROM ({_BYTES})) GROUP BY ALL"


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pre-tokens (TX11, TX12, AG2)."""
    return B.pretoken_counts(table(spark, sf_dir, "documents"))


QUERIES["pretoken_counts"] = pretoken_counts
SQL["pretoken_counts"] = f"SELECT token, n FROM ({_COUNTS})"


#: Occurrences that a pre-token needs to be reported as frequent.
FREQUENT = 5


def frequent_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of frequent pre-tokens, without a shuffle of the rare ones (AG2 under a bound)."""
    return B.frequent_pretokens(table(spark, sf_dir, "documents"), FREQUENT)


QUERIES["frequent_pretokens"] = frequent_pretokens
SQL["frequent_pretokens"] = f"SELECT token, n FROM ({_COUNTS}) WHERE n >= {FREQUENT}"


def byte_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted counts of adjacent bytes (TX13, AG3, WN2)."""
    return B.pair_counts(B.pretoken_counts(table(spark, sf_dir, "documents")))


QUERIES["byte_pair_counts"] = byte_pair_counts
SQL["byte_pair_counts"] = f"WITH k AS ({_COUNTS}) {_PAIRS}"


def bpe_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merge: the most frequent pair, of equals the greatest (AG5)."""
    pairs = B.pair_counts(B.pretoken_counts(table(spark, sf_dir, "documents")))
    best = pairs.agg(F.max(F.struct("n", "left", "right")).alias("b"))
    return best.select("b.left", "b.right", "b.n")


QUERIES["bpe_best_pair"] = bpe_best_pair
SQL["bpe_best_pair"] = f'WITH k AS ({_COUNTS}) SELECT "left", "right", n FROM ({_PAIRS}) ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1'

VOCABULARY = 10_000


def tokenizer(spark: SparkSession, sf_dir: str, size: int = VOCABULARY) -> B.Tokenizer:
    """The tokenizer of a corpus: trained and stored once a session, then loaded, as long as the files of the table are the same."""

    def make(path: str) -> B.Tokenizer:
        made = train(B.pretoken_counts(table(spark, sf_dir, "documents")), size)
        B.save_tokenizer(spark, made, path)
        return made

    return stored(spark, sf_dir, f"tokenizer-{size}", ("documents",), lambda path: B.load_tokenizer(spark, path), make)


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of a trained vocabulary (CP5, AG4, JN10)."""
    rows = [(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(tokenizer(spark, sf_dir).merges)]
    return spark.createDataFrame(rows, "rank int, left binary, right binary")


QUERIES["bpe_merges"] = bpe_merges


def bpe_vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest entry and next free id of a vocabulary (AG14, AG23, SK6)."""
    vocab = spark.createDataFrame([(i, bytearray(b)) for i, b in tokenizer(spark, sf_dir).vocab.items()], "token_id int, bytes binary")
    return vocab.agg(F.max_by("token_id", F.struct(F.octet_length("bytes"), "bytes")).alias("longest_id"), (F.max("token_id") + 1).alias("next_id"))


QUERIES["bpe_vocab_stats"] = bpe_vocab_stats


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document with an end-of-text id (CP6, CP9, JN6, JN7)."""
    coded = B.encode(table(spark, sf_dir, "documents"), tokenizer(spark, sf_dir), end=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


QUERIES["bpe_encode"] = bpe_encode


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding of the encoding (CP8, JN8): every text comes back, which SQL can say without tokens."""
    docs = table(spark, sf_dir, "documents")
    coder = tokenizer(spark, sf_dir)
    return B.decode(B.encode(docs, coder), coder).select("doc_id", F.md5("text").alias("text_md5"))


QUERIES["bpe_roundtrip"] = bpe_roundtrip
SQL["bpe_roundtrip"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per token by source and in all (TX14, AG13, AG22, CP20)."""
    docs = table(spark, sf_dir, "documents")
    coded = B.encode(docs, tokenizer(spark, sf_dir)).join(docs.select("doc_id", "source", F.octet_length("text").alias("bytes")), "doc_id")
    sums = coded.rollup("source").agg(F.sum("bytes").alias("bytes"), F.sum(F.size("ids")).alias("tokens"))
    return sums.select("source", "bytes", "tokens", F.try_divide("bytes", "tokens").alias("ratio"))


QUERIES["compression_ratio"] = compression_ratio


def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows over a sequence of all documents (WN7, WN10, ST4); tokens are word lengths, so that SQL can say it."""
    docs = table(spark, sf_dir, "documents")
    lengths = F.transform(F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"), lambda w: F.length(w).cast("int"))
    windows = B.pack(docs.select("doc_id", lengths.alias("ids")), 128)
    text = [F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), ",")).alias(f"{c}_md5") for c in "xy"]
    return windows.select(F.col("win").cast("long").alias("win"), *text)


_FLAT = f"SELECT row_number() OVER (ORDER BY doc_id, no) - 1 AS place, t FROM (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS no, length(w)::INTEGER AS t FROM documents)"
QUERIES["pack_windows"] = pack_windows
SQL["pack_windows"] = f"""WITH f AS ({_FLAT}),
  x AS (SELECT place // 128 AS win, count(*) AS n, md5(string_agg(t::VARCHAR, ',' ORDER BY place)) AS d FROM f GROUP BY win),
  y AS (SELECT (place - 1) // 128 AS win, count(*) AS n, md5(string_agg(t::VARCHAR, ',' ORDER BY place)) AS d FROM f WHERE place > 0 GROUP BY win)
  SELECT x.win, x.d AS x_md5, y.d AS y_md5 FROM x JOIN y ON x.win = y.win WHERE x.n = 128 AND y.n = 128"""


#: Characters of the prefix report.
PREFIX = 5 * 1024 * 1024


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents in order until a prefix of characters is full, with an end mark (SC10, SK7)."""
    rows = B.prefix(table(spark, sf_dir, "documents"), PREFIX)
    return rows.select("doc_id", (F.col("before") + F.length("text")).alias("upto"), F.md5(F.concat("text", F.lit(B.END_OF_TEXT))).alias("text_md5"))


QUERIES["first_documents"] = first_documents
SQL["first_documents"] = f"""SELECT doc_id, upto, md5(text || '{B.END_OF_TEXT}') AS text_md5 FROM
  (SELECT doc_id, text, sum(length(text)) OVER (ORDER BY doc_id)::BIGINT AS upto FROM documents) WHERE upto - length(text) < {PREFIX}"""


def ten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents with their end mark, which is the whole of this report (SC9, SO9)."""
    first = table(spark, sf_dir, "documents").orderBy("doc_id").limit(10)
    return first.select("doc_id", F.concat("text", F.lit(B.END_OF_TEXT)).alias("text"))


QUERIES["ten_documents"] = ten_documents
SQL["ten_documents"] = f"SELECT doc_id, text || '{B.END_OF_TEXT}' AS text FROM documents ORDER BY doc_id LIMIT 10"
