"""Queries over exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import dedup as D
from textmill.plans.text import GRAMS
from textmill.session import table

QUERIES: dict = {}
SQL: dict = {}

HASHES, BANDS = 128, 16
_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents"


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each line occurs (AG1, TX15)."""
    lines = D.line_table(table(spark, sf_dir, "documents"))
    return lines.groupBy("line").agg(F.count("*").alias("n")).select(F.md5("line").alias("line_md5"), "n")


QUERIES["line_counts"] = line_counts
SQL["line_counts"] = f"SELECT md5(line) AS line_md5, count(*) AS n FROM ({_LINES}) GROUP BY line"


def exact_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, as digests (CP2, JN1, SK2)."""
    return D.exact_line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.md5("text").alias("text_md5"))


_ONCE = f"SELECT line, min(doc_id) AS doc_id, min(no) AS no FROM ({_LINES}) GROUP BY line HAVING count(*) = 1"
QUERIES["exact_line_dedup"] = exact_line_dedup
SQL["exact_line_dedup"] = f"""SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, md5(coalesce(k.t, '')) AS text_md5 FROM documents d LEFT JOIN
  (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY no) AS t FROM ({_ONCE}) GROUP BY doc_id) k ON d.doc_id = k.doc_id"""


def line_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``exact_line_dedup``, but the first copy of each line stays."""
    return D.exact_line_dedup(table(spark, sf_dir, "documents"), keep="first").select("doc_id", "n_lines", F.md5("text").alias("text_md5"))


_FIRST = f"SELECT line, doc_id, no FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS k FROM ({_LINES})) WHERE k = 1"
QUERIES["line_dedup_first"] = line_dedup_first
SQL["line_dedup_first"] = SQL["exact_line_dedup"].replace(_ONCE, _FIRST)

_SIGS = f"""SELECT doc_id, i, min((a + i * b) % {D.PRIME})::BIGINT AS h FROM
  (SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS a, ('0x' || substr(md5(gram), 9, 8))::BIGINT AS b FROM (SELECT doc_id, unnest(g) AS gram FROM ({GRAMS}))),
  (SELECT unnest(range(0, {HASHES})) AS i) GROUP BY doc_id, i"""
_BUCKETS = f"SELECT doc_id, (i // {HASHES // BANDS})::INTEGER AS band, md5(string_agg(h::VARCHAR, ',' ORDER BY i)) AS key FROM ({_SIGS}) GROUP BY doc_id, i // {HASHES // BANDS}"
_SETS = f"SELECT doc_id, g, min(doc_id) OVER (PARTITION BY list_sort(g)) AS class FROM ({GRAMS})"
_PAIRS = f"""SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id"""
_WITH = f"WITH s AS MATERIALIZED ({_SETS}), reps AS (SELECT doc_id, g FROM s WHERE doc_id = class), b AS MATERIALIZED (SELECT * FROM ({_BUCKETS}) WHERE doc_id IN (SELECT doc_id FROM reps)), p AS ({_PAIRS})"
_VERIFIED = """j AS (SELECT u, v, CASE WHEN len(x.g) + len(y.g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))) END AS jaccard
  FROM p JOIN reps x ON u = x.doc_id JOIN reps y ON v = y.doc_id)"""


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classes_of(table(spark, sf_dir, "documents")).where("grams is not null").select("doc_id", "grams")


def _signatures(sets: DataFrame) -> DataFrame:
    return D.minhash(sets, HASHES)


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures in long form (TX16, AG6)."""
    sigs = D.minhash(D.gram_sets(table(spark, sf_dir, "documents")), HASHES)
    return sigs.select("doc_id", F.posexplode("sig").alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("i"), "h")


QUERIES["minhash_signature"] = minhash_signature
SQL["minhash_signature"] = f"SELECT doc_id, i, h FROM ({_SIGS})"


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket keys of all documents and the size of their bucket (AG7)."""
    buckets = D.lsh_buckets(D.minhash(D.gram_sets(table(spark, sf_dir, "documents")), HASHES), BANDS)
    return buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


QUERIES["lsh_buckets"] = lsh_buckets
SQL["lsh_buckets"] = f"SELECT band, key, count(*) AS n, min(doc_id) AS first FROM ({_BUCKETS}) GROUP BY band, key"


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of documents with different sets (JN2, ST2)."""
    return D.lsh_candidates(D.lsh_buckets(_signatures(_reps(spark, sf_dir)), BANDS))


QUERIES["lsh_candidates"] = lsh_candidates
SQL["lsh_candidates"] = f"{_WITH} SELECT u, v FROM p"


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs (JN3, AG24, ST1, FL11)."""
    sets = D.settle(_reps(spark, sf_dir))
    pairs = D.jaccard_pairs(D.lsh_candidates(D.lsh_buckets(_signatures(sets), BANDS)), sets)
    return pairs.select("u", "v", F.round("jaccard", 9).alias("jaccard"))


QUERIES["jaccard_pairs"] = jaccard_pairs
SQL["jaccard_pairs"] = f"{_WITH}, {_VERIFIED} SELECT u, v, round(jaccard, 9) AS jaccard FROM j WHERE jaccard > 0.8"

_COMPONENTS = f"""{_WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_VERIFIED}, e AS (SELECT u, v FROM j WHERE jaccard > 0.8 UNION ALL SELECT v, u FROM j WHERE jaccard > 0.8),
  r AS (SELECT doc_id AS a, doc_id AS c FROM reps UNION SELECT e.v, r.c FROM r JOIN e ON r.a = e.u), k AS (SELECT a, min(c) AS c FROM r GROUP BY a),
  m AS (SELECT s.doc_id, k.c AS component FROM s JOIN k ON s.class = k.a)"""


def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document (CP4, JN4)."""
    return D.minhash_components(table(spark, sf_dir, "documents"), HASHES, BANDS)


QUERIES["dup_components"] = dup_components
SQL["dup_components"] = f"{_COMPONENTS} SELECT doc_id, component FROM m"


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors (CP3, AG8, JN5, SK3, SO5)."""
    return D.minhash_dedup(table(spark, sf_dir, "documents"), hashes=HASHES, bands=BANDS).select("doc_id", "source", "n_chars")


QUERIES["minhash_dedup"] = minhash_dedup
SQL["minhash_dedup"] = f"{_COMPONENTS} SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN m ON d.doc_id = m.doc_id WHERE m.component = m.doc_id"
