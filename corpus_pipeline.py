"""A training-data pipeline: documents through five operators, each stage written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; the first four return the columns of ``documents``.

* quality rules: documents that the rules reject go.
* n-gram join: of each group of linked documents the one with the least id stays; of rows
  that are alike in id and text, one.
* decontamination: documents that hold a benchmark item go, each judged by its own text.
* PII: personal data are replaced by their kind in brackets; ``n_chars`` follows.
* mixing: the documents that the mix takes, with the number of their copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import settle, shared_folder
from textmill.llm.decontamination import decontaminate
from textmill.llm.mixing import mix_sources
from textmill.llm.ngram_join import ngram_jaccard_join
from textmill.llm.pii import personal_data, redact
from textmill.llm.quality import quality_rules

#: No SQL: cutoffs with exact binomial bounds and bootstrapped patterns are beyond it. Tested against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that may be broadcast.
MOST_BROADCAST = 200_000
#: Names for columns that exist within a stage only.
KEY, FOUND = "_pipeline_key", "_pipeline_found"


def _digest(*columns: str) -> Column:
    """128 bits of some columns, in which null differs from empty."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """A key that is never null and tells apart whatever the operators can tell apart: rows of one key are treated alike."""
    return docs.withColumn(KEY, _digest("doc_id", "text", *more))


def _number() -> Column:
    """A whole number for a row, by which the join of n-grams knows it; rows alike in id and text have the same."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality rules keep."""
    keyed = _keyed(docs, "lang")
    lost = quality_rules(keyed, _table(spark, sf_dir, "labels"), carry=(KEY,)).where("not kept").select(KEY).distinct()
    return keyed.join(lost, KEY, "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: the one with the least id, one without an id only if none has one.

    Rows are known by a hash of id and text, so that rows with a null or repeated id are
    judged too; rows alike in both are one document. Different rows may have the same hash, which
    is 64 bits as the join takes them: before anything goes, the rows that would are compared by 128 bits,
    and all rows of such a hash stay. Documents without a word are linked with nothing and stay.
    """
    keyed = docs.withColumn(KEY, _number())
    groups = settle(ngram_jaccard_join(keyed, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id", "n_shingles"))
    # Only rows of a group of two or more are compared: the rest go through. Groups may be
    # large: their rows meet few group keys by broadcast, and the first is a partial minimum.
    linked = settle(groups.where(F.col("component_id") != F.col(KEY)).select("component_id").distinct())
    members = settle(groups.select(KEY, "component_id").join(_few(linked), "component_id", "left_semi").distinct())
    ids = keyed.select(KEY, "doc_id").join(_few(members), KEY)
    first = ids.groupBy("component_id").agg(F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first"))
    lost = settle(members.join(_few(settle(first)), "component_id").where(F.col(KEY) != F.col("first")).select(KEY))
    repeated = groups.where("n_shingles > 0").groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY)
    repeated = settle(repeated.join(lost, KEY, "left_anti"))
    gone = lost.select(KEY, F.lit(False).alias(FOUND)).unionByName(repeated.select(KEY, F.lit(True).alias(FOUND)))
    digests = keyed.select(KEY, _digest("doc_id", "text").alias("digest")).join(_few(gone), KEY)
    gone = settle(digests.groupBy(KEY, FOUND).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a = b").select(KEY, FOUND))
    stay = keyed.join(_few(gone), KEY, "left_anti")
    once = gone.where(FOUND).select(KEY)
    if once.isEmpty():
        return stay.select(*docs.columns)
    return stay.unionByName(keyed.join(_few(once), KEY, "left_semi").dropDuplicates([KEY])).select(*docs.columns)


def _few(keys: DataFrame) -> DataFrame:
    """Rows of one or two keys of 8 bytes: few are broadcast, so that no text is shuffled for them; many are joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    keyed = _keyed(docs)
    found = personal_data(keyed, id_col=KEY).where("size(found) > 0").select(F.col("doc_id").alias(KEY), F.col("found").alias(FOUND)).dropDuplicates([KEY])
    none = F.expr("cast(array() AS array<struct<s:int,k:int,e:int,kind:string>>)")
    joined = keyed.join(found, KEY, "left").withColumn(FOUND, F.coalesce(FOUND, none))
    masked = joined.withColumn("text", redact("text", FOUND))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(FOUND) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: their columns, and ``copies``, how often each is taken; it takes the place of a column of that name."""
    own = [c for c in docs.columns if c.lower() != "copies"]
    keyed = _keyed(docs.select(own), "source")
    plan = mix_sources(keyed, carry=(KEY,)).where("copies > 0").groupBy(KEY).agg(F.max("copies").alias("copies"))
    return keyed.join(plan, KEY).select(*own, "copies")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
