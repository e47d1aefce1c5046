"""Queries over classifiers and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import classify as C
from textmill.operators import models as M
from textmill.plans.text import ALL_RULES, MEASURES, WORDS
from textmill.session import stored, table

QUERIES: dict = {}
SQL: dict = {}

_LOWER = WORDS.replace("coalesce(text", "coalesce(lower(text)", 1)


def _bayes_sql(labels: str, feature: str) -> str:
    return f"""WITH l AS MATERIALIZED (SELECT doc_id, min(label) AS label FROM ({labels}) GROUP BY doc_id),
  c AS MATERIALIZED (SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest(list_transform({_LOWER}, lambda w: {feature})) AS f FROM documents) GROUP BY doc_id, f),
  n AS (SELECT label, f, sum(k) AS n FROM c JOIN l USING (doc_id) GROUP BY label, f),
  m AS (SELECT label, docs, total, total_docs, v FROM (SELECT label, sum(n) AS total FROM n GROUP BY label)
    JOIN (SELECT label, count(*) AS docs FROM l GROUP BY label) USING (label), (SELECT count(DISTINCT f) AS v FROM n), (SELECT count(*) AS total_docs FROM l)),
  h AS (SELECT doc_id, sum(k) AS known FROM c WHERE f IN (SELECT f FROM n) GROUP BY doc_id),
  g AS (SELECT c.doc_id, n.label, sum(k * ln(n - CASE WHEN l.label = n.label THEN k ELSE 0 END + 1)) AS gain FROM c JOIN n USING (f) LEFT JOIN l ON l.doc_id = c.doc_id GROUP BY c.doc_id, n.label),
  s AS (SELECT d.doc_id, m.label,
      ln(greatest(docs - CASE WHEN l.label = m.label THEN 1 ELSE 0 END, 0.5) / greatest(total_docs - CASE WHEN l.label IS NOT NULL THEN 1 ELSE 0 END, 1))
      - coalesce(known, 0) * ln(total - CASE WHEN l.label = m.label THEN coalesce(known, 0) ELSE 0 END + v) + coalesce(gain, 0) AS s
    FROM documents d CROSS JOIN m LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id AND g.label = m.label),
  b AS (SELECT doc_id, arg_min(label, (-s, label)) AS label, max(s) AS top FROM s GROUP BY doc_id),
  r AS (SELECT b.doc_id, b.label, 1 / sum(exp(s.s - b.top)) AS score FROM b JOIN s ON b.doc_id = s.doc_id GROUP BY b.doc_id, b.label)"""


_LANG = "SELECT doc_id, lang AS label FROM documents WHERE lang IS NOT NULL"
_QUALITY = "SELECT doc_id, quality::VARCHAR AS label FROM labels WHERE quality IS NOT NULL"
_TOXIC = "SELECT doc_id, toxic::VARCHAR AS label FROM labels WHERE toxic IS NOT NULL"


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))


def lang_id_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document and whether it passes as English (TX2, FL1, SO6)."""
    docs = table(spark, sf_dir, "documents")
    got = C.naive_bayes("lang", docs)
    return got.select("doc_id", "label", F.round("score", 6).alias("score"), F.expr("label = 'en' AND score >= 0.65").alias("passed"))


QUERIES["lang_id_nb"] = lang_id_nb
SQL["lang_id_nb"] = f"{_bayes_sql(_LANG, 'substr(w, 1, 3)')} SELECT doc_id, label, round(score, 6) AS score, label = 'en' AND score >= 0.65 AS passed FROM r"


def quality_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality label of each document; low with a score over 0.7 is dropped (FL5)."""
    got = C.naive_bayes(_labels(spark, sf_dir, "quality"), table(spark, sf_dir, "documents"), C.whole_words)
    return got.select("doc_id", "label", F.round("score", 6).alias("score"), F.expr("NOT (label = '0' AND score > 0.7)").alias("kept"))


QUERIES["quality_nb"] = quality_nb
SQL["quality_nb"] = f"{_bayes_sql(_QUALITY, 'w')} SELECT doc_id, label, round(score, 6) AS score, NOT (label = '0' AND score > 0.7) AS kept FROM r"


def toxic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not toxic with a score over 0.8 (FL3, FL4)."""
    got = C.naive_bayes(_labels(spark, sf_dir, "toxic"), table(spark, sf_dir, "documents"), C.whole_words)
    return got.where("NOT (label = '1' AND score > 0.8)").select("doc_id", "label", F.round("score", 6).alias("score"))


QUERIES["toxic_filter"] = toxic_filter
SQL["toxic_filter"] = f"{_bayes_sql(_TOXIC, 'w')} SELECT doc_id, label, round(score, 6) AS score FROM r WHERE NOT (label = '1' AND score > 0.8)"


def quality_trainset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training set of good and bad English documents (CP10, FL6, FL7, WN8, ST3, SO3, SO4)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("lang = 'en'")
    good = docs.where("quality = 1").withColumns(T.heuristics(F.col("text"))).where(F.expr(ALL_RULES)).where("octet_length(text) <= 31457280")
    rows = C.trainset(good, docs.where("quality = 0"))
    return rows.select("label", "doc_id", F.md5("text").alias("text_md5"))


_CLEAN = "regexp_replace(translate(text, chr(10) || chr(13), '  '), '^" + T.SPACES + "|" + T.SPACES + "$', '', 'g')"
_CLASS = "SELECT '{0}' AS label, doc_id, md5({1}) AS text_md5 FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = {2} AND {1} <> '' {3} ORDER BY doc_id LIMIT 5000"
QUERIES["quality_trainset"] = quality_trainset
SQL["quality_trainset"] = (
    f"(SELECT * FROM ({_CLASS.format('high', _CLEAN, 1, f'AND doc_id IN (SELECT doc_id FROM ({MEASURES}) WHERE {ALL_RULES})')})) UNION ALL (SELECT * FROM ({_CLASS.format('low', _CLEAN, 0, '')}))"
)


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression over hashed words and pairs, trained on all labels: label, score and verdict of all documents (CP11, FL5)."""
    docs = table(spark, sf_dir, "documents")
    model = C.logistic_regression(docs.join(_labels(spark, sf_dir, "quality"), "doc_id").where("label is not null").select("text", F.col("label").cast("double").alias("label")))
    return C.scores_of(model, docs).withColumn("kept", ~((F.col("label") == "0") & (F.col("score") > 0.7)))


QUERIES["quality_filter"] = quality_filter


#: Labelled rows that a language model learns from, with the least hashes of their ids.
LANG_ROWS = 4000
#: Rows of a shard: as many shards as they fill.
SHARD_ROWS = 4000


def bag_model(spark: SparkSession, sf_dir: str, name: str) -> M.BagModel:
    """The stored model for ``lang``, ``toxic`` or ``quality``; it is trained and stored once for the files of the tables."""
    docs = table(spark, sf_dir, "documents")

    def make(path: str) -> M.BagModel:
        if name == "lang":
            rows = docs.where("lang is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LANG_ROWS).select("doc_id", "text", F.col("lang").alias("label"))
        else:
            rows = docs.select("doc_id", "text").join(_labels(spark, sf_dir, name), "doc_id")
        # Few rows are one shard and passed over more often, so that any model takes some 20,000 steps.
        n = max(1, rows.count())
        made = M.train_bag(rows, dim=M.DIM if name == "quality" else 16, rate=1.0, shards=min(M.SHARDS, -(-n // SHARD_ROWS)), passes=max(1, SHARD_ROWS // n))
        M.save_model(spark, made, path)
        return made

    return stored(spark, sf_dir, f"model-{name}", ("documents", "labels"), lambda path: M.load_model(spark, path), make)


def bag_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, toxicity and quality of each document by stored models, in one pass over the texts (CP11, TX2, FL1, FL4, FL5)."""
    scored = M.score_all(table(spark, sf_dir, "documents"), {name: bag_model(spark, sf_dir, name) for name in ("lang", "toxic", "quality")})
    rules = {"is_english": "lang_label = 'en' AND lang_score >= 0.65", "toxic_passed": "NOT (toxic_label = '1' AND toxic_score > 0.8)", "quality_passed": "NOT (quality_label = '0' AND quality_score > 0.7)"}
    return scored.withColumns({k: F.expr(v) for k, v in rules.items()})


QUERIES["bag_verdicts"] = bag_verdicts
