"""The whole curation flow: filters with a funnel, exact line deduplication, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import classify as C
from textmill.operators import dedup as D
from textmill.operators import models as M
from textmill.operators.word_bayes import word_bayes
from textmill.plans.classify import _LANG, _QUALITY, _TOXIC, _bayes_sql, _labels, bag_model
from textmill.plans.text import ALL_RULES, MEASURES, measured
from textmill.session import settle, table
from textmill.streaming.curation import activity

QUERIES: dict = {}
SQL: dict = {}

#: What each filter keeps, over the columns of ``verdicts``; in this order.
STEPS = {
    "lang_passed": "lang_label = 'en' AND lang_score >= 0.65",
    "gopher_passed": "heuristics",
    "nsfw_passed": "NOT coalesce(adult_label = '1' AND adult_score > 0.8, false)",
    "toxic_passed": "NOT (toxic_label = '1' AND toxic_score > 0.8)",
    "quality_passed": "NOT (quality_label = '0' AND quality_score > 0.7)",
}


def verdicts(spark: SparkSession, sf_dir: str, adult: DataFrame | None = None) -> DataFrame:
    """What each filter says of each document.

    ``adult`` has ``doc_id, label, score`` from any model for adult content, 1 for what it
    is; the tables have no labels to train one, so without it that step lets all pass.
    """
    docs = table(spark, sf_dir, "documents")
    rows = measured(spark, sf_dir).select("doc_id", "source", F.expr(ALL_RULES).alias("heuristics"))
    models = {"lang": ("lang", 3), "toxic": (_labels(spark, sf_dir, "toxic"), None), "quality": (_labels(spark, sf_dir, "quality"), None)}
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        got = word_bayes(docs, models)
        rows = rows.join(got.withColumns({f"{name}_score": F.round(f"{name}_score", 6) for name in models}), "doc_id")
    else:  # rows with one id are one document
        for name, (labels, n) in models.items():
            got = C.naive_bayes(labels, docs, C.word_starts if n else C.whole_words)
            rows = rows.join(got.select("doc_id", F.col("label").alias(f"{name}_label"), F.round("score", 6).alias(f"{name}_score")), "doc_id")
    if adult is None:
        return rows.withColumns({"adult_label": F.lit(None).cast("string"), "adult_score": F.lit(None).cast("double")})
    return rows.join(adult.select("doc_id", F.col("label").cast("string").alias("adult_label"), F.col("score").alias("adult_score")), "doc_id", "left")


def _cumulative() -> dict[str, str]:
    out, so_far = {}, "true"
    for name, rule in STEPS.items():
        so_far = f"{so_far} AND ({rule})"
        out[name] = so_far
    return out


def curation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each filter leaves, by source and in all (CP1, AG9, FL1-FL5)."""
    return verdicts(spark, sf_dir).rollup("source").agg(F.count("*").alias("total_records"), *[F.count_if(F.expr(x)).alias(k) for k, x in _cumulative().items()])


_PARTS = " JOIN ".join(
    f"(SELECT doc_id, label AS {name}_label, round(score, 6) AS {name}_score FROM ({_bayes_sql(labels, feature)} SELECT * FROM r)) USING (doc_id)"
    for name, labels, feature in (("lang", _LANG, "substr(w, 1, 3)"), ("toxic", _TOXIC, "w"), ("quality", _QUALITY, "w"))
)
QUERIES["curation_funnel"] = curation_funnel
SQL["curation_funnel"] = (
    f"SELECT source, count(*) AS total_records, {', '.join(f'count(*) FILTER (WHERE {x}) AS {k}' for k, x in _cumulative().items())} "
    f"FROM (SELECT doc_id, source, {ALL_RULES} AS heuristics, NULL::VARCHAR AS adult_label, NULL::DOUBLE AS adult_score FROM ({MEASURES})) JOIN {_PARTS} GROUP BY ROLLUP (source)"
)


def stored_verdicts(spark: SparkSession, sf_dir: str, adult: str | None = None) -> DataFrame:
    """As ``verdicts``, by stored models that score all texts in one pass; ``adult`` is the folder of one for adult content, 1 for what it is."""
    models = {name: bag_model(spark, sf_dir, name) for name in ("lang", "toxic", "quality")}
    if adult is not None:
        models["adult"] = M.load_model(spark, adult)
    rules = measured(spark, sf_dir).select("doc_id", "source", F.expr(ALL_RULES).alias("heuristics"))
    rows = rules.join(M.score_all(table(spark, sf_dir, "documents"), models), "doc_id")
    return rows if adult is not None else rows.withColumns({"adult_label": F.lit(None).cast("string"), "adult_score": F.lit(None).cast("double")})


def curation(spark: SparkSession, sf_dir: str, adult: str | None = None) -> DataFrame:
    """The curated corpus: filters by stored models, then lines that occur once, then near duplicates, by document id throughout (CP1-CP3)."""
    kept = stored_verdicts(spark, sf_dir, adult).where(F.expr(list(_cumulative().values())[-1])).select("doc_id")
    docs = table(spark, sf_dir, "documents").join(kept, "doc_id", "left_semi").select("doc_id", "source", "text")
    lines = D.exact_line_dedup(docs).where("text <> ''").join(docs.select("doc_id", "source"), "doc_id")
    unique = D.minhash_dedup(settle(lines.select("doc_id", "source", "text")))
    return unique.select("doc_id", "source", F.md5("text").alias("text_md5"))


QUERIES["curation"] = curation


def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the streaming aggregation, over the table at rest."""
    rows = activity(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["event_activity"] = event_activity
SQL["event_activity"] = "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
