"""Queries over text functions: heuristics, masks, normalisation, markup, n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def _sql(text: str) -> str:
    """A SQL string literal of DuckDB, which has no escapes."""
    return "'" + text.replace("'", "''") + "'"


WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), {_sql(T.SPACES)}), lambda x: x <> '')"
_PARTS = f"regexp_split_to_array(coalesce(text, ''), {_sql(T.BREAKS)})"
LINES = f"(CASE WHEN {_PARTS}[-1] = '' THEN {_PARTS}[:-2] ELSE {_PARTS} END)"
_STRIP = f"regexp_replace(x, {_sql(f'^{T.SPACES}|{T.SPACES}$')}, '', 'g')"
MEASURES = f"""
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS n_chars_in_words, len(l)::BIGINT AS n_lines,
    len(list_filter(l, lambda x: ends_with({_STRIP}, '...')))::BIGINT AS n_ellipsis, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_alpha
  FROM (SELECT *, {WORDS} AS w, {LINES} AS l FROM documents)"""
ALL_RULES = " AND ".join(f"({x})" for x in T.RULES.values())


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", *[c.alias(k) for k, c in T.heuristics(F.col("text")).items()])


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the heuristics for each document (FL2, AG15)."""
    rows = measured(spark, sf_dir).drop("lang", "source")
    return rows.withColumns({k: F.expr(x) for k, x in T.RULES.items()}).withColumn("passed", F.expr(ALL_RULES))


QUERIES["quality_flags"] = quality_flags
SQL["quality_flags"] = f"SELECT * EXCLUDE (lang, source), {', '.join(f'({x}) AS {k}' for k, x in T.RULES.items())}, {ALL_RULES} AS passed FROM ({MEASURES})"


def quality_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each filter leaves, by source and in all (AG9, CP1's native part): one pass and a rollup."""
    steps, so_far = {}, "true"
    for name, rule in {"lang_passed": "lang = 'en'", **{k.replace("_ok", "_passed"): x for k, x in T.RULES.items()}}.items():
        so_far = f"{so_far} AND ({rule})"
        steps[name] = so_far
    return measured(spark, sf_dir).rollup("source").agg(F.count("*").alias("total_records"), *[F.count_if(F.expr(x)).alias(k) for k, x in steps.items()])


def _funnel_sql() -> str:
    parts, so_far = [], "true"
    for name, rule in {"lang_passed": "lang = 'en'", **{k.replace("_ok", "_passed"): x for k, x in T.RULES.items()}}.items():
        so_far = f"{so_far} AND ({rule})"
        parts.append(f"count(*) FILTER (WHERE {so_far}) AS {name}")
    return f"SELECT source, count(*) AS total_records, {', '.join(parts)} FROM ({MEASURES}) GROUP BY ROLLUP (source)"


QUERIES["quality_funnel"] = quality_funnel
SQL["quality_funnel"] = _funnel_sql()


def _mask(name: str, fn, pattern: str, mark: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        masked = table(spark, sf_dir, "documents").select("doc_id", fn(F.col("text")).alias("m"))
        return masked.select("doc_id", F.md5("m.text").alias("masked_md5"), F.col("m.n").cast("long").alias("n"))

    query.__doc__ = f"Masked texts (as digests) and counts of {name}."
    QUERIES[name] = query
    SQL[name] = f"SELECT doc_id, md5(regexp_replace(text, {_sql(pattern)}, '{mark}', 'g')) AS masked_md5, len(regexp_extract_all(text, {_sql(pattern)}))::BIGINT AS n FROM documents"


_mask("mask_email", T.mask_emails, T.EMAIL, T.EMAIL_MARK)
_mask("mask_phone", T.mask_phones, T.PHONE, T.PHONE_MARK)
_mask("mask_ip", T.mask_ips, T.IPV4, T.IP_MARK)


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked items by language."""
    docs = table(spark, sf_dir, "documents")
    counts = {"emails": T.EMAIL, "phones": T.PHONE_JVM, "ips": T.IPV4_JVM}
    return docs.groupBy("lang").agg(*[F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(k) for k, p in counts.items()])


QUERIES["pii_counts"] = pii_counts
SQL["pii_counts"] = "SELECT lang, " + ", ".join(f"sum(len(regexp_extract_all(text, {_sql(p)})))::BIGINT AS {k}" for k, p in {"emails": T.EMAIL, "phones": T.PHONE, "ips": T.IPV4}.items()) + " FROM documents GROUP BY lang"


def clean_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on one line, stripped, as digests (TX2, TX6)."""
    one = T.strip(T.one_line(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(one).alias("clean_md5"), F.md5(F.regexp_replace("text", "[\n\r]", "")).alias("joined_md5"), F.length(one).cast("long").alias("n_chars"))


QUERIES["clean_newlines"] = clean_newlines
SQL["clean_newlines"] = f"""SELECT doc_id, md5(x) AS clean_md5, md5(regexp_replace(text, '[\\n\\r]', '', 'g')) AS joined_md5, length(x)::BIGINT AS n_chars
FROM (SELECT *, {_STRIP.replace('(x,', "(translate(text, chr(10) || chr(13), '  '),", 1)} AS x FROM documents)"""

_NORMAL = f"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), {_sql('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + T.SPACES[1:-2] + ']')}, '', 'g'), {_sql(T.SPACES)}, ' ', 'g'))"


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts as digests (TX7)."""
    x = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("normal_md5"), F.length("x").cast("long").alias("n_chars"))


QUERIES["normalize_text"] = normalize_text
SQL["normalize_text"] = f"SELECT doc_id, md5(x) AS normal_md5, length(x)::BIGINT AS n_chars FROM (SELECT doc_id, {_NORMAL} AS x FROM documents)"


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages as digests (TX1)."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


def _html_sql() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in T.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{name}\\b.*?</{name}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x09-\\x0D\\x20]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{T.LINE_TAGS})\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in T.REFERENCES:
        x = f"replace({x}, '&{name};', {_sql(char)})"
    x = f"regexp_replace(regexp_replace({x}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    return f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT page_id, {x} AS t FROM pages)"


QUERIES["html_to_text"] = html_to_text
SQL["html_to_text"] = _html_sql()


def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the sets of normalised word 5-grams (TX8)."""
    grams = table(spark, sf_dir, "documents").select("doc_id", T.ngrams(T.normalize(F.col("text")), 5).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join(F.sort_array("g"), "|")).alias("grams_md5"))


GRAMS = f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g
  FROM (SELECT doc_id, {WORDS.replace('coalesce(text', f'coalesce({_NORMAL}', 1)} AS w FROM documents)"""
QUERIES["word_ngrams"] = word_ngrams
SQL["word_ngrams"] = f"SELECT doc_id, len(g)::BIGINT AS n_grams, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM ({GRAMS})"


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words of each document with their longest members (TX9, TX10, SC5, SC6)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"), T.lines(F.col("text")).alias("l"))
    longest = [F.coalesce(F.array_max(F.transform(c, F.length)), F.lit(0)).cast("long") for c in ("w", "l")]
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size("l").cast("long").alias("n_lines"), longest[0].alias("longest_word"), longest[1].alias("longest_line"))


QUERIES["line_lengths"] = line_lengths
SQL["line_lengths"] = f"""SELECT doc_id, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word,
  coalesce(list_max(list_transform(l, lambda x: length(x))), 0)::BIGINT AS longest_line FROM (SELECT doc_id, {WORDS} AS w, {LINES} AS l FROM documents)"""
