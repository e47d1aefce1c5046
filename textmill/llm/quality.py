"""Quality rules whose cutoffs are chosen with a bound on false rejection, native.

A rule rejects a document of a stratum when one of its measures reaches a cutoff.
Cutoffs come from all labelled documents: for each stratum, rule and candidate
cutoff the number of good documents that it would reject is counted, and the exact
binomial tail gives a p-value for "this cutoff rejects more than alpha of the good
documents". A cutoff is valid if its p-value is under delta divided by the number
of all tests (Bonferroni), so with confidence 1 - delta every chosen cutoff keeps
its promise at once. Among the valid cutoffs of a rule, the mildest one that
catches nearly as many bad documents as the strictest rules; a stratum with too
few labels has no valid cutoff, and the rule rejects nothing there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import SPACE, settle, table
from textmill.llm.spans import let


@dataclass(frozen=True)
class Rule:
    """``measure``: a SQL expression over the base columns; high values are bad. ``grid``: candidate cutoffs."""

    name: str
    measure: str
    grid: tuple[float, ...]


_SHARES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6)
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _SHARES),
    Rule("lines", "n_dup_lines / greatest(n_words, 1)", (0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.3)),
    Rule("marks", "n_marks / greatest(n_words, 1)", (0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0)),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", _SHARES),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Bind a value that is used more than once to one evaluation of it."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: str, key: str = "xxhash64({0}, {1}, {2})") -> Column:
    """Words in 3-word windows that a text has twice or more; ``words`` names an array.

    Where all windows' hashes differ, nothing repeats. Else the windows are sorted by
    hash, words and place; neighbours with the same words are repeats, so that windows
    that only share a hash are told apart. Each repeated window adds the words up to
    the next. ``key`` is the hash of three words.
    """
    hashes = f"transform(sequence(0, size(w) - 3), i -> {key.format('w[i]', 'get(w, i + 1)', 'get(w, i + 2)')})"
    windows = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'a', get(w, i), 'b', get(w, i + 1), 'c', get(w, i + 2), 'i', i)))"
    alike = " OR ".join("(" + " AND ".join(f"x.{f} = get(s, j {step} 1).{f}" for f in "habc") + ")" for step in "-+")
    places = f"sort_array(filter(transform(s, (x, j) -> CASE WHEN {alike} THEN x.i END), x -> x IS NOT NULL))"
    total = let("p", places, "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (t, x) -> t + x)")
    repeats = let("h", hashes, f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {let('s', windows, total)} END")
    return F.expr(let("w", words, f"CASE WHEN size(w) < 4 THEN 0L ELSE {repeats} END"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with the base columns and the counts that other rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn("_words", words).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_window_words("_words"),
            "n_marks": (F.length(text) - F.length(F.translate(text, "!?|*#$%&", ""))).cast("long"),
            "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        }
    )
    return counted.drop("_words", text_col).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; about 1e-13 for x >= 1."""
    y = x + 8
    back = F.ln(x)
    for k in range(1, 8):
        back = back + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed from the largest term down until terms vanish; 1 for k >= n*p.

    A cutoff that rejects more than the share p on the holdout can't be valid, so
    the other side need not be told apart from 1.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_first = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.ln(F.lit(p)) + (nd - kd) * F.ln(F.lit(1 - p))
    ratio = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, (12 * F.sqrt(nd) + 60).cast("long")))
    total = F.aggregate(
        steps,
        start,
        lambda a, i: _let(a["term"] * F.greatest(kd - i, F.lit(0.0)) / (nd - kd + i + 1) * ratio, lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total"))),
        lambda a: a["total"],
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_first) * total))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, stratum: str = "stratum", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """The cutoff of each stratum and rule: ``stratum, rule, cutoff, good, hit, caught, p_value``.

    ``labels`` has ``doc_id, quality``: 1 is good, 0 is bad. alpha bounds the share
    of good documents of a stratum that all rules together may reject; each rule
    gets an equal part. All labelled documents that pass the base rules count. Of
    the valid cutoffs, those that catch at least 98 % of the bad documents that the
    strictest one catches are as good as it, and the mildest of them rules; a rule
    that catches none has no cutoff.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where("not base_failed").join(known, "doc_id").select(stratum, "quality", *[F.expr(r.measure).alias(r.name) for r in rules])
    cells = [(r, k, c) for r in rules for k, c in enumerate(r.grid)]
    counts = rows.groupBy(stratum).agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        *[F.count_if((F.col("quality") == 1) & (F.col(r.name) >= c)).alias(f"{r.name}@{k}") for r, k, c in cells],
        *[F.count_if((F.col("quality") == 0) & (F.col(r.name) >= c)).alias(f"{r.name}!{k}") for r, k, c in cells],
    )
    tests = [F.struct(F.lit(r.name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{r.name}@{k}").alias("hit"), F.col(f"{r.name}!{k}").alias("caught")) for r, k, c in cells]
    long = counts.select(stratum, "good", F.explode(F.array(*tests)).alias("t")).select(stratum, "good", "t.*")
    long = long.withColumn("tests", F.count("*").over(Window.partitionBy())).withColumn("p_value", binomial_tail(F.col("hit"), F.col("good"), alpha / len(rules)))
    valid = long.where((F.col("p_value") <= F.lit(delta) / F.col("tests")) & (F.col("caught") > 0))
    most = F.max("caught").over(Window.partitionBy(stratum, "rule"))
    enough = valid.withColumn("most", most).where("100 * caught >= 98 * most")
    return enough.groupBy(stratum, "rule").agg(F.max_by(F.struct("cutoff", "good", "hit", "caught", "p_value"), "cutoff").alias("b")).select(stratum, "rule", "b.*")


def quality_rules(
    docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Base measures and the verdict of the rules for each document.

    Returns ``doc_id``, the base columns, ``base_failed``, ``kept`` and
    ``failed_rules`` (names in the order of ``rules``), a row for each input row.
    Null and empty texts have no words and fail the base rules; a null stratum counts
    as the stratum ''; documents with a null id are judged but lend no label;
    repeated labels count once. Without labels nothing but the base rules rejects.
    Texts are measured whole. Columns named in ``carry`` come along, others are
    ignored.
    """
    measured = measures(docs.select(*carry, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")), "_text")
    measured = settle(measured)
    cutoffs = fit_cutoffs(measured, labels.select(F.col("doc_id"), F.col("quality")), rules, "stratum", alpha, delta)
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules])
    failed = F.filter(F.array(*[F.when(F.expr(r.measure) >= F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    judged = measured.join(wide, "stratum", "left").withColumn("failed_rules", failed)
    return judged.select(*carry, "doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def _sql(alpha: float = 0.03, delta: float = 0.05) -> str:
    """The query in DuckDB's SQL: windows by their words, binomial tails as sums over all terms."""
    measure = {r.name: r.measure.replace(" / ", "::DOUBLE / ") for r in RULES}
    cells = ", ".join(f"('{r.name}', {c}::DOUBLE)" for r in RULES for c in r.grid)
    failed = ", ".join(f"CASE WHEN {measure[r.name]} >= (SELECT cutoff FROM cuts WHERE cuts.stratum = m.stratum AND cuts.rule = '{r.name}') THEN '{r.name}' END" for r in RULES)
    value = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {measure[r.name]}" for r in RULES) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM rep GROUP BY rid),
b AS (SELECT w.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[!?|*#$%&]'))::BIGINT AS n_marks, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_capitals
  FROM w LEFT JOIN cov ON cov.rid = w.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cell AS (SELECT * FROM (VALUES {cells}) AS c(rule, cutoff)),
x AS (SELECT stratum, rule, cutoff, quality, {value} AS v FROM m JOIN k USING (doc_id) CROSS JOIN cell WHERE NOT base_failed),
c AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1 AND v >= cutoff) AS hit, count(*) FILTER (WHERE quality = 0 AND v >= cutoff) AS caught FROM x GROUP BY ALL),
p AS (SELECT *, count(*) OVER () AS tests, CASE WHEN hit >= good * {alpha / len(RULES)!r} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({alpha / len(RULES)!r}) + (good - i) * ln({1 - alpha / len(RULES)!r}))) FROM (SELECT unnest(range(0, hit + 1)) AS i)) END AS p_value FROM c),
v AS (SELECT *, max(caught) OVER (PARTITION BY stratum, rule) AS most FROM p WHERE p_value <= {delta!r} / tests AND caught > 0),
cuts AS (SELECT stratum, rule, max(cutoff) AS cutoff FROM v WHERE 100 * caught >= 98 * most GROUP BY stratum, rule),
f AS (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM f
"""


OP6_SQL = _sql()
