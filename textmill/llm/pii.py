"""Personal data: fixed patterns and bootstrapped contextual extraction, native.

Personal data stand in contexts. Spans of the fixed patterns, of every kind, are the
seeds, and other identifier-like tokens are what may be discovered. Their lexical
patterns are the word before them, the two words before them, the word before and
the one after them, and the word before them with the token's shape (its letters and
digits each as one sign). Patterns and strings (instances) form a graph that is
scored in rounds: the confidence of a pattern is the score it sees over all its
occurrences, with or without an identifier in its place, in all documents; the score
of an instance that is no seed is what its patterns say together (noisy or). Patterns
with enough distinct instances and a high confidence then tell which other tokens
are identifiers too. An ordinary word that happens to stand before some numbers has
a low confidence, because it mostly stands before other words; for a shape each such
occurrence of its word counts a part.

Patterns and instances are known by 64-bit hashes, so that a row of the graph has the
same few bytes however long a token or a word is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import SPACE, settle, table
from textmill.llm.spans import apart, found_sql, in_order, let, listed, matches, quoted, replaced

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_PART = "transform(split(x.m, '[.]'), y -> regexp_replace(y, '^0+', ''))"
IP_VALID = f"forall({_PART}, y -> length(y) <= 3 AND coalesce(try_cast(y AS int), 0) <= 255)"
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = """transform(array(reverse(translate(x.m, ' -', ''))), r -> aggregate(sequence(1, length(r)), 0, (t, i) ->
  t + CASE WHEN i % 2 = 1 THEN cast(substr(r, i, 1) AS int) ELSE cast(substr('0246813579', cast(substr(r, i, 1) AS int) + 1, 1) AS int) END))[0] % 10 = 0"""
CARD_VALID = f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"
PHONE_VALID = f"length({_DIGITS}) BETWEEN 10 AND 15"
KINDS = ("email", "ip", "card", "phone")

#: An identifier-like token: letters, digits and hyphens with five digits or more.
_TOKEN = "[A-Za-z0-9-]"
CANDIDATE = rf"(?<!{_TOKEN})(?={_TOKEN}{{6}})(?=(?:[A-Za-z-]*+[0-9]){{5}}){_TOKEN}++"


@dataclass(frozen=True)
class Bootstrap:
    """Rounds of scoring, distinct instances a pattern needs, the confidence from which it speaks, and the weight of a word's other occurrences for its shapes."""

    rounds: int = 3
    support: int = 3
    confidence: float = 0.5
    other: float = 0.05


#: Patterns that may be broadcast; beyond it the contexts of the corpus are joined by a shuffle.
MOST_BROADCAST = 200_000
WORD, PAIR, AROUND, SHAPE = 1, 2, 3, 4
_CONTEXT = ("m", "w2", "w1", "r")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id``, the spans of the fixed patterns as ``found`` in order, and ``seen``: where contexts are looked at.

    Of ``seen`` those with ``seed`` are spans that begin in no other span, the rest
    candidates that meet no span; ``m`` is the string, ``w2, w1, r`` are the words around it.
    """
    text = "_text"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias(text), F.monotonically_increasing_id().alias("row"))
    every = {
        "email": matches(text, EMAIL, context=True, needs="@"),
        "ip": matches(text, IP, 0, IP_VALID, context=True, needs="."),
        "card": matches(text, CARD, 0, CARD_VALID, context=True),
        "phone": matches(text, PHONE, 0, PHONE_VALID, context=True, needs="+"),
        "seen": matches(text, CANDIDATE, 0, context=True),
    }
    edge = "named_struct('s', x.s, 'e', x.e, 'm', x.m, 'w2', x.w2, 'w1', x.w1, 'r', x.r, 'seed', x.k < 4)"
    rows = rows.withColumns({k: F.expr(v) for k, v in every.items()}).select("row", "doc_id", F.expr(in_order({k: k for k in every}, _CONTEXT)).alias("_all"))
    found = "transform(filter(_all, x -> x.k < 4), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind))"
    return rows.select("row", "doc_id", F.expr(found).alias("found"), F.expr(apart("_all", 4, edge)).alias("seen"))


def _patterns(x: str) -> str:
    """SQL for the patterns of an edge: ``kind``, the pattern, and the context whose occurrences the corpus counts."""
    word, either = f"{x}.w1 RLIKE '\\\\p{{L}}'", f"concat({x}.w2, {x}.w1) RLIKE '\\\\p{{L}}'"
    shape = f"regexp_replace(regexp_replace({x}.m, '[0-9]', '9'), '[A-Za-z]', 'A')"
    parts = [
        (WORD, word, f"xxhash64({WORD}, {x}.w1)"),
        (PAIR, either, f"xxhash64({PAIR}, {x}.w2, {x}.w1)"),
        (AROUND, f"{word} AND {x}.r IS NOT NULL", f"xxhash64({AROUND}, {x}.w1, {x}.r)"),
        (SHAPE, word, f"xxhash64({SHAPE}, {x}.w1, {shape})"),
    ]
    made = [f"CASE WHEN {when} THEN named_struct('kind', {kind}, 'pattern', {key}, 'context', {key if kind != SHAPE else parts[0][2]}) END" for kind, when, key in parts]
    return f"filter(array({', '.join(made)}), y -> y IS NOT NULL)"


def edges_of(rows: DataFrame) -> DataFrame:
    """``row``, ``found`` and ``seen`` with hashes in place of strings: ``s, e, instance, seed, patterns``."""
    edge = f"named_struct('s', x.s, 'e', x.e, 'instance', xxhash64(x.m), 'seed', x.seed, 'patterns', {_patterns('x')})"
    return rows.withColumn("seen", F.expr(f"transform(seen, x -> {edge})"))


def context_totals(docs: DataFrame, text_col: str, contexts: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``context, total``: how often each of some contexts stands in all documents, whatever is in the identifier's place."""
    words = f"filter(split(lower(coalesce(_text, '')), {quoted(SPACE)}), w -> w <> '')"
    keys = [f"xxhash64({WORD}, x)", f"xxhash64({PAIR}, get(z, i - 1), x)", f"xxhash64({AROUND}, get(z, i - 2), x)"]
    every = let("z", words, f"flatten(transform(z, (x, i) -> array({', '.join(keys)})))")
    spoken = docs.select(F.col(text_col).alias("_text")).select(F.explode(F.expr(every)).alias("context"))
    counted = F.count("*").alias("total")
    if contexts.count() <= most_broadcast:
        return spoken.join(F.broadcast(contexts), "context", "left_semi").groupBy("context").agg(counted)
    # Counted before they are joined: a word that stands everywhere is a row a task, not one for each place.
    # (A semi join would be pushed below the aggregation.)
    return spoken.groupBy("context").agg(counted).join(contexts.distinct(), "context")


def score_patterns(graph: DataFrame, totals: DataFrame, boot: Bootstrap) -> DataFrame:
    """Confidence of each pattern with enough instances: ``pattern, confidence``.

    ``graph`` has ``pattern, kind, context, instance, n, seed``: how often an instance
    stands in a pattern. ``totals`` has ``context, total``.
    """
    own = graph.groupBy("pattern", "kind", "context").agg(F.sum("n").alias("own"), F.count("*").alias("instances")).where(F.col("instances") >= boot.support)
    total = F.coalesce("total", F.lit(0))
    every = F.when(F.col("kind") == SHAPE, F.col("own") + boot.other * total).otherwise(F.greatest("own", total))
    sized = own.join(totals, "context", "left").select("pattern", (every + 1).cast("double").alias("every"))
    graph = settle(graph.select("pattern", "instance", "n", "seed").join(sized, "pattern"))
    scores, patterns = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), None
    for k in range(boot.rounds):
        hit = graph.join(scores, "instance").groupBy("pattern", "every").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count_if(F.col("score") >= boot.confidence).alias("support"))
        patterns = settle(hit.where(F.col("support") >= boot.support).select("pattern", (F.col("hit") / F.col("every")).alias("confidence")))
        if k + 1 < boot.rounds:
            doubt = F.exp(F.sum(F.ln(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
            told = graph.join(patterns, "pattern", "left").groupBy("instance").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - doubt).alias("score"))
            scores = settle(told.where("score > 0"))
    return patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boot: Bootstrap = Bootstrap()) -> DataFrame:
    """Personal data of each text: ``doc_id``, arrays ``email, ip, card, phone, id``, and all as ``found`` in order.

    Spans have a start ``s`` and an end ``e`` (exclusive) in code points; ``id`` are
    the tokens that high-confidence patterns discover and that meet no other span.
    Null and empty texts have none. Ids may be null or repeat: every input row gives
    a row. Texts are scanned whole, other columns are ignored, and an empty table
    gives an empty result.
    """
    # Only places and hashes are kept: texts and words are read again where they are counted.
    rows = settle(edges_of(base_spans(docs, id_col, text_col)))
    edges = rows.select("row", F.explode("seen").alias("c")).select("row", "c.*")
    linked = edges.select("instance", "seed", F.explode("patterns").alias("p")).select("instance", "seed", "p.*")
    graph = settle(linked.groupBy("pattern", "kind", "context", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    contexts = graph.groupBy("context", "pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= boot.support).select("context").distinct()
    totals = settle(context_totals(docs, text_col, settle(contexts)))
    good = score_patterns(graph, totals, boot).where(F.col("confidence") >= boot.confidence).select("pattern")
    open_ = edges.where("not seed").select("row", "s", "e", F.explode("patterns.pattern").alias("pattern")).join(good, "pattern", "left_semi").select("row", "s", "e").distinct()
    more = open_.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", F.lit("id").alias("kind")))).alias("more"))
    # Only documents with a candidate may have more: the others need no shuffle.
    has = F.exists("seen", lambda x: ~x["seed"])
    rest = rows.where(has).select("row", "doc_id", "found").join(more, "row", "left").select("doc_id", F.expr("CASE WHEN more IS NULL THEN found ELSE sort_array(concat(found, more)) END").alias("found"))
    every = rows.where(~has).select("doc_id", "found").unionByName(rest)
    of = "transform(filter(found, x -> x.k = {}), x -> named_struct('s', x.s, 'e', x.e))"
    return every.select("doc_id", *[F.expr(of.format(k)).alias(kind) for k, kind in enumerate((*KINDS, "id"))], "found")


def redact(text: str, spans: str) -> Column:
    """The text with each span of a tagged array replaced by its kind in brackets; of spans that meet, the first stays."""
    return replaced(text, spans)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(found, x -> x.k < 4)"))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("found").alias("spans"),
    )


def _sql(boot: Bootstrap = Bootstrap()) -> str:
    """The query in DuckDB's SQL, with the patterns as strings and the rounds one after the other."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT ELSE substr('0246813579', substr(reverse({digits}), i, 1)::INT + 1, 1)::INT END)) % 10 = 0"
    part = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"
    # A run with five digits and six characters or more, without a look ahead: something follows the fifth digit, or something else stands before it.
    token = "(?:[A-Za-z-]*[0-9]){5}[A-Za-z0-9-]+|" + "|".join(f"[0-9]{{{k}}}[A-Za-z-]+(?:[A-Za-z-]*[0-9]){{{5 - k}}}" for k in range(5))
    kinds = [
        found_sql(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        found_sql(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, part),
        found_sql(2, "card", r"[0-9]([\x20-]?[0-9])+", 0, f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"),
        found_sql(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({digits}) BETWEEN 10 AND 15"),
        found_sql(4, "id", token, 0, "true"),
    ]
    words = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')".replace("\\\\", "\\")
    shape = "regexp_replace(regexp_replace(m, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g')"
    rounds, scores = [], "s0"
    for k in range(boot.rounds):
        rounds.append(f"""p{k} AS (SELECT p, hit / every AS conf FROM (SELECT p, every, sum(n * score) AS hit, count(*) FILTER (WHERE score >= {boot.confidence}) AS support FROM graph JOIN {scores} USING (m) GROUP BY p, every) WHERE support >= {boot.support})""")
        rounds.append(f"""s{k + 1} AS (SELECT m, greatest(max(seed)::DOUBLE, 1 - exp(sum(ln(greatest(1 - coalesce(conf, 0), 1e-9))))) AS score FROM graph LEFT JOIN p{k} USING (p) GROUP BY m)""")
        scores = f"s{k + 1}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
every_ AS MATERIALIZED ({" UNION ALL ".join(kinds)}),
o AS (SELECT *, max(CASE WHEN k < 4 THEN e ELSE 0 END) OVER (PARTITION BY rid ORDER BY s, k, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q,
  min(CASE WHEN k < 4 THEN s END) OVER (PARTITION BY rid ORDER BY s, k, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM every_),
edge AS MATERIALIZED (SELECT rid, s, e, m, CASE WHEN k < 4 THEN 1 ELSE 0 END AS seed, lower(w[-1]) AS w1, lower(w[-2]) AS w2, lower(f[1]) AS r
  FROM (SELECT *, {words.format("before")} AS w, {words.format("after")} AS f FROM o WHERE coalesce(q, 0) <= s AND (k < 4 OR coalesce(nx >= e, true)))),
pat AS MATERIALIZED (SELECT rid, s, e, m, seed, x.kind AS kind, x.kind || ' ' || x.p AS p, x.c AS c FROM (SELECT rid, s, e, m, seed, unnest(list_filter([
    CASE WHEN regexp_matches(w1, '\p{{L}}') THEN {{'kind': 1, 'p': w1, 'c': '1 ' || w1}} END,
    CASE WHEN regexp_matches(w2 || w1, '\p{{L}}') THEN {{'kind': 2, 'p': w2 || ' ' || w1, 'c': '2 ' || w2 || ' ' || w1}} END,
    CASE WHEN regexp_matches(w1, '\p{{L}}') AND r IS NOT NULL THEN {{'kind': 3, 'p': w1 || ' ' || r, 'c': '3 ' || w1 || ' ' || r}} END,
    CASE WHEN regexp_matches(w1, '\p{{L}}') THEN {{'kind': 4, 'p': w1 || ' ' || {shape}, 'c': '1 ' || w1}} END], lambda y: y IS NOT NULL)) AS x FROM edge)),
g0 AS (SELECT kind, p, c, m, count(*) AS n, max(seed) AS seed FROM pat GROUP BY kind, p, c, m),
own AS (SELECT kind, p, c, sum(n) AS own FROM g0 GROUP BY kind, p, c HAVING count(*) >= {boot.support}),
ws AS (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {words.format("lower(t)")} AS ws FROM d)),
said AS (SELECT unnest(['1 ' || ws[i], CASE WHEN i > 1 THEN '2 ' || ws[i - 1] || ' ' || ws[i] END, CASE WHEN i > 2 THEN '3 ' || ws[i - 2] || ' ' || ws[i] END]) AS c FROM ws),
total AS (SELECT c, count(*) AS total FROM said WHERE c IN (SELECT c FROM own) GROUP BY c),
sized AS (SELECT p, 1 + CASE WHEN kind = 4 THEN own + {boot.other} * coalesce(total, 0) ELSE greatest(own, coalesce(total, 0)) END::DOUBLE AS every FROM own LEFT JOIN total USING (c)),
graph AS MATERIALIZED (SELECT g0.p, m, n, seed, every FROM g0 JOIN sized USING (p)),
s0 AS (SELECT m, max(seed)::DOUBLE AS score FROM graph GROUP BY m),
{", ".join(rounds)},
more AS (SELECT DISTINCT rid, s, e FROM pat JOIN p{boot.rounds - 1} USING (p) WHERE seed = 0 AND conf >= {boot.confidence}),
spans AS (SELECT rid, k, kind, s, e FROM every_ WHERE k < 4 UNION ALL SELECT rid, 4, 'id', s, e FROM more),
a AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP10_SQL = _sql()
