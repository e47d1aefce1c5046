"""Secret scan: fixed patterns and sliding-window entropy, native.

Candidates are runs of key-like characters with letters and digits. A window slides
over the candidate; when it moves, only the counts of the character that leaves and
of the one that enters change, and with them the sum of n*log2(n) over the counts,
which gives Shannon's entropy. A candidate is a secret if some window of one of its
parts between separators, or of the whole if its characters are mixed, reaches the
threshold of its character class, and no allow-list pattern speaks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.spans import apart, found_sql, in_order, let, listed, matches, quoted, tagged

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = "AKIA[A-Z0-9]++", r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"
_KEY = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_KEY})(?={_KEY}{{20}})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){_KEY}++"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Class of a candidate's characters, and the bits a window must reach; random strings of the class lie above.
THRESHOLDS = (("hex", "[0-9a-fA-F]+", 3.0), ("alnum", "[A-Za-z0-9]+", 3.6), ("key", ".+", 3.8))
#: What a candidate with separators needs besides, so that hyphenated words are none.
MIXED = "^(?=.*[a-z])(?=.*[A-Z]).*[0-9]"
#: What looks random and is no secret: identifiers of records, digests that are named as such, placeholders, alphabets.
ALLOW = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "sha(1|256|384|512)-.*",
    "(?i).*(example|placeholder|changeme|abcdefghij|0123456789|1234567890).*",
)


def window_entropy(text: str, window: int) -> str:
    """SQL for the largest entropy in bits of a window of an ASCII string of at least so many characters.

    The counts of the window's characters are a string with a place for each code.
    A step of the window raises the count of the character that enters, lowers that of
    the one that leaves, and adds what this changes to the sum of n*log2(n).
    """

    def f(n: str) -> str:
        return f"(({n}) * log2(greatest(({n}), 1)))"

    def moved(state: str, code: str, by: str) -> str:
        """The state after a count was changed: ``c`` the counts, ``sum`` of n*log2(n), ``least`` sum of a whole window so far."""
        count = f"ascii(substr({state}.c, {code} + 1, 1)) - 33"
        counts = f"overlay({state}.c PLACING chr(n {by} + 33) FROM {code} + 1)"
        return let("n", count, f"named_struct('c', {counts}, 'sum', {state}.sum + {f(f'n {by}')} - {f('n')}, 'least', {state}.least)")

    enter = moved("a", "get(z, i)", "+ 1")
    leave = f"CASE WHEN i < {window} THEN b ELSE {moved('b', f'get(z, i - {window})', '- 1')} END"
    note = f"named_struct('c', d.c, 'sum', d.sum, 'least', CASE WHEN i < {window - 1} THEN d.least ELSE least(d.least, d.sum) END)"
    slide = let("b", enter, let("d", leave, note))
    start = f"named_struct('c', repeat('!', 128), 'sum', 0.0D, 'least', {f(f'{window}.0D')})"
    codes = f"transform(filter(split({text}, ''), y -> y <> ''), y -> ascii(y))"
    return let("z", codes, f"log2({window}.0D) - aggregate(sequence(0, size(z) - 1), {start}, (a, i) -> {slide}).least / {window}")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW, thresholds=THRESHOLDS, window: int = WINDOW) -> DataFrame:
    """Secrets of each text: ``doc_id``, arrays ``assign, access, hex, entropy``, and all as ``found`` in order.

    A span has its start ``s`` and end ``e`` (exclusive) in code points. Entropy
    spans that meet a span of a fixed pattern are left out. Null and empty texts
    have none; ids may be null or repeat, every input row gives a row. Texts are
    scanned whole, other columns are ignored.
    """
    if not 1 < window <= 90:
        raise ValueError("a window has 2 to 90 characters")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def over(x: str) -> str:
        bits = " ".join(f"WHEN {x} RLIKE {quoted(f'^(?:{pattern})$')} THEN {bound}D" for _, pattern, bound in thresholds)
        return f"{window_entropy(x, window)} >= CASE {bits} END"

    parts = f"filter(split(x.m, '[_-]'), z -> length(z) >= {window})"
    rule = f"(exists({parts}, z -> {over('z')}) OR (x.m RLIKE '[_-]' AND x.m RLIKE {quoted(MIXED)} AND {over('x.m')}))"
    if allow:
        rule = f"NOT (x.m RLIKE {quoted('^(?:' + '|'.join(allow) + ')$')}) AND {rule}"
    rows = rows.withColumns(
        {
            "assign": F.expr(matches("_text", ASSIGN, 2, "length(x.v) >= 8")),
            "access": F.expr(matches("_text", ACCESS, 0, "length(x.m) >= 16", needs="AKIA")),
            "hex": F.expr(matches("_text", HEX, 0)),
            "_candidates": F.expr(matches("_text", CANDIDATE, 0)),
        }
    ).drop("_text")
    spans = in_order({k: k for k in KINDS[:3]} | {"entropy": "_candidates"}, ("m",))
    found = f"transform(filter({apart(spans, 3, 'x')}, x -> x.k = 3 AND {rule}), x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'v', x.m))"
    rows = rows.withColumn("entropy", F.expr(found)).drop("_candidates")
    return rows.withColumn("found", tagged({k: k for k in KINDS}))


def _base(found: str) -> Column:
    return F.expr(f"filter({found}, x -> x.k < 3)")


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents")).withColumn("base", _base("found"))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("found").alias("spans"),
    )


def _sql(window: int = WINDOW) -> str:
    """The query in DuckDB's SQL: windows of a candidate by unnesting, their counts by grouping."""
    allow = "^(?:" + "|".join(ALLOW) + ")$"
    bound = "CASE " + " ".join(f"WHEN regexp_matches(z, '^(?:{pattern})$') THEN {bits}" for _, pattern, bits in THRESHOLDS) + " END"
    mixed = "regexp_matches(m, '[_-]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({found_sql(0, "assign", ASSIGN, 2, "length(v) >= 8")} UNION ALL {found_sql(1, "access", "AKIA[A-Z0-9]+", 0, "length(m) >= 16")} UNION ALL {found_sql(2, "hex", "[0-9a-f]{32,}", 0, "true")}),
runs AS ({found_sql(3, "entropy", "[A-Za-z0-9+/_=-]{20,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
c AS (SELECT * FROM runs WHERE NOT regexp_matches(m, '{allow}') AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = runs.rid AND base.s < runs.e AND runs.s < base.e)),
part AS (SELECT DISTINCT m, z FROM (SELECT m, unnest(regexp_split_to_array(m, '[_-]')) AS z FROM c UNION ALL SELECT m, m FROM c WHERE {mixed}) WHERE length(z) >= {window}),
win AS (SELECT z, i, unnest(string_split(substr(z, i, {window}), '')) AS x FROM (SELECT DISTINCT z, unnest(range(1, length(z) - {window} + 2)) AS i FROM part)),
bits AS (SELECT z, max(h) AS h FROM (SELECT z, i, log2({window}) - sum(n * log2(n)) / {window} AS h FROM (SELECT z, i, x, count(*) AS n FROM win GROUP BY z, i, x) GROUP BY z, i) GROUP BY z),
key AS (SELECT DISTINCT m FROM part JOIN bits USING (z) WHERE h >= {bound}),
every AS (SELECT rid, k, kind, s, e FROM base UNION ALL SELECT rid, k, kind, s, e FROM c WHERE m IN (SELECT m FROM key)),
g AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP8_SQL = _sql()
