"""Spans of regular-expression matches in code points, as native expressions.

Java, RE2 and Python agree on the patterns of the contracts. The forms used here
add possessive quantifiers, which only stop backtracking that can't help, and
``(?:\\G|(?<!...))``, which only skips starts inside a run that failed at its
beginning; both keep long runs linear and the stack flat.

A text may have as many matches as characters, so nothing here is quadratic in
them: places are running sums, spans that meet are told by running maxima over the
spans in order, and both come from doubling steps over whole arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Code points of the pieces in which a text is cut up before many parts are taken from it.
CHUNK = 1024


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL that binds a value to a name, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, step: str, ahead: bool = False) -> str:
    """SQL for the running sum, maximum or minimum of an array of numbers, from its start or with ``ahead`` from its end.

    ``step`` joins ``x`` and ``y``, of which y is null beyond the array. Each
    doubling step adds what stands 1, 2, 4, ... places off: n log n in all.
    """
    other = f"get(a, i {'+' if ahead else '-'} shiftleft(1, k))"
    return let(
        "z",
        values,
        f"aggregate(sequence(0, greatest(cast(ceil(log2(size(z))) AS int) - 1, 0)), z, (a, k) -> transform(a, (x, i) -> {let('y', other, step)}))",
    )


SUM, MAX, MIN = "x + coalesce(y, 0)", "greatest(x, y)", "least(x, y)"


def matches(text: str, pattern: str, group: int = 0, valid: str = "true", context: bool = False, needs: str = "") -> str:
    """SQL for the leftmost non-overlapping matches in a column: ``s, e`` (end exclusive), the match ``m``, its group ``v``.

    ``valid`` is a condition on a match ``x``. ``needs`` is text that every match
    holds, so that a text without it costs no search. With ``context`` a match has
    also the last two words before it, ``w2`` and ``w1``, and the first after it,
    ``r``, in lower case, where words end at other matches; null where there is none.
    """
    pat = quoted(pattern)
    fields = "s:int,e:int,m:string,v:string" + (",w2:string,w1:string,r:string" if context else "")
    words = f"filter(split(get(p, x.i + {{}}), {quoted(SPACE)}{{}}), w -> w <> '')"
    around = ", 'w2', lower(get(b, size(b) - 2)), 'w1', lower(get(b, size(b) - 1)), 'r', lower(get(f, 0))" if context else ""
    made = f"named_struct('s', x.s, 'e', x.e, 'm', x.m, 'v', x.v{around})"
    if context:
        made = let("b", words.format(0, ""), let("f", words.format(1, ", 3"), made))
    each = "named_struct('s', get(c, i) - length(x), 'e', get(c, i), 'm', x, 'v', get(g, i), 'i', i)"
    places = running("transform(h, (x, i) -> length(get(p, i)) + length(x))", SUM)
    found = f"transform(filter(transform(h, (x, i) -> {each}), x -> {valid}), x -> {made})"
    groups = "h" if group == 0 else f"regexp_extract_all({text}, {pat}, {group})"
    found = let("p", f"split({text}, {pat}, -1)", let("h", f"regexp_extract_all({text}, {pat}, 0)", let("g", groups, let("c", places, found))))
    test = f"contains({text}, {quoted(needs)}) AND " if needs else ""
    return f"CASE WHEN {test}{text} RLIKE {pat} THEN {found} ELSE cast(array() AS array<struct<{fields}>>) END"


def in_order(kinds: dict[str, str], fields: tuple[str, ...] = ()) -> str:
    """SQL for all spans of the named array columns as ``s, k, e, kind`` and further fields, by start, then by the order of the kinds."""
    more = "".join(f", '{f}', x.{f}" for f in fields)
    parts = [f"transform({column}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{kind}'{more}))" for k, (kind, column) in enumerate(kinds.items())]
    return f"sort_array(concat({', '.join(parts)}))"


def apart(spans: str, base: int, made: str) -> str:
    """SQL for what ``made`` says of each span ``x`` of an ordered array that stands apart.

    Spans of the first ``base`` kinds stand apart if none of these kinds that comes
    before them reaches over their start; other spans must not meet any of them.
    """
    ends = running(f"transform(o, x -> CASE WHEN x.k < {base} THEN x.e ELSE 0 END)", MAX)
    starts = running(f"transform(o, x -> CASE WHEN x.k < {base} THEN x.s ELSE {2**31 - 1} END)", MIN, ahead=True)
    free = f"coalesce(get(q, i - 1), 0) <= x.s AND (x.k < {base} OR coalesce(get(n, i + 1) >= x.e, true))"
    kept = "filter(transform(o, (x, i) -> CASE WHEN " + free + " THEN " + made + " END), x -> x IS NOT NULL)"
    return let("o", spans, let("q", ends, let("n", starts, kept)))


def tagged(kinds: dict[str, str]) -> Column:
    """All spans of the named array columns as ``array<struct<s, k, e, kind>>``, by start, then by the order of the kinds."""
    return F.expr(in_order(kinds))


def listed(spans: str) -> Column:
    """``kind:start:end`` of tagged spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def _part(a: str, b: str) -> str:
    """SQL for the code points from a to before b of a text that is cut up as ``t``."""
    first, last = f"({a}) div {CHUNK}", f"(({b}) - 1) div {CHUNK}"
    return f"""CASE WHEN ({a}) >= ({b}) THEN '' WHEN {first} = {last} THEN substr(get(t, cast({first} AS int)), ({a}) % {CHUNK} + 1, ({b}) - ({a}))
      ELSE concat(substr(get(t, cast({first} AS int)), ({a}) % {CHUNK} + 1), array_join(slice(t, cast({first} AS int) + 2, cast({last} - {first} AS int) - 1), ''), substr(get(t, cast({last} AS int)), 1, (({b}) - 1) % {CHUNK} + 1)) END"""


def replaced(text: str, spans: str) -> Column:
    """The text with its tagged spans, which are in order, replaced by their kind in brackets; of spans that meet, the first stays for all.

    Spans that meet are one from the first's start to the last's end.
    """
    begins = "filter(transform(o, (x, i) -> CASE WHEN coalesce(get(q, i - 1), 0) <= x.s THEN x END), x -> x IS NOT NULL)"
    stops = "filter(transform(q, (x, i) -> CASE WHEN i = size(q) - 1 OR get(o, i + 1).s >= x THEN x END), x -> x IS NOT NULL)"
    body = f"concat(array_join(transform(u, (x, i) -> concat({_part('coalesce(get(w, i - 1), 0)', 'x.s')}, '[', upper(x.kind), ']')), ''), {_part('get(w, size(w) - 1)', 'length(_whole)')})"
    made = let("q", running("transform(o, x -> x.e)", MAX), let("u", begins, let("w", stops, let("t", f"regexp_extract_all(_whole, '(?s).{{1,{CHUNK}}}', 0)", body))))
    return F.expr(let("_whole", text, let("o", spans, f"CASE WHEN size(o) = 0 THEN _whole ELSE {made} END")))


def found_sql(kind: int, name: str, pattern: str, group: int, valid: str, source: str = "d") -> str:
    """DuckDB's SQL for the matches of a contract's pattern in a table of ``rid, t``: ``rid, k, kind, s, e, m`` and the pieces ``before`` and ``after`` a match.

    Places are sums over the pieces and matches before: for tables of tests, whose texts have few matches.
    """
    pat = "'" + pattern.replace("'", "''") + "'"
    value = f"regexp_extract_all(t, {pat}, {group})" if group else "ms"
    return f"""SELECT rid, {kind} AS k, '{name}' AS kind, s, s + length(m) AS e, m, before, after FROM (
    SELECT rid, ms[i] AS m, vs[i] AS v, ps[i] AS before, ps[i + 1] AS after,
      (coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, t, ms, ps, {value} AS vs FROM (
      SELECT rid, t, regexp_extract_all(t, {pat}) AS ms, regexp_split_to_array(t, {pat}) AS ps FROM {source} WHERE regexp_matches(t, {pat}))))) WHERE {valid}"""
