"""URL filter: a trie over reversed host labels, then path segments, with the longest match ruling.

A walk over the labels of a url's host from the right passes every rule that
covers the host; at each such node the path trie is walked by segments. The rules
are broadcast, after a check of their number; the urls are one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import parts_of, table

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"


#: Fixed values of the query's contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """A trie of host labels from the right; ``_RULES`` of a host node holds a trie of path segments.

    The last segment of a rule is a prefix of a segment: ``_ENDS`` of a path node holds a
    trie of its characters, and ``_HERE`` the rules that end at a character. A url thus costs its own
    length, however many rules a host has.
    """

    _RULES, _ENDS, _HERE = object(), object(), object()

    def __init__(self, rules):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self._RULES, {})
            *segments, last = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node = node.setdefault(self._ENDS, {})
            for c in last:
                node = node.setdefault(c, {})
            node.setdefault(self._HERE, []).append(rule)

    def find(self, host: str, path: str) -> UrlRule | None:
        """The longest rule that fits: most characters of host and path, then of the host; block before allow."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(self._RULES)
            for segment in segments:
                if at is None:
                    break
                here, place = at.get(self._ENDS), 0
                while here is not None:
                    for rule in here.get(self._HERE, ()):
                        rank = (len(rule.host) + len(rule.path), len(rule.host), rule.verdict == "block")
                        if best is None or rank > best[0]:
                            best = (rank, rule)
                    here, place = here.get(segment[place : place + 1]) if place < len(segment) else None, place + 1
                at = at.get(segment)
        return best and best[1]


_RESULT = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_rules: int = 1_000_000) -> DataFrame:
    """Host, path, ruling rule and verdict of each url: ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; of
    those that fit the longest rules. Where none fits, ``rule`` is null and the
    verdict is ``default``. A null url, or one without ``://``, has an empty host and
    path and fits no rule. Every row gives a row, with null or repeated ids too;
    other columns are ignored. More than ``most_rules`` rules are refused rather
    than broadcast.
    """
    rules = tuple(rules)
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules are more than most_rules={most_rules}, which bounds the broadcast")
    sent = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UrlTrie(sent.value)
        for batch in parts_of(batches, "url"):
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = trie.find(host, path)
                hosts.append(host)
                paths.append(path)
                names.append(rule and rule.host + rule.path)
                verdicts.append(rule.verdict if rule else default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, _RESULT)


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
v AS (SELECT *, '.' || host AS h FROM h),
w AS (SELECT page_id, host, path, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM v)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM w
"""
