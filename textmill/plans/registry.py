"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from textmill.plans import classify, corpus, dedup, scaling, tensor, text, tokens

QUERIES: dict = {}
SQL: dict = {}
for _module in (text, dedup, tokens, scaling, classify, corpus, tensor):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
