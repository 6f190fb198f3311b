"""Pieces of SQL that the queries' oracles share; each takes the name of a column."""

from __future__ import annotations

from recollect.functions import text as X


def word_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9'']+')"


def content(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: length(t) >= 2 AND NOT list_contains({word_list(X.STOP_WORDS)}, t))"


def numerics(c: str) -> str:
    months = f"list_filter({tokens(c)}, lambda t: list_contains({word_list(X.MONTHS + X.SHORT_MONTHS)}, t))"
    return f"list_distinct(list_concat(regexp_extract_all(coalesce({c}, ''), '[0-9]+(?:[.,][0-9]+)?'), {months}))"
