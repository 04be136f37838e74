"""Row filters that need more than one built-in predicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.operators.ordering import exact_quantiles
from curate.session import as_column


def contains_regex(text: str | Column, pattern: str) -> Column:
    """Regular-expression search: ``.`` in ``ac.uk`` matches any character."""
    return as_column(text).rlike(pattern)


def any_token_startswith(text: str | Column, sep: str, prefix: str) -> Column:
    """True when a token of the ``sep``-separated text starts with ``prefix``."""
    tokens = F.split(as_column(text), f"\\Q{sep}\\E")
    return F.exists(tokens, lambda t: t.startswith(prefix))


def filter_any_keyword(rows: DataFrame, columns: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Keep rows in which one of ``columns`` matches one of ``words`` (patterns): one search per column.

    For a table of literals, of any length, see ``patterns.filter_any_literal``.
    """
    any_word = "|".join(f"(?:{w})" for w in words)
    return rows.filter(reduce(lambda a, b: a | b, [contains_regex(c, any_word) for c in columns]))


def filter_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """Keep rows at or below the exact ``q`` quantile of ``value``."""
    limit = exact_quantiles(rows, value, {"limit": q})
    return rows.filter(F.col(value) <= limit.scalar())


def has_negative_box(objects: str | Column) -> Column:
    """True when a nested box has a negative number."""
    return F.exists(as_column(objects), lambda o: F.exists(o["bbox"], lambda v: v < 0))


def drop_invalid_boxes(rows: DataFrame, objects: str = "objects") -> DataFrame:
    """Drop rows in which any nested box holds a negative number (null counts as valid)."""
    return rows.filter(~F.coalesce(has_negative_box(objects), F.lit(False)))


def match_urls(url: str | Column, entries: Sequence[str], mode: str = "exact") -> Column:
    """True when a URL equals an entry, or with ``mode='prefix'`` starts with one.

    Prefixes are looked up in a hash set, one lookup per distinct entry length, so that
    thousands of entries cost no join.
    """
    url = as_column(url)
    if mode == "exact":
        return url.isin(list(entries))
    if mode != "prefix":
        raise ValueError(f"mode must be 'exact' or 'prefix', not {mode!r}")
    by_length: dict[int, list[str]] = {}
    for entry in entries:
        by_length.setdefault(len(entry), []).append(entry)
    tests = [F.substring(url, 1, n).isin(same) for n, same in sorted(by_length.items())]
    return reduce(lambda a, b: a | b, tests)


def keep_urls(rows: DataFrame, url: str, entries: Sequence[str], mode: str = "exact") -> DataFrame:
    return rows.filter(match_urls(url, entries, mode))


def drop_prefix_url(rows: DataFrame, url: str, entries: Sequence[str], mode: str = "exact") -> DataFrame:
    """Drop rows whose URL is listed; rows without a URL stay."""
    return rows.filter(~F.coalesce(match_urls(url, entries, mode), F.lit(False)))
