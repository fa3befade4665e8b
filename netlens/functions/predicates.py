"""Row predicates of the analytics, each with its null rule spelled out.

A predicate returns a boolean Column; used in ``where`` a NULL result drops the
row, used in ``count_if`` it is not counted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_equal_or_null(c: str | Column, value) -> Column:
    """``c <> value`` where a NULL ``c`` counts as different (float NaN != x)."""
    return ~_c(c).eqNullSafe(value)


def not_equal(c: str | Column, value) -> Column:
    """``c <> value``; NULL drops out."""
    return _c(c) != value


def between(c: str | Column, lo, hi) -> Column:
    """Inclusive range; NULL drops out."""
    return _c(c).between(lo, hi)


def in_set(c: str | Column, values: Iterable) -> Column:
    return _c(c).isin(list(values))


def set_and_not_in(c: str | Column, values: Iterable) -> Column:
    """Value present and outside the set."""
    col = _c(c)
    return col.isNotNull() & ~col.isin(list(values))


def not_matching(c: str | Column, pattern: str) -> Column:
    """Regex (find anywhere, case-sensitive) does NOT match; NULL counts as not matching."""
    return ~F.coalesce(_c(c).rlike(pattern), F.lit(False))


def set_and_lacks_ci(c: str | Column, needle: str) -> Column:
    """Value present and not containing ``needle`` in any letter case."""
    col = _c(c)
    return col.isNotNull() & ~F.lower(col).contains(needle.lower())


def is_true(c: str | Column) -> Column:
    return _c(c).eqNullSafe(True)


def is_false(c: str | Column) -> Column:
    return _c(c).eqNullSafe(False)


def non_empty(c: str | Column) -> Column:
    """Present and not the empty string."""
    col = _c(c)
    return col.isNotNull() & (col != "")


def any_of(*preds: Column) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def all_of(*preds: Column) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out
