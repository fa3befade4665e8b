"""The catalogue of named analytics.

Each entry: a key, the log type it reads, a builder (log DataFrame -> result
DataFrame, built from ``netlens.operators``) and, when the result is SQL
expressible, the equivalent SQL over a relation ``v`` holding the log. The SQL
is written independently of the builder and serves as the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import (count_hourly, distinct_hourly, hourly_dense, ratio_of_sums_hourly, share_hourly,
                         sum_hourly, top_k, value_counts)
from ..operators.hourly import safe_ratio

Predicate = Callable[[], Column]  # built on use: a Column needs a running session


@dataclass(frozen=True)
class Hourly:
    """A feature per source and hour: alone (``build``) or as one aggregate of the shared table.

    ``kind``: count (of the rows matching ``where``), share (of rows matching ``where``), distinct
    (values of ``col``), sum (of ``col``), ratio (sum of ``col`` / sum of ``den``)."""
    kind: str
    name: str = "count"
    where: Predicate | None = None
    col: str | None = None
    den: str | None = None
    key: str = "id_orig_h"

    @property
    def sparse(self) -> bool:
        """A filtered count has no row where nothing matches."""
        return self.kind == "count" and self.where is not None

    def build(self, v: DataFrame) -> DataFrame:
        if self.kind == "count":
            return count_hourly(v, self.key, self.where and self.where(), name=self.name)
        if self.kind == "share":
            return share_hourly(v, self.key, self.where(), name=self.name)
        if self.kind == "distinct":
            return distinct_hourly(v, self.key, self.col, name=self.name)
        if self.kind == "sum":
            return sum_hourly(v, self.key, self.col, name=self.name)
        return ratio_of_sums_hourly(v, self.key, self.col, self.den, name=self.name)

    def aggregate(self, approx_distinct: bool = False) -> Column:
        """The feature as an aggregate over all rows of a (source, hour)."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
        if self.kind == "count":
            return F.count_if(self.where()) if self.where else F.count(F.lit(1))
        if self.kind == "share":
            return F.count_if(self.where()) / F.count(F.lit(1))
        if self.kind == "distinct":
            return F.approx_count_distinct(self.col, 0.01) if approx_distinct else F.count_distinct(self.col)
        return total(self.col) if self.kind == "sum" else safe_ratio(total(self.col), total(self.den))


@dataclass(frozen=True)
class Frequency:
    """Rows per value of ``col``: the full table, or the ``k`` most frequent."""
    col: str
    k: int | None = None
    keep_null: bool = False

    def build(self, v: DataFrame) -> DataFrame:
        return value_counts(v, self.col, dropna=not self.keep_null) if self.k is None else top_k(v, self.col, self.k)


@dataclass(frozen=True)
class Dense:
    """Rows per hour, gaps as 0, of the rows matching ``where``."""
    where: Predicate | None = None

    def build(self, v: DataFrame) -> DataFrame:
        return hourly_dense(v, self.where and self.where())


@dataclass(frozen=True)
class Analytic:
    key: str
    log_type: str
    build: Callable[[DataFrame], DataFrame]
    sql: str | None
    doc: str = ""
    spec: Hourly | Frequency | Dense | None = None


REGISTRY: dict[str, Analytic] = {}


def _default_doc(key: str, log_type: str) -> str:
    """A description from the key's naming pattern, for analytics without a docstring."""
    words = key[len(log_type) + 1:].replace("_", " ")
    if key.endswith("_shape"):
        return "Row and column count."
    if key.endswith("_sample"):
        return "Five rows in a fixed total order."
    if key.endswith("_counts"):
        return f"Frequency table: {words[:-len(' counts')]} (rows per value)."
    if "_top_" in key or key.startswith(f"{log_type}_top"):
        return f"The {words.replace('top ', '', 1)} seen most often, with their counts."
    if key.endswith("_summary"):
        return f"Summary of {words[:-len(' summary')]}: count, mean, std, min, quartiles, max."
    if key.endswith("_detail"):
        return f"Matching rows: {words[:-len(' detail')]}."
    return words[:1].upper() + words[1:] + "."


def define(key: str, log_type: str, sql: str | None, spec: Hourly | Frequency | Dense,
           doc: str = "") -> Callable[[DataFrame], DataFrame]:
    """Registers an analytic by its specification, which also serves the shared tables of
    ``features``; returns its builder."""
    def build(v: DataFrame) -> DataFrame:
        return spec.build(v)
    build.__doc__ = doc
    return register(key, log_type, sql, spec)(build)


def register(key: str, log_type: str, sql: str | None, spec: Hourly | Frequency | Dense | None = None):
    def deco(fn: Callable[[DataFrame], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate analytic {key}")
        doc = (fn.__doc__ or "").strip() or _default_doc(key, log_type)
        REGISTRY[key] = Analytic(key, log_type, fn, sql, doc, spec)
        return fn
    return deco


def analytics(log_type: str | None = None) -> list[Analytic]:
    from . import conn, dns, files, http, kerberos, ssl, weird  # noqa: F401  (registration)
    return [a for a in REGISTRY.values() if log_type is None or a.log_type == log_type]


def specs(log_type: str, kind: type) -> dict:
    """analytic key -> specification, of the analytics of ``log_type`` defined by a ``kind``."""
    return {a.key: a.spec for a in analytics(log_type) if isinstance(a.spec, kind)}
