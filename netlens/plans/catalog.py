"""The driver contract: every analytic as (spark, sf_dir) -> DataFrame, plus its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import log_view, view_sql
from . import raw, written
from .registry import Analytic, analytics


def _runner(a: Analytic) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return a.build(log_view(spark, sf_dir, a.log_type))
    run.__name__ = a.key
    run.__doc__ = a.doc
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {a.key: _runner(a) for a in analytics()} | raw.QUERIES | written.QUERIES


def oracle_sql() -> dict[str, str]:
    return {a.key: f"WITH v AS ({view_sql(a.log_type)}) SELECT * FROM ({a.sql}) AS q"
            for a in analytics() if a.sql is not None} | raw.ORACLE_SQL | written.oracle_sql()
