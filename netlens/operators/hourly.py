"""Per key, per hour features.

Every operator drops rows whose key or event time is NULL (a pandas group key
never is NULL) and returns only the (key, hour) pairs that occur. Each is ONE
aggregate: partial aggregation runs map-side, so a host holding a third of the
rows still ships one partial row per task to the shuffle on (key, hour).
Ratios that the source builds by aligning two separate aggregates on their
index (a full outer join) are folded into one conditional aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import report_round
from ..functions.time import HOUR, hour_of

INF = float("inf")


def _bucketed(df: DataFrame, key: str, ts: str) -> DataFrame:
    return (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
              .withColumn(HOUR, hour_of(ts)))


def _maybe_round(c: Column, digits: int | None) -> Column:
    return c if digits is None else report_round(c, digits)


def count_hourly(df: DataFrame, key: str, where: Column | None = None,
                 name: str = "count", ts: str = "ts") -> DataFrame:
    """Rows per (key, hour), optionally of the rows matching ``where``."""
    d = df if where is None else df.where(where)
    return _bucketed(d, key, ts).groupBy(key, HOUR).agg(F.count(F.lit(1)).alias(name))


def distinct_hourly(df: DataFrame, key: str, col: str, name: str | None = None,
                    approx: bool = False, rsd: float = 0.01, ts: str = "ts") -> DataFrame:
    """Distinct non-NULL ``col`` values per (key, hour); an all-NULL group gives 0.

    Exact by default. Spark plans an exact distinct as partial aggregates on
    (key, hour, col) then on (key, hour), so a hot key is spread over its
    values before the second, small shuffle. ``approx`` swaps in HyperLogLog++.
    """
    agg = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return _bucketed(df, key, ts).groupBy(key, HOUR).agg(agg.alias(name or f"unique_{col}"))


def mean_hourly(df: DataFrame, key: str, cols: str | Sequence[str], fill: float | None = None,
                names: Sequence[str] | None = None, digits: int | None = None,
                ts: str = "ts") -> DataFrame:
    """Mean of each column per (key, hour); ``fill`` replaces an all-NULL mean."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = list(names) if names else [f"avg_{c}" for c in cols]
    aggs = []
    for c, n in zip(cols, names):
        m = F.avg(c)
        if fill is not None:
            m = F.coalesce(m, F.lit(float(fill)))
        aggs.append(_maybe_round(m, digits).alias(n))
    return _bucketed(df, key, ts).groupBy(key, HOUR).agg(*aggs)


def sum_hourly(df: DataFrame, key: str, col: str, name: str | None = None,
               ts: str = "ts") -> DataFrame:
    """Sum per (key, hour); an all-NULL group sums to 0."""
    s = F.coalesce(F.sum(col), F.lit(0).cast("bigint"))
    return _bucketed(df, key, ts).groupBy(key, HOUR).agg(s.alias(name or f"sum_{col}"))


def share_hourly(df: DataFrame, key: str, pred: Column, name: str = "ratio",
                 ts: str = "ts") -> DataFrame:
    """Share of rows matching ``pred`` per (key, hour); 0 where none match."""
    return (_bucketed(df, key, ts).groupBy(key, HOUR)
            .agg((F.count_if(pred) / F.count(F.lit(1))).alias(name)))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with the float rules: 0/0 -> 0 (after the NaN fill), x/0 -> +-inf."""
    return (F.when(den != 0, num / den)
             .when(num == 0, F.lit(0.0))
             .otherwise(F.signum(num) * F.lit(INF)))


def ratio_of_sums_hourly(df: DataFrame, key: str, num: str, den: str,
                         name: str = "ratio", ts: str = "ts") -> DataFrame:
    """sum(num) / sum(den) per (key, hour); NULLs sum as 0."""
    n = F.coalesce(F.sum(num), F.lit(0).cast("bigint"))
    d = F.coalesce(F.sum(den), F.lit(0).cast("bigint"))
    return _bucketed(df, key, ts).groupBy(key, HOUR).agg(safe_ratio(n, d).alias(name))
