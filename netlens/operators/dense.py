"""Dense hourly counts (A19) and the key x value cross-tab."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import HOUR, hour_of


def hourly_dense(df: DataFrame, where: Column | None = None, name: str = "count",
                 ts: str = "ts") -> DataFrame:
    """Rows per hour for EVERY hour from the first to the last matching row. The raw rows
    are read once, into one count per hour present."""
    d = df.where(F.col(ts).isNotNull())
    if where is not None:
        d = d.where(where)
    counts = d.groupBy(hour_of(ts).alias(HOUR)).agg(F.count(F.lit(1)).alias(name))
    return fill_hours(counts, name)


def fill_hours(counts: DataFrame, name: str = "count") -> DataFrame:
    """Dense series from (hour, count) rows of the hours present: every hour from the first to
    the last, gaps as 0.

    The spine grows from one row (first, last): a row per day, dealt out by day, then a row per
    hour of each day, and the counts join it on the hour. No window over the whole series."""
    span = counts.agg(F.min(HOUR).alias("__lo"), F.max(HOUR).alias("__hi")).where(F.col("__lo").isNotNull())
    one_day, one_hour = F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 HOUR")
    day = lambda c: F.date_trunc("DAY", c).cast(counts.schema[HOUR].dataType)
    days = span.select("__lo", "__hi", F.explode(F.sequence(day(F.col("__lo")), day(F.col("__hi")), one_day)).alias("__d")) \
        .repartition("__d")
    hours = F.sequence(F.greatest("__lo", "__d"), F.least(F.col("__hi"), F.col("__d") + F.expr("INTERVAL 23 HOUR")), one_hour)
    return days.select(F.explode(hours).alias(HOUR)).join(counts.select(HOUR, name), HOUR, "left") \
        .select(HOUR, F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name))


def crosstab(df: DataFrame, key: str, col: str, values: Sequence, other: str | None = "other") -> DataFrame:
    """Per ``key``, the row count of each of ``values`` in ``col``, gaps as 0, and the count of
    rows with any other value as column ``other`` (None: without it).

    One conditional aggregate per value: a single shuffle on ``key`` with map-side partial
    counts (``pivot`` would aggregate twice). The values are a parameter, so building the plan
    runs no job. NULL keys and values are left out."""
    if other is not None and other in [str(v) for v in values]:
        raise ValueError(f"the column for other values is named like a value: {other!r}")
    d = df.where(F.col(key).isNotNull() & F.col(col).isNotNull())
    counts = [F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values]
    if other is not None:
        counts.append(F.count_if(~F.col(col).isin(list(values))).alias(other))
    return d.groupBy(key).agg(*counts)
