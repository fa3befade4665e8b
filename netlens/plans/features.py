"""The shared tables of a report run, from the registry's specifications.

A report run needs several analytics of the same shape of the same log. Computed one by one,
each is a scan plus a shuffle; here the source-keyed hourly features are one
``groupBy(key, hour).agg(...)`` (plus Spark's extra shuffle for the single exact distinct), the
frequency and top-k tables one stacked aggregate, and the dense hourly series one per-hour
aggregate. Each analytic is then a projection of its shared table; the count features keep only
non-zero rows, as they do when computed alone. The definitions are those of the analytics
themselves (``registry.define``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import HOUR, hour_of
from ..operators.dense import fill_hours
from .registry import Dense, Frequency, Hourly, specs

KEY = "id_orig_h"


def feature_keys(log_type: str) -> list[str]:
    return [k for k, h in specs(log_type, Hourly).items() if h.key == KEY]


def feature_aggregates(log_type: str, approx_distinct: bool = False) -> dict[str, Column]:
    """analytic key -> aggregate, for the source-keyed hourly features of ``log_type``."""
    return {k: specs(log_type, Hourly)[k].aggregate(approx_distinct) for k in feature_keys(log_type)}


def host_hour_features(v: DataFrame, log_type: str, ts: str = "ts") -> DataFrame:
    """(id_orig_h, hour, one column per analytic key) for every (source, hour) present."""
    d = v.where(F.col(KEY).isNotNull() & F.col(ts).isNotNull()).withColumn(HOUR, hour_of(ts))
    return d.groupBy(KEY, HOUR).agg(*[agg.alias(k) for k, agg in feature_aggregates(log_type).items()])


def split_features(wide: DataFrame, log_type: str) -> dict[str, DataFrame]:
    """Each analytic's table from the wide feature table."""
    out = {}
    for k in feature_keys(log_type):
        spec = specs(log_type, Hourly)[k]
        t = wide.select(KEY, HOUR, F.col(k).alias(spec.name))
        out[k] = t.where(F.col(spec.name) > 0) if spec.sparse else t
    return out


# --- frequency tables -------------------------------------------------------


def frequency_keys(log_type: str) -> list[str]:
    return list(specs(log_type, Frequency))


def frequency_tables(v: DataFrame, log_type: str) -> DataFrame:
    """(column_name, value STRING, count) for every column a frequency analytic of
    ``log_type`` reads: one scan, one aggregate. NULL values are kept (flagged by a
    NULL ``value``); each analytic decides whether it shows them."""
    cols = sorted({f.col for f in specs(log_type, Frequency).values()})
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
             for c in cols]
    stacked = v.select(F.explode(F.array(*items)).alias("__s")).select("__s.*")
    return stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def split_frequencies(freq: DataFrame, v_schema, log_type: str) -> dict[str, DataFrame]:
    """Each frequency / top-k analytic of ``log_type`` from the stacked table; values
    are cast back to the column's type, so the tables equal the individual results."""
    types = {f.name: f.dataType for f in v_schema.fields}
    out = {}
    for k, f in specs(log_type, Frequency).items():
        c = f.col
        t = freq.where(F.col("column_name") == c)
        if not f.keep_null:
            t = t.where(F.col("value").isNotNull())
        t = t.select(F.col("value").cast(types[c]).alias(c), "count")
        if f.k is not None:
            t = t.orderBy(F.desc("count"), F.asc_nulls_first(c)).limit(f.k)
        out[k] = t
    return out


# --- dense hourly series ----------------------------------------------------


def dense_keys(log_type: str) -> list[str]:
    return list(specs(log_type, Dense))


def hourly_counts_table(v: DataFrame, log_type: str, ts: str = "ts") -> DataFrame:
    """(hour, one count per dense analytic) for every hour present: one scan."""
    aggs = [(F.count_if(d.where()) if d.where else F.count(F.lit(1))).alias(k) for k, d in specs(log_type, Dense).items()]
    return v.where(F.col(ts).isNotNull()).groupBy(hour_of(ts).alias(HOUR)).agg(*aggs)


def split_dense(wide: DataFrame, log_type: str) -> dict[str, DataFrame]:
    """Each dense series from the shared per-hour table: its own first-to-last range."""
    return {k: fill_hours(wide.where(F.col(k) > 0).select(HOUR, F.col(k).alias("count")), "count")
            for k in dense_keys(log_type)}
