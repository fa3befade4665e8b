"""Sinks: CSV export with raw Zeek names (S11) and the per-analytic report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as Z


def raw_names(log_type: str) -> dict[str, str]:
    return {Z.canonical(f): f for f in Z.FIELDS.get(log_type, {}) if "." in f}


def with_derived(df: DataFrame, log_type: str | None) -> DataFrame:
    """The columns a conn analysis adds before it exports the table: ``duration_seconds`` and
    ``bytes_per_pkt`` (those whose inputs are there)."""
    if log_type != "conn":
        return df
    if "duration" in df.columns:
        df = df.withColumn("duration_seconds", F.col("duration"))
    if {"orig_bytes", "orig_pkts"} <= set(df.columns):
        df = df.withColumn("bytes_per_pkt", F.col("orig_bytes") / (F.col("orig_pkts") + 1))
    return df


def export_csv(df: DataFrame, path: str, log_type: str | None = None) -> None:
    """The whole table, derived columns included, as CSV with a header; dotted Zeek names
    restored. Quotes inside values are doubled, and values with line breaks are quoted."""
    df = with_derived(df, log_type)
    ren = raw_names(log_type) if log_type else {c: c for c in df.columns}
    cols = [df[c].alias(ren.get(c, c)) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported table as text columns, under its dotted names."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_report(results: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Every result of a run as its own table under ``path/<name>``."""
    written = []
    for name, df in results.items():
        out = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", True).save(out)
        written.append(out)
    return written
