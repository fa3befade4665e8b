"""Batch jobs: one per log type with the capture day as a parameter.

``ingest``: raw rotated files of one or more days -> typed, partitioned Parquet
(read once). ``report``: every named analytic of a log type over the landed
Parquet (each reads only its columns; the day filter prunes folders), written
as one table per analytic, plus the CSV export of the day.

    python -m netlens.jobs ingest --raw /logs --landed /lake/zeek --date 2025-01-09
    python -m netlens.jobs report --landed /lake/zeek --type dns --date 2025-01-09 --out /reports
    python -m netlens.jobs report ... --key dns_failed_ratio_hourly --key dns_top_queries
    python -m netlens.jobs list --type dns
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .plans.features import (dense_keys, feature_keys, frequency_keys, frequency_tables,
                             host_hour_features, hourly_counts_table, split_dense, split_features,
                             split_frequencies)
from .plans.registry import analytics
from .schemas import REQUIRED
from .sources.ingest import land, read_landed
from .sources.sinks import export_csv, write_report
from .sources.zeek import SRC, conform, read_log


def ingest(spark: SparkSession, raw_root: str, landed: str, dates: list[str] | None = None,
           log_types: list[str] | None = None, allow_missing: bool = False) -> None:
    """Reads the raw files of each day and type and lands them. A day without a folder is
    skipped with a warning; a log that lacks a column its analytics read is an error that names
    it (with ``allow_missing`` a warning, and the column reads as NULL)."""
    for d in dates or [None]:
        root = f"{raw_root.rstrip('/')}/{d}" if d else raw_root
        for t in log_types or list(REQUIRED):
            try:
                df = read_log(spark, root, t)
            except AnalysisException as e:
                if d is None or e.getCondition() != "PATH_NOT_FOUND":
                    raise
                warnings.warn(f"no folder for {d}: {root}", stacklevel=2)
                break
            if SRC in df.columns and not df.isEmpty():
                land(conform(df, t, allow_missing), landed)


def report_tables(log: DataFrame, log_type: str, keys: list[str] | tuple | None = None,
                  params: dict[str, dict] | None = None, allow_missing: bool = False) -> dict[str, DataFrame]:
    """The named analytics of ``log_type`` on ``log`` (lazy DataFrames): all of them,
    or ``keys``; ``params`` passes keyword arguments per key (day variants). A log that lacks a
    column is refused by name unless ``allow_missing``."""
    v = conform(log, log_type, allow_missing)
    params = params or {}
    return {a.key: a.build(v, **params.get(a.key, {})) for a in analytics(log_type)
            if keys is None or a.key in keys}


def report(spark: SparkSession, landed: str, log_type: str, date: str, out: str,
           export: bool = True, fmt: str = "parquet", keys=None, params=None,
           shared: bool = True) -> list[str]:
    """Write every analytic of ``log_type`` for ``date`` (or ``keys``).

    With ``shared``, three groups are computed once each: the source-keyed hourly
    features (one aggregate), the unfiltered frequency / top-k tables (one
    stacked aggregate) and the dense hourly series (one per-hour aggregate). Each shared table is written first (a written table cuts
    the lineage and survives executor loss); the analytics of the group are then
    projections of it, equal to their individual results."""
    known = [a.key for a in analytics(log_type)]
    wanted = list(keys) if keys is not None else known
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise ValueError(f"not {log_type} analytics: {unknown}")
    v = log = read_landed(spark, landed, log_type, [date])
    base = f"{out.rstrip('/')}/{log_type}/{date}"
    params = params or {}
    written, tables = [], {}
    if shared:
        groups = [("_host_hour_features", feature_keys(log_type),
                   lambda: host_hour_features(v, log_type),
                   lambda t: split_features(t, log_type)),
                  ("_frequencies", frequency_keys(log_type),
                   lambda: frequency_tables(v, log_type),
                   lambda t: split_frequencies(t, v.schema, log_type)),
                  ("_hourly_counts", dense_keys(log_type),
                   lambda: hourly_counts_table(v, log_type),
                   lambda t: split_dense(t, log_type))]
        for name, gkeys, build, split in groups:
            gkeys = [k for k in gkeys if k in wanted and k not in params]
            if len(gkeys) < 2:  # a lone analytic runs on its own
                continue
            path = f"{base}/{name}"
            build().write.mode("overwrite").parquet(path)
            parts = split(spark.read.parquet(path))
            tables.update({k: parts[k] for k in gkeys})
            written.append(path)
    rest = [k for k in wanted if k not in tables]
    tables.update(report_tables(log, log_type, rest, params))
    written += write_report(tables, base, fmt)
    if export:
        export_csv(read_landed(spark, landed, log_type, [date], all_columns=True), f"{base}/_export", log_type)
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="netlens.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--raw", required=True)
    i.add_argument("--landed", required=True)
    i.add_argument("--date", action="append")
    i.add_argument("--type", action="append")
    i.add_argument("--allow-missing", action="store_true", help="land logs that lack columns (read as NULL)")
    r = sub.add_parser("report")
    r.add_argument("--landed", required=True)
    r.add_argument("--type", required=True)
    r.add_argument("--date", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="parquet")
    r.add_argument("--key", action="append", help="only these analytics (default: all of the type)")
    ls = sub.add_parser("list", help="the named analytics (key, log type, description)")
    ls.add_argument("--type")
    a = p.parse_args(argv)
    if a.cmd == "list":
        for an in analytics(a.type):
            print(f"{an.key}\t{an.log_type}\t{(an.doc.splitlines() or [''])[0]}")
        return
    from .session import get_spark
    spark = get_spark()
    if a.cmd == "ingest":
        ingest(spark, a.raw, a.landed, a.date, a.type, a.allow_missing)
    else:
        report(spark, a.landed, a.type, a.date, a.out, fmt=a.format, keys=a.key)


if __name__ == "__main__":
    main()
