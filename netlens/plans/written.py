"""Checked entries for what the jobs write: landed Parquet, the CSV export, the shared report tables.

Each query writes from the log views into a new folder below the shared checkpoint folder and
returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.ingest import land, read_landed
from ..sources.sinks import export_csv, read_export, write_report
from ..sources.views import EVENTS_SCHEMA, log_view, view_sql
from ..sources.zeek import SRC
from .features import KEY, feature_keys, frequency_tables, host_hour_features, hourly_counts_table
from .raw import scratch
from .registry import Dense, Frequency, Hourly, analytics, specs

LANDED = ["id_orig_h", "id_resp_h", "id_resp_p", "proto", "service", "duration", "orig_bytes", "conn_state"]


def landed_conn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conn and weird logs landed, the conn logs twice, and the conn rows of the landed folder:
    dynamic overwrite leaves the partitions of the second run only."""
    path = scratch(spark, "landed")
    for log_type in ("conn", "weird", "conn"):
        v = log_view(spark, sf_dir, log_type).withColumn("ts", F.col("ts").cast("timestamp"))
        land(v.select("*", F.lit("events").alias(SRC), F.lit(log_type).alias("log_type"), F.to_date("ts").alias("log_date")), path)
    return read_landed(spark, path, "conn").select(F.unix_micros("ts").alias("ts_us"), *LANDED, "log_type", "log_date")


# values that a CSV file must quote, or double the quotes of
NOTE = ("CASE WHEN event_id % 7 = 0 THEN concat('say \"', event_id, '\", twice') WHEN event_id % 11 = 0 THEN concat('line', "
        "{newline}, event_id) WHEN event_id % 13 = 0 THEN NULL ELSE concat('a,b ', event_id % 10) END")


def exported_conn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conn table exported as CSV, with a text column that needs quoting, read back by its
    dotted names; both derived columns included."""
    path = scratch(spark, "export")
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    export_csv(_conn_with_note(events), path, "conn")
    d = read_export(spark, path)
    num = lambda c, t: F.col(f"`{c}`").cast(t)
    return d.select(num("event_id", "bigint").alias("event_id"), F.col("`id.orig_h`").alias("orig_h"), F.col("`id.resp_h`").alias("resp_h"),
                    num("id.resp_p", "int").alias("resp_p"), F.col("history"), num("duration_seconds", "double").alias("duration_seconds"),
                    num("bytes_per_pkt", "double").alias("bytes_per_pkt"))


def _conn_with_note(events: DataFrame) -> DataFrame:
    from ..sources.views import VIEW_EXPRS
    exprs = [e for e in VIEW_EXPRS["conn"] if not e.endswith(" AS history")]
    return events.selectExpr(*exprs, NOTE.format(newline="char(10)") + " AS history", "event_id")


def _exported_sql() -> str:
    from ..sources.views import VIEW_EXPRS
    exprs = [e for e in VIEW_EXPRS["conn"] if not e.endswith(" AS history")]
    return (f"SELECT event_id, id_orig_h AS orig_h, id_resp_h AS resp_h, id_resp_p AS resp_p, history, duration AS duration_seconds, "
            f"orig_bytes / (orig_pkts + 1) AS bytes_per_pkt FROM (SELECT {', '.join(exprs)}, {NOTE.format(newline='chr(10)')} AS history, "
            f"event_id FROM events) AS v")


def _reported(spark: SparkSession, name: str, table: DataFrame) -> DataFrame:
    return spark.read.parquet(write_report({name: table}, scratch(spark, "report"))[0])


def dns_host_hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features per source and hour of the dns log, one aggregate, as a report table."""
    return _reported(spark, "host_hour_features", host_hour_features(log_view(spark, sf_dir, "dns"), "dns"))


def conn_frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequency tables of the conn log, stacked, as a report table."""
    return _reported(spark, "frequencies", frequency_tables(log_view(spark, sf_dir, "conn"), "conn"))


def conn_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series of the conn log, one aggregate, as a report table."""
    return _reported(spark, "hourly_counts", hourly_counts_table(log_view(spark, sf_dir, "conn"), "conn"))


def _features_sql(log_type: str) -> str:
    """Each feature's own statement, joined to the (source, hour) pairs present."""
    by_key = {a.key: a for a in analytics(log_type)}
    keys = feature_keys(log_type)
    spec = specs(log_type, Hourly)
    value = lambda k: f"coalesce(f_{k}.{spec[k].name}, 0)" if spec[k].sparse else f"f_{k}.{spec[k].name}"
    joins = " ".join(f"LEFT JOIN ({by_key[k].sql}) AS f_{k} ON f_{k}.{KEY} = p.{KEY} AND f_{k}.hour = p.hour" for k in keys)
    pairs = f"SELECT DISTINCT {KEY}, date_trunc('hour', ts) AS hour FROM v WHERE {KEY} IS NOT NULL AND ts IS NOT NULL"
    return f"WITH v AS ({view_sql(log_type)}) SELECT p.{KEY}, p.hour, {', '.join(f'{value(k)} AS {k}' for k in keys)} FROM ({pairs}) AS p {joins}"


def _frequencies_sql(log_type: str) -> str:
    cols = sorted({f.col for f in specs(log_type, Frequency).values()})
    return f"WITH v AS ({view_sql(log_type)}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM v GROUP BY ALL" for c in cols)


def _hourly_sql(log_type: str) -> str:
    """The non-empty hours of each series' own statement, joined to the hours present."""
    by_key = {a.key: a for a in analytics(log_type)}
    keys = list(specs(log_type, Dense))
    joins = " ".join(f"LEFT JOIN ({by_key[k].sql}) AS f_{k} ON f_{k}.hour = p.hour" for k in keys)
    cols = ", ".join(f"coalesce(f_{k}.count, 0) AS {k}" for k in keys)
    return (f"WITH v AS ({view_sql(log_type)}) SELECT p.hour, {cols} FROM "
            f"(SELECT DISTINCT date_trunc('hour', ts) AS hour FROM v WHERE ts IS NOT NULL) AS p {joins}")


QUERIES = {"landed_conn_rows": landed_conn_rows, "exported_conn_rows": exported_conn_rows,
           "dns_host_hour_features": dns_host_hour_features, "conn_frequency_tables": conn_frequency_tables,
           "conn_hourly_counts": conn_hourly_counts}


def oracle_sql() -> dict[str, str]:
    return {"landed_conn_rows": f"WITH v AS ({view_sql('conn')}) SELECT epoch_us(ts) AS ts_us, {', '.join(LANDED)}, 'conn' AS log_type, "
                                "CAST(ts AS DATE) AS log_date FROM v",
            "exported_conn_rows": _exported_sql(), "dns_host_hour_features": _features_sql("dns"),
            "conn_frequency_tables": _frequencies_sql("conn"), "conn_hourly_counts": _hourly_sql("conn")}
