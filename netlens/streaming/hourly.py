"""The per key, per hour features over a stream of logs (Structured Streaming).

Sources: rotated Zeek files arriving in a folder (columns by position in the
configured Zeek field order: a stream cannot wait for a file's header to be
joined to its rows, but compares it with that order), or the partitioned Parquet that ``ingest.land`` writes.
The features are the batch ones (same definitions, ``plans.features``) as ONE
windowed aggregate with a watermark: counts and shares are plain / conditional
counts, distinct counts use HyperLogLog (exact distinct is not supported on
streams). Hour windows are
emitted once the watermark passes their end (append), so state stays bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas as Z
from ..session import checkpoint_dir
from ..plans.features import feature_aggregates
from ..sources.zeek import SRC, declared_columns

# Default Zeek field order of the log types (the columns a
# positional stream reader maps; trailing extra fields are ignored).
ZEEK_FIELD_ORDER: dict[str, list[str]] = {
    "conn": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
             "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
             "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"],
    "dns": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id",
            "rtt", "query", "qclass", "qclass_name", "qtype", "qtype_name", "rcode", "rcode_name",
            "AA", "TC", "RD", "RA", "Z", "answers", "TTLs", "rejected"],
    "weird": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "name", "addl",
              "notice", "peer", "source"],
}


def read_log_stream(spark: SparkSession, path: str, log_type: str,
                    fields: Sequence[str] | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of ``<log_type>*.log`` files appearing under ``path``. A file whose
    ``#fields`` line does not begin with the configured order fails the stream by name."""
    fields = list(fields or ZEEK_FIELD_ORDER[log_type])
    r = spark.readStream.option("pathGlobFilter", f"{log_type}*.log")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    keep, cols = declared_columns(log_type, fields, lambda f: Z.field_type(log_type, f))
    return r.text(path).select("value", F.col("_metadata.file_path").alias(SRC)).where(keep).select(*cols)


def read_landed_stream(spark: SparkSession, path: str, schema: T.StructType,
                       log_type: str | None = None) -> DataFrame:
    """Streaming DataFrame of new Parquet files under the landed table."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.where(F.col("log_type") == log_type) if log_type else df


def hourly_stream(df: DataFrame, key: str, metrics: Mapping[str, Column],
                  watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One windowed aggregate per (key, hour) with the given named metrics.

    A watermark needs TIMESTAMP event time: a TIMESTAMP_NTZ column is read as a
    wall-clock time of the session zone (UTC under ``get_spark``) and the hour is
    returned in the input's type."""
    ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    d = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if ntz:
        d = d.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, watermark)
    out = d.groupBy(F.col(key), F.window(ts, "1 hour")).agg(
        *[m.alias(n) for n, m in metrics.items()])
    hour = F.col("window.start")
    return out.select(key, (hour.cast("timestamp_ntz") if ntz else hour).alias("hour"), *metrics)


def features_stream(df: DataFrame, log_type: str, watermark: str = "1 hour") -> DataFrame:
    """The source-keyed hourly features of ``log_type`` on a stream: the same
    definitions as the batch feature table (``plans.features``), one column per
    analytic key, distinct counts by HyperLogLog++. Count features are 0 (not
    absent) for a (source, hour) that has rows but no match."""
    return hourly_stream(df, "id_orig_h", feature_aggregates(log_type, approx_distinct=True),
                         watermark)


def start_stream(df: DataFrame, path: str, name: str, checkpoint: str | None = None,
                 trigger: str = "1 minute", fmt: str = "parquet"):
    """Append finished hour windows to ``path``; the checkpoint defaults to
    ``<spark.checkpoint.dir>/streams/<name>`` (a shared folder on a cluster), so a
    restarted query resumes exactly once from where it stopped."""
    ckpt = checkpoint or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    return (df.writeStream.outputMode("append").format(fmt).option("path", path)
              .option("checkpointLocation", ckpt).queryName(name)
              .trigger(processingTime=trigger).start())
