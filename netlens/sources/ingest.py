"""Ingest: file-name classification (S9), schema conformance (S8), landing.

The source organiser moves files on a local disk into ``<date>/<type>/``
folders; here the same decisions are columns of a DataFrame of file paths, and
the landing is a partitioned Parquet write (idempotent dynamic overwrite)
rather than file moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas as Z
from .zeek import SRC, file_heads, list_files, path_part

# Characters a file name may not hold (replaced by "_"), and the
# trailing characters stripped from it.
INVALID_NAME_CHARS = '<>:"/\\|?*'
TRAILING_STRIP = ". "


def percent_decode(c: Column) -> Column:
    """Decode %XX escapes like a plain URL unquote: '+' stays '+', and a '%'
    that does not start a valid escape stays as text."""
    protected = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(protected), c)


def sanitize(c: Column) -> Column:
    cls = "[" + "".join("\\" + ch for ch in INVALID_NAME_CHARS) + "]"
    strip = "[" + "".join("\\" + ch for ch in TRAILING_STRIP) + "]+$"
    return F.regexp_replace(F.regexp_replace(c, cls, "_"), strip, "")


def classify(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``clean_name`` (decoded, sanitised base name), ``log_type`` (text before
    the first '.') and ``log_date`` (the folder above the file)."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    clean = sanitize(percent_decode(name))
    return (df.withColumn("clean_name", clean)
              .withColumn("log_type", F.substring_index(F.col("clean_name"), ".", 1))
              .withColumn("log_date", F.element_at(F.split(F.col(path_col), "/"), -2)))


def conformance(headers: DataFrame) -> DataFrame:
    """Per file of ``headers`` (src_file, fields; NULL without a header): its type (parent
    folder), the required columns it lacks, and whether it conforms."""
    req = F.create_map(*[x for t, cols in Z.REQUIRED.items()
                         for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]))])
    none = F.array().cast("array<string>")
    h = headers.withColumn("log_type", path_part(1))
    missing = F.array_except(F.coalesce(F.element_at(req, F.col("log_type")), none), F.coalesce("fields", none))
    known = F.col("log_type").isin(list(Z.REQUIRED))
    return h.select(SRC, "log_type", missing.alias("missing"),
                    (known & F.col("fields").isNotNull() & (F.size(missing) == 0)).alias("ok"))


def schema_conformance(spark: SparkSession, root: str) -> DataFrame:
    """Conformance of every ``*.log`` file under ``root``, files without a header (or without a
    line, or with two different headers) included: files are listed in tasks, as a scan leaves out
    empty ones, and joined with the headers of their leading lines."""
    headers = file_heads(spark, root).select(percent_decode(F.col(SRC)).alias("__h"), "fields")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  one spelling of local paths
    files = list_files(spark, root).select(SRC)
    return conformance(files.join(headers, plain(F.col(SRC)) == plain(F.col("__h")), "left").drop("__h"))


def schema_score(spark: SparkSession, root: str) -> DataFrame:
    """Share of all files whose header holds every column of their type (NULL for no files)."""
    return score(schema_conformance(spark, root))


def score(c: DataFrame) -> DataFrame:
    return c.agg(F.avg(F.col("ok").cast("double")).alias("score"),
                 F.count(F.lit(1)).alias("n_files"), F.count_if("ok").alias("n_ok"))


def land(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Write a read log as Parquet, one root per type: ``path/log_type=<type>/log_date=...``.

    Dynamic partition overwrite makes a re-run replace exactly the partitions
    it writes. Rows are clustered by partition inside each task (no shuffle), so
    one busy day does not funnel into one writer; inside a partition they are
    ordered by source host and time, so Parquet min/max statistics let a host
    or time filter skip row groups. (``max_records_per_file`` splits files; no row is left out.)"""
    order = ["log_type", "log_date"] + [c for c in ("id_orig_h", "ts") if c in df.columns]
    (df.sortWithinPartitions(*order)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy("log_type", "log_date").parquet(path))


def landed_schema(log_type: str) -> T.StructType:
    """Declared columns of a landed type."""
    st = Z.struct_for(log_type, list(Z.FIELDS[log_type]))
    return st.add(SRC, T.StringType()).add("log_date", T.DateType())


def read_landed(spark: SparkSession, path: str, log_type: str, dates: list[str] | None = None,
                all_columns: bool = False) -> DataFrame:
    """The landed table of one type, with the type's declared schema: what other types were
    landed beside it does not matter. ``all_columns`` also reads columns beyond the declared
    ones (the schemas of the type's files are merged). Date filters prune folders."""
    root = f"{path.rstrip('/')}/log_type={log_type}"
    reader = spark.read.option("mergeSchema", "true") if all_columns else spark.read.schema(landed_schema(log_type))
    df = reader.parquet(root).withColumn("log_type", F.lit(log_type))
    if dates:
        df = df.where(F.col("log_date").isin([F.lit(d).cast("date") for d in dates]))
    return df
