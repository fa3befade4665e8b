"""Checked entries for the raw-file side: reader, header checks, file-name classification,
landing, export.

The driver tables hold no log files, so ``events`` is written as Zeek files below the shared
checkpoint folder (two column orders, NULL and empty markers, ``#`` inside values, T / F, epoch
seconds, an empty file) and read back by the readers. The header checks take the lines of a file
per user. Everything is derived from the table by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as Z
from ..sources.ingest import classify, conformance, score
from ..sources.views import EVENTS_SCHEMA, VIEW_EXPRS
from ..session import checkpoint_dir
from ..sources.zeek import header_table, read_log

QUERY_EXPR = ("CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 17 = 0 THEN concat('#', event_id % 300, '#') "
              "WHEN event_id % 43 = 0 THEN '' ELSE concat('host', event_id % 300, '.example') END AS query")
DNS_EXPRS = [QUERY_EXPR if e.endswith(" AS query") else e for e in VIEW_EXPRS["dns"]]
RAW_DAYS = ("2025-01-09", "2025-01-10")  # even and odd ids; the second has its columns in reverse order
CHECKED_TYPES = ("dns", "files", "weird")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def _cell(c: str, kind) -> Column:
    """A typed value as Zeek writes it."""
    v = F.col(c)
    t = kind.typeName()
    if t.startswith("timestamp"):
        v = (F.unix_micros(v.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)").cast("string")
    elif t == "boolean":
        v = F.when(v, "T").when(~v, "F")
    elif t == "string":
        v = F.when(v == "", "(empty)").otherwise(v)
    else:
        v = v.cast("string")
    return F.coalesce(v, F.lit("-"))


def write_logs(rows: DataFrame, log_type: str, folder: str, reverse: bool = False) -> None:
    """``rows`` (columns of ``log_type``) as Zeek text files below ``folder``: the header lines first
    in every file, then the data."""
    files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = {Z.canonical(f): f for f in Z.FIELDS[log_type]}
    cols = [c for c in rows.columns if c in raw][::-1 if reverse else 1]
    data = rows.select(F.pmod(F.xxhash64(*cols), F.lit(files)).alias("file"), F.lit(1).alias("at"),
                       F.concat_ws("\t", *[_cell(c, rows.schema[c].dataType) for c in cols]).alias("value"))
    lines = ["#separator \\x09", f"#path\t{log_type}", "#fields\t" + "\t".join(raw[c] for c in cols)]
    head = rows.sparkSession.range(files).select(F.col("id").alias("file"), F.lit(0).alias("at"), F.lit("\n".join(lines)).alias("value"))
    head.unionByName(data).repartition(files, "file").sortWithinPartitions("at").select("value").write.text(folder)


def dns_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of log files below the shared checkpoint folder: ``events`` as dns logs of two days
    with different column orders, as weird logs of one, and an empty file."""
    root = scratch(spark, "raw-logs")
    events = _events(spark, sf_dir)
    for odd, day in enumerate(RAW_DAYS):
        write_logs(events.where(F.col("event_id") % 2 == odd).selectExpr(*DNS_EXPRS), "dns", f"{root}/{day}/dns", reverse=odd == 1)
    write_logs(events.selectExpr(*VIEW_EXPRS["weird"]), "weird", f"{root}/{RAW_DAYS[0]}/weird")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{root}/{RAW_DAYS[1]}/http")
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def raw_dns_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the dns files (S1, S2, S6, P2, U1): two layouts united by name."""
    d = read_log(spark, f"{dns_files(spark, sf_dir)}/*/dns", "dns", pattern="*.txt")
    return d.select(F.unix_micros("ts").alias("ts_us"), "id_orig_h", "id_resp_h", "proto", "query", "qtype", "rcode",
                    "rtt", "RD", "log_type", "log_date")


RAW_DNS_SQL = (
    "SELECT epoch_us(ts) AS ts_us, id_orig_h, id_resp_h, proto, query, qtype, rcode, rtt, RD, 'dns' AS log_type, "
    f"CASE WHEN event_id % 2 = 0 THEN DATE '{RAW_DAYS[0]}' ELSE DATE '{RAW_DAYS[1]}' END AS log_date "
    f"FROM (SELECT event_id, {', '.join(DNS_EXPRS)} FROM events) AS v")


def raw_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a tree, one of them empty, with types and days from their folders (S1, S5, S7):
    rows per type, day, source and DNS protocol or event name."""
    d = read_log(spark, dns_files(spark, sf_dir), None, pattern="*.txt")
    return d.groupBy("log_type", "log_date", "id_orig_h", F.coalesce("proto", "name").alias("what")) \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.unix_micros("ts")).alias("last_us"))


_ALL_TYPES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS log_type, {day} AS log_date, id_orig_h, {what} AS what, count(*) AS n_rows, max(epoch_us(ts)) AS last_us "
    f"FROM (SELECT event_id, {', '.join(exprs)} FROM events) AS v GROUP BY ALL" for t, exprs, what, day in (
        ("dns", DNS_EXPRS, "proto", f"CASE WHEN event_id % 2 = 0 THEN DATE '{RAW_DAYS[0]}' ELSE DATE '{RAW_DAYS[1]}' END"),
        ("weird", VIEW_EXPRS["weird"], "name", f"DATE '{RAW_DAYS[0]}'")))


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one file per user and log type: every fifth user's header lacks its last
    column, every seventh user's file has no header."""
    per = _events(spark, sf_dir).select("user_id", "event_id").withColumn("log_type", F.explode(F.array(*[F.lit(t) for t in CHECKED_TYPES])))
    src = F.concat(F.lit("/raw/2025-01-09/"), "log_type", F.lit("/"), "log_type", F.lit(".u"), F.col("user_id").cast("string"), F.lit(".log"))
    per = per.withColumn("src_file", src)
    head = F.lit(None).cast("string")
    for t in CHECKED_TYPES:
        full = "#fields\t" + "\t".join(Z.REQUIRED[t])
        short = "#fields\t" + "\t".join(Z.REQUIRED[t][:-1])
        head = F.when(F.col("log_type") == t, F.when(F.col("user_id") % 5 == 0, short).otherwise(full)).otherwise(head)
    heads = per.where("user_id % 7 <> 0").select("src_file", "log_type", "user_id").distinct().select(head.alias("value"), "src_file")
    data = per.select(F.concat(F.lit("1\t"), F.col("event_id").cast("string")).alias("value"), "src_file")
    return heads.unionByName(data).withColumn("file_size", F.lit(0).cast("bigint"))


def raw_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header check of every rendered file (S8), files without a header included."""
    c = conformance(header_table(checked_lines(spark, sf_dir)))
    return c.select("src_file", "log_type", F.array_join("missing", ",").alias("missing"), "ok")


def raw_schema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the rendered files that conform."""
    return score(conformance(header_table(checked_lines(spark, sf_dir))))


_REQUIRED_SQL = " ".join(f"WHEN '{t}' THEN {Z.REQUIRED[t]!r}" for t in CHECKED_TYPES)
_CONFORMANCE_SQL = (
    "SELECT src_file, log_type, CASE WHEN user_id % 7 = 0 THEN array_to_string(need, ',') WHEN user_id % 5 = 0 THEN need[-1] ELSE '' END AS missing, "
    "user_id % 7 <> 0 AND user_id % 5 <> 0 AS ok FROM (SELECT DISTINCT user_id, log_type, "
    "'/raw/2025-01-09/' || log_type || '/' || log_type || '.u' || user_id || '.log' AS src_file, "
    f"CASE log_type {_REQUIRED_SQL} END AS need FROM events, (SELECT unnest({list(CHECKED_TYPES)!r}) AS log_type) AS t) AS f")
_SCORE_SQL = f"SELECT avg(ok::INT::DOUBLE) AS score, count(*) AS n_files, count(*) FILTER (WHERE ok) AS n_ok FROM ({_CONFORMANCE_SQL}) AS c"


def raw_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages.url`` classified as file paths (S9, P8): decoded, cleaned base name, its type (text
    before the first dot) and the folder above it; every third url gets an encoded suffix."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("%3A%2f+50%zz.log. "))).otherwise(F.col("url"))
    return classify(pages.select("page_id", url.alias("path"))).select("page_id", "clean_name", "log_type", "log_date")


_NAMES_SQL = r"""
SELECT page_id, clean_name, split_part(clean_name, '.', 1) AS log_type, log_date FROM (
  SELECT page_id, regexp_replace(regexp_replace(url_decode(name), '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS clean_name, log_date FROM (
    SELECT page_id, parts[-1] AS name, CASE WHEN len(parts) > 1 THEN parts[-2] END AS log_date FROM (
      SELECT page_id, string_split(CASE WHEN page_id % 3 = 0 THEN url || '%3A%2f+50%zz.log. ' ELSE url END, '/') AS parts FROM pages) AS a) AS b) AS c"""

QUERIES = {"raw_dns_rows": raw_dns_rows, "raw_all_types": raw_all_types, "raw_conformance": raw_conformance,
           "raw_schema_score": raw_schema_score, "raw_page_names": raw_page_names}
ORACLE_SQL = {"raw_dns_rows": RAW_DNS_SQL, "raw_all_types": _ALL_TYPES_SQL, "raw_conformance": _CONFORMANCE_SQL,
              "raw_schema_score": _SCORE_SQL, "raw_page_names": _NAMES_SQL}
