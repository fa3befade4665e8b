"""The driver tables seen as Zeek logs.

The test tables hold no network logs, so each log type is a projection of
``events`` (FIXTURES.md §3) that adds nulls and rare values on purpose. The
same select-list text runs in Spark (``selectExpr``) and in DuckDB (the oracle),
so both sides start from identical rows. A projection adds no shuffle; Catalyst
prunes the ``events`` scan to the columns a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# The view definitions of FIXTURES.md §3, in order.
VIEW_EXPRS: dict[str, list[str]] = {
    "conn": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id = 0 THEN '172.30.30.250' ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "CASE WHEN event_id % 101 = 0 THEN '255.255.255.255' WHEN event_id % 103 = 0 THEN '172.30.30.255' ELSE concat('192.168.1.', CASE WHEN user_id % 3 = 0 THEN event_id % 8 ELSE (event_id * 7) % 200 END) END AS id_resp_h",
        "CAST(1024 + event_id % 5000 AS INT) AS id_orig_p",
        "CAST(CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_type = 'error' THEN 53 WHEN event_type = 'click' THEN 443 WHEN event_type = 'view' THEN 80 WHEN event_type = 'signup' THEN 9 ELSE 445 END AS INT) AS id_resp_p",
        "CASE WHEN event_id % 3 = 0 THEN 'udp' ELSE 'tcp' END AS proto",
        "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_type = 'error' THEN 'dns' ELSE 'http' END AS service",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 40 END AS duration",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 1000 AS BIGINT) * 1500 END AS orig_bytes",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 777 AS BIGINT) * 2000 END AS resp_bytes",
        "CAST(event_id % 50 AS BIGINT) AS orig_pkts",
        "CAST(event_id % 60 AS BIGINT) AS resp_pkts",
        "CAST(CASE WHEN event_id % 50 = 0 THEN event_id % 7 ELSE 0 END AS BIGINT) AS missed_bytes",
        "CASE WHEN event_id % 5 = 0 THEN 'S0' WHEN event_id % 7 = 0 THEN 'RSTO' ELSE 'SF' END AS conn_state",
        "CASE WHEN event_id % 6 = 0 THEN 'ShADadFf' WHEN event_id % 6 < 3 THEN 'Dd' ELSE 'S' END AS history",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 2 = 0 END AS local_orig",
        "event_id % 3 = 0 AS local_resp",
    ],
    "dns": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_id % 3 = 0 THEN 'tcp' ELSE 'udp' END AS proto",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('host', event_id % 300, '.example') END AS query",
        "CAST(CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 28 WHEN event_id % 9 = 0 THEN 16 ELSE 1 END AS INT) AS qtype",
        "CAST(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'error' THEN 3 ELSE 0 END AS INT) AS rcode",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 1000 END AS rtt",
        "CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 2 = 0 END AS RD",
    ],
    "files": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_id % 3 = 0 THEN 'SSL' ELSE 'HTTP' END AS source",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_type = 'click' THEN 'text/html' WHEN event_type = 'view' THEN 'image/png' WHEN event_type = 'error' THEN 'application/x-dosexec' ELSE 'text/plain' END AS mime_type",
        "CAST(event_id % 4096 AS BIGINT) AS seen_bytes",
        "CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(event_id % 5000 AS BIGINT) END AS total_bytes",
        "CAST(CASE WHEN event_id % 12 = 0 THEN event_id % 100 ELSE 0 END AS BIGINT) AS missing_bytes",
    ],
    "http": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'signup' THEN 'PUT' WHEN event_id % 50 = 0 THEN 'DELETE' ELSE 'GET' END AS method",
        "CAST(CASE WHEN event_id % 15 = 0 THEN NULL WHEN event_type = 'error' THEN 400 + event_id % 201 ELSE 200 END AS INT) AS status_code",
        "CASE WHEN event_id % 33 = 0 THEN NULL ELSE concat('h', event_id % 40, '.example') END AS host",
        "CASE WHEN event_id % 35 = 0 THEN NULL ELSE concat('/p/', event_id % 500) END AS uri",
        "CASE WHEN event_id % 14 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'curl/8.0' WHEN event_id % 7 = 0 THEN 'mozilla-lower' ELSE 'Mozilla/5.0 Firefox' END AS user_agent",
        "CAST(event_id % 300 AS BIGINT) AS request_body_len",
        "CAST(event_id % 9000 AS BIGINT) AS response_body_len",
        "CASE WHEN event_id % 20 = 0 THEN 'VIA' WHEN event_id % 21 = 0 THEN '' ELSE NULL END AS proxied",
    ],
    "kerberos": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_id % 3 = 0 THEN 'AS' ELSE 'TGS' END AS request_type",
        "concat('user', user_id % 40) AS client",
        "CASE WHEN event_id % 28 = 0 THEN NULL ELSE concat('svc/', event_id % 60) END AS service",
        "CASE WHEN event_id % 26 = 0 THEN NULL ELSE event_type <> 'error' END AS success",
        "CASE WHEN event_id % 25 = 0 THEN 'KDC_ERR_PREAUTH_FAILED' ELSE NULL END AS error_msg",
        "CASE WHEN event_id % 24 = 0 THEN NULL ELSE event_id % 2 = 0 END AS forwardable",
    ],
    "ssl": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_id % 16 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'TLSv12' ELSE 'TLSv13' END AS version",
        "CASE WHEN event_id % 18 = 0 THEN NULL WHEN event_type = 'error' THEN 'TLS_RSA_WITH_RC4_128_SHA' WHEN event_id % 22 = 0 THEN 'TLS_RSA_WITH_DES_CBC_SHA' ELSE 'TLS_AES_128_GCM_SHA256' END AS cipher",
        "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'self signed certificate' WHEN event_id % 10 = 1 THEN 'Not OK yet' ELSE 'ok' END AS validation_status",
        "CASE WHEN event_id % 27 = 0 THEN NULL ELSE event_type <> 'error' END AS established",
    ],
    "weird": [
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', user_id) END AS id_orig_h",
        "concat('192.168.1.', event_id % 20) AS id_resp_h",
        "CASE WHEN event_id % 34 = 0 THEN NULL ELSE concat('weird_', event_type) END AS name",
        "CASE WHEN event_id % 38 = 0 THEN NULL ELSE event_id % 6 = 0 END AS notice",
        "CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE NULL END AS source",
    ],
}

LOG_TYPES = tuple(VIEW_EXPRS)


def view_columns(log_type: str) -> list[str]:
    return [e.rsplit(" AS ", 1)[-1].strip() for e in VIEW_EXPRS[log_type]]


# Declared schema of the driver's ``events`` table (TESTDATA.md). Declaring it
# skips Parquet schema inference, which runs a footer-reading job per read; a
# file that disagrees fails the scan instead of being silently re-typed.
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def log_view(spark: SparkSession, sf_dir: str, log_type: str) -> DataFrame:
    """The ``log_type`` log as a DataFrame over ``events`` in ``sf_dir``."""
    return events(spark, sf_dir).selectExpr(*VIEW_EXPRS[log_type])


def view_sql(log_type: str) -> str:
    """The same view as SQL text over a relation named ``events``."""
    return "SELECT " + ",\n  ".join(VIEW_EXPRS[log_type]) + "\nFROM events"
