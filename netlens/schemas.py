"""Declared column types per Zeek log type (FIXTURES.md §1).

Raw Zeek names are dotted (``id.orig_h``); Spark would read an unquoted dot as
a struct access, so canonical names replace ``.`` with ``_``. Columns a file
carries beyond these are kept as STRING.
"""

from __future__ import annotations

from pyspark.sql import types as T

TS, STR, INT, LONG, DBL, BOOL = "timestamp", "string", "int", "bigint", "double", "boolean"

COMMON = {"ts": TS, "uid": STR, "id.orig_h": STR, "id.orig_p": INT, "id.resp_h": STR,
          "id.resp_p": INT}

# The columns the analytics read, by log type, with their types.
FIELDS: dict[str, dict[str, str]] = {
    "conn": {**COMMON, "proto": STR, "service": STR, "duration": DBL, "orig_bytes": LONG,
             "resp_bytes": LONG, "conn_state": STR, "local_orig": BOOL, "local_resp": BOOL,
             "missed_bytes": LONG, "history": STR, "orig_pkts": LONG, "orig_ip_bytes": LONG,
             "resp_pkts": LONG, "resp_ip_bytes": LONG},
    "dns": {**COMMON, "proto": STR, "trans_id": LONG, "rtt": DBL, "query": STR, "qclass": INT,
            "qtype": INT, "rcode": INT, "AA": BOOL, "TC": BOOL, "RD": BOOL, "RA": BOOL,
            "Z": INT, "rejected": BOOL},
    "files": {**COMMON, "fuid": STR, "source": STR, "depth": INT, "mime_type": STR,
              "filename": STR, "duration": DBL, "local_orig": BOOL, "is_orig": BOOL,
              "seen_bytes": LONG, "total_bytes": LONG, "missing_bytes": LONG,
              "overflow_bytes": LONG, "timedout": BOOL},
    "http": {**COMMON, "trans_depth": INT, "method": STR, "host": STR, "uri": STR,
             "referrer": STR, "version": STR, "user_agent": STR, "origin": STR,
             "request_body_len": LONG, "response_body_len": LONG, "status_code": INT,
             "status_msg": STR, "proxied": STR},
    "kerberos": {**COMMON, "request_type": STR, "client": STR, "service": STR, "success": BOOL,
                 "error_msg": STR, "till": TS, "cipher": STR, "forwardable": BOOL,
                 "renewable": BOOL},
    "ssl": {**COMMON, "version": STR, "cipher": STR, "curve": STR, "server_name": STR,
            "resumed": BOOL, "established": BOOL, "validation_status": STR},
    "weird": {**COMMON, "name": STR, "addl": STR, "notice": BOOL, "peer": STR, "source": STR},
}

# Columns a file must carry to pass the schema check (S8): those the analytics use.
REQUIRED: dict[str, list[str]] = {
    "conn": ["ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "service",
             "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "missed_bytes",
             "conn_state", "history", "local_orig", "local_resp"],
    "dns": ["ts", "id.orig_h", "id.resp_h", "proto", "query", "qtype", "rcode", "rtt", "RD"],
    "files": ["ts", "id.orig_h", "id.resp_h", "source", "mime_type", "seen_bytes",
              "total_bytes", "missing_bytes"],
    "http": ["ts", "id.orig_h", "id.resp_h", "method", "status_code", "host", "uri",
             "user_agent", "request_body_len", "response_body_len", "proxied"],
    "kerberos": ["ts", "id.orig_h", "id.resp_h", "request_type", "client", "service",
                 "success", "error_msg", "forwardable"],
    "ssl": ["ts", "id.orig_h", "id.resp_h", "version", "cipher", "validation_status",
            "established"],
    "weird": ["ts", "id.orig_h", "id.resp_h", "name", "notice", "source"],
}

_SPARK = {TS: T.TimestampType(), STR: T.StringType(), INT: T.IntegerType(),
          LONG: T.LongType(), DBL: T.DoubleType(), BOOL: T.BooleanType()}


def canonical(raw: str) -> str:
    return raw.replace(".", "_")


def field_type(log_type: str | None, raw: str) -> str:
    return (FIELDS.get(log_type or "", {}).get(raw)) or COMMON.get(raw) or STR


def struct_for(log_type: str, raw_fields: list[str] | None = None) -> T.StructType:
    """Spark schema (canonical names) for the given raw fields (default: REQUIRED)."""
    raw_fields = raw_fields or REQUIRED[log_type]
    return T.StructType([T.StructField(canonical(f), _SPARK[field_type(log_type, f)])
                         for f in raw_fields])
