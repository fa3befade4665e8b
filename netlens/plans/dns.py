"""dns analytics: frequencies, top-k and per source / per server hourly features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions import predicates as P
from ..operators import mean_hourly, shape
from . import oracle as S
from .registry import Frequency, Hourly, define, register

# DNS query types that are not unusual (A, AAAA).
COMMON_QTYPES = [1, 28]

FAILED = Hourly("share", "failed_ratio", lambda: P.not_equal_or_null("rcode", 0))


@register("dns_shape", "dns", S.shape(9))
def dns_shape(v: DataFrame) -> DataFrame:
    """Row and column count."""
    return shape(v)


proto_counts = define("dns_proto_counts", "dns", S.value_counts("proto"), Frequency("proto"))


rcode_counts = define("dns_rcode_counts", "dns", S.value_counts("rcode"), Frequency("rcode"))


top_sources = define("dns_top_sources", "dns", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_dests = define("dns_top_dests", "dns", S.value_counts("id_resp_h", k=5), Frequency("id_resp_h", k=5))


top_queries = define("dns_top_queries", "dns", S.value_counts("query", k=5), Frequency("query", k=5))


unique_queries_hourly = define("dns_unique_queries_hourly", "dns", S.hourly("id_orig_h", "count(DISTINCT query) AS unique_queries"),
    Hourly("distinct", "unique_queries", col="query"),
    "Distinct queries per source per hour.")


@register("dns_failed_ratio_hourly", "dns",
          S.share_hourly("id_orig_h", "rcode IS DISTINCT FROM 0", "failed_ratio"), FAILED)
def failed_ratio_hourly(v: DataFrame, null_is_failed: bool = True) -> DataFrame:
    """Share of answers with rcode <> 0 per source per hour; a missing rcode counts
    as failed (the source compares a float NaN, which is never equal to 0)."""
    return (FAILED if null_is_failed else replace(FAILED, where=lambda: P.not_equal("rcode", 0))).build(v)


@register("dns_avg_rtt_hourly", "dns",
          S.hourly("id_resp_h", f"{S.rnd('coalesce(avg(rtt), 0.0)')} AS avg_rtt"))
def avg_rtt_hourly(v: DataFrame) -> DataFrame:
    """Mean round-trip time (seconds) per server per hour; no timed answer -> 0."""
    return mean_hourly(v, "id_resp_h", "rtt", fill=0.0, names=["avg_rtt"], digits=S.DIGITS)


unusual_qtype_hourly = define(
    "dns_unusual_qtype_hourly", "dns",
    S.count_hourly("id_orig_h", f"qtype IS NOT NULL AND qtype NOT IN {S.sql_list(COMMON_QTYPES)}"),
    Hourly("count", where=lambda: P.set_and_not_in("qtype", COMMON_QTYPES)),
    "Queries of a type other than A / AAAA per source per hour.")


recursive_hourly = define("dns_recursive_hourly", "dns", S.count_hourly("id_orig_h", "RD = true"),
    Hourly("count", where=lambda: P.is_true("RD")),
    "Recursion-desired queries per source per hour.")
