"""conn analytics: the full set of the richest capture day; other days use a subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from ..operators import count_where, crosstab, describe, distinct_per_key, keys_over, shape, top_k, value_counts
from . import oracle as S
from .registry import Dense, Frequency, define, register

# Fixed values (parameters of the analytics, as used by the source).
FAILED_STATES = ["S0", "RSTO"]
# The connection states that Zeek documents.
CONN_STATES = ["S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH"]
BROADCAST_ADDRS = ["255.255.255.255", "172.30.30.255"]
WATCHED_HOST = "172.30.30.250"
HEAVY_BYTES = 1e6
SHORT_SECONDS = 1.0
HIGH_BYTES_PER_PKT = 50
FANOUT_THRESHOLD = 10
DNS_PORT, HTTPS_PORT, DISCARD_PORT = 53, 443, 9

SQL_FAILED = f"conn_state IN {S.sql_list(FAILED_STATES)}"
SQL_BROADCAST = f"id_resp_h IN {S.sql_list(BROADCAST_ADDRS)}"
SQL_BPP = "orig_bytes / (orig_pkts + 1)"


def bytes_per_pkt() -> Column:
    """orig_bytes / (orig_pkts + 1); NULL when orig_bytes is."""
    return F.col("orig_bytes") / (F.col("orig_pkts") + 1)


def _short() -> Column:
    return F.col("duration") < SHORT_SECONDS


def _failed() -> Column:
    return P.in_set("conn_state", FAILED_STATES)


def _dur() -> Column:
    return F.col("duration").alias("duration_seconds")


@register("conn_columns_shape", "conn", S.shape(17, [
    "ts", "id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto", "service", "duration",
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "missed_bytes", "conn_state",
    "history", "local_orig", "local_resp"]))
def columns_shape(v: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    return shape(v, with_columns=True)


state_counts = define("conn_state_counts", "conn", S.value_counts("conn_state"), Frequency("conn_state"))


proto_counts = define("conn_proto_counts", "conn", S.value_counts("proto"), Frequency("proto"))


@register("conn_bytes_summary", "conn", S.describe(["orig_bytes", "resp_bytes"]))
def bytes_summary(v: DataFrame) -> DataFrame:
    return describe(v, ["orig_bytes", "resp_bytes"])


@register("conn_net_senders_count", "conn", S.count_where("orig_bytes > resp_bytes"))
def net_senders_count(v: DataFrame) -> DataFrame:
    """Connections that sent more than they received."""
    return count_where(v, F.col("orig_bytes") > F.col("resp_bytes"))


@register("conn_duration_summary", "conn", S.describe(["duration"]))
def duration_summary(v: DataFrame) -> DataFrame:
    return describe(v, ["duration"])


@register("conn_short_count", "conn", S.count_where("duration < 1.0"))
def short_count(v: DataFrame) -> DataFrame:
    """Connections shorter than one second."""
    return count_where(v, _short())


top_sources = define("conn_top_sources", "conn", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_dests = define("conn_top_dests", "conn", S.value_counts("id_resp_h", k=5), Frequency("id_resp_h", k=5))


top_source_ports = define("conn_top_source_ports", "conn", S.value_counts("id_orig_p", k=5), Frequency("id_orig_p", k=5))


top_dest_ports = define("conn_top_dest_ports", "conn", S.value_counts("id_resp_p", k=5), Frequency("id_resp_p", k=5))


@register("conn_fanout_summary", "conn", S.describe(
    ["n_distinct"], source="(SELECT id_orig_h, count(DISTINCT id_resp_h) AS n_distinct "
                           "FROM v WHERE id_orig_h IS NOT NULL GROUP BY id_orig_h) f"))
def fanout_summary(v: DataFrame) -> DataFrame:
    """Summary of the number of distinct destinations per source."""
    return describe(distinct_per_key(v, "id_orig_h", "id_resp_h"), ["n_distinct"])


@register("conn_fanout_over_10", "conn",
          "SELECT id_orig_h, count(DISTINCT id_resp_h) AS n_distinct FROM v "
          "WHERE id_orig_h IS NOT NULL GROUP BY id_orig_h HAVING count(DISTINCT id_resp_h) > 10")
def fanout_over_10(v: DataFrame, threshold: int = FANOUT_THRESHOLD) -> DataFrame:
    """Sources contacting more than ``threshold`` distinct destinations."""
    return keys_over(v, "id_orig_h", "id_resp_h", threshold)


service_counts = define("conn_service_counts", "conn", S.value_counts("service", dropna=False), Frequency("service", keep_null=True),
    "service frequency, the missing service included.")


top_history = define("conn_top_history", "conn", S.value_counts("history", k=5), Frequency("history", k=5))


missed_bytes_counts = define("conn_missed_bytes_counts", "conn", S.value_counts("missed_bytes"), Frequency("missed_bytes"))


@register("conn_missed_count", "conn", S.count_where("missed_bytes > 0"))
def missed_count(v: DataFrame) -> DataFrame:
    return count_where(v, F.col("missed_bytes") > 0)


@register("conn_pkts_summary", "conn", S.describe(["orig_pkts", "resp_pkts"]))
def pkts_summary(v: DataFrame) -> DataFrame:
    return describe(v, ["orig_pkts", "resp_pkts"])


@register("conn_locality_counts", "conn", S.value_counts(["local_orig", "local_resp"], dropna=False))
def locality_counts(v: DataFrame) -> DataFrame:
    """(local_orig, local_resp) frequency, missing values kept."""
    return value_counts(v, ["local_orig", "local_resp"], dropna=False)


@register("conn_heavy_senders", "conn", S.detail(
    "id_orig_h, id_resp_h, orig_bytes, resp_bytes, duration AS duration_seconds", "orig_bytes > 1e6"))
def heavy_senders(v: DataFrame, with_resp_bytes: bool = True) -> DataFrame:
    """Connections sending more than 1 MB (the short form of other days omits resp_bytes)."""
    cols = ["id_orig_h", "id_resp_h", "orig_bytes"] + (["resp_bytes"] if with_resp_bytes else [])
    return v.where(F.col("orig_bytes") > HEAVY_BYTES).select(*cols, _dur())


@register("conn_short_protos", "conn", S.value_counts("proto", where="duration < 1.0"))
def short_protos(v: DataFrame) -> DataFrame:
    return value_counts(v.where(_short()), "proto")


@register("conn_short_ports", "conn", S.value_counts("id_resp_p", k=5, where="duration < 1.0"))
def short_ports(v: DataFrame) -> DataFrame:
    return top_k(v.where(_short()), "id_resp_p", 5)


@register("conn_failed_sources", "conn", S.value_counts("id_orig_h", where=SQL_FAILED))
def failed_sources(v: DataFrame) -> DataFrame:
    """Sources of failed (S0 / RSTO) connections."""
    return value_counts(v.where(_failed()), "id_orig_h")


@register("conn_failed_ports", "conn", S.value_counts("id_resp_p", where=SQL_FAILED))
def failed_ports(v: DataFrame) -> DataFrame:
    return value_counts(v.where(_failed()), "id_resp_p")


@register("conn_failed_dests", "conn", S.value_counts("id_resp_h", where=SQL_FAILED))
def failed_dests(v: DataFrame) -> DataFrame:
    return value_counts(v.where(_failed()), "id_resp_h")


@register("conn_bytes_per_pkt_summary", "conn", S.describe(
    ["bytes_per_pkt"], source=f"(SELECT {SQL_BPP} AS bytes_per_pkt FROM v) b"))
def bytes_per_pkt_summary(v: DataFrame) -> DataFrame:
    return describe(v.select(bytes_per_pkt().alias("bytes_per_pkt")), ["bytes_per_pkt"])


@register("conn_host_detail", "conn", S.detail(
    "id_resp_h, proto, service, orig_bytes, duration AS duration_seconds, conn_state",
    f"id_orig_h = '{WATCHED_HOST}'"))
def host_detail(v: DataFrame, host: str = WATCHED_HOST) -> DataFrame:
    """All connections of one source host."""
    return (v.where(F.col("id_orig_h") == host)
             .select("id_resp_h", "proto", "service", "orig_bytes", _dur(), "conn_state"))


@register("conn_dns_states", "conn", S.value_counts("conn_state", where="id_resp_p = 53"))
def dns_states(v: DataFrame) -> DataFrame:
    return value_counts(v.where(F.col("id_resp_p") == DNS_PORT), "conn_state")


@register("conn_dns_duration_summary", "conn", S.describe(["duration"], where="id_resp_p = 53"))
def dns_duration_summary(v: DataFrame) -> DataFrame:
    return describe(v.where(F.col("id_resp_p") == DNS_PORT), ["duration"])


@register("conn_https_big_senders", "conn", S.detail(
    "id_orig_h, orig_bytes, duration AS duration_seconds", "id_resp_p = 443 AND orig_bytes > 1e6"))
def https_big_senders(v: DataFrame) -> DataFrame:
    return (v.where((F.col("id_resp_p") == HTTPS_PORT) & (F.col("orig_bytes") > HEAVY_BYTES))
             .select("id_orig_h", "orig_bytes", _dur()))


@register("conn_port9_detail", "conn", S.detail(
    "id_orig_h, proto, orig_bytes, conn_state", "id_resp_p = 9"))
def port9_detail(v: DataFrame) -> DataFrame:
    """Connections to the discard port."""
    return (v.where(F.col("id_resp_p") == DISCARD_PORT)
             .select("id_orig_h", "proto", "orig_bytes", "conn_state"))


@register("conn_broadcast_detail", "conn", S.detail(
    "id_orig_h, proto, orig_bytes, duration AS duration_seconds, conn_state", SQL_BROADCAST))
def broadcast_detail(v: DataFrame, with_state: bool = True) -> DataFrame:
    """Connections to a broadcast address (the short form omits conn_state)."""
    cols = [_dur()] + (["conn_state"] if with_state else [])
    return v.where(P.in_set("id_resp_h", BROADCAST_ADDRS)).select("id_orig_h", "proto", "orig_bytes", *cols)


def _short_non_dns() -> Column:
    return _short() & (F.col("id_resp_p") != DNS_PORT)


@register("conn_short_non_dns_detail", "conn", S.detail(
    "id_orig_h, id_resp_h, id_resp_p, proto, duration AS duration_seconds",
    "duration < 1.0 AND id_resp_p <> 53"))
def short_non_dns_detail(v: DataFrame) -> DataFrame:
    return (v.where(_short_non_dns())
             .select("id_orig_h", "id_resp_h", "id_resp_p", "proto", _dur()))


@register("conn_short_non_dns_dests", "conn",
          S.value_counts("id_resp_h", k=10, where="duration < 1.0 AND id_resp_p <> 53"))
def short_non_dns_dests(v: DataFrame, k: int = 10) -> DataFrame:
    """Top destinations of short non-DNS connections (top 10; other days use 5)."""
    return top_k(v.where(_short_non_dns()), "id_resp_h", k)


# The analytics the shorter conn days compute (the richest day computes all), and
# the parameters those days use.
SUBSET_KEYS = (
    "conn_columns_shape", "conn_state_counts", "conn_proto_counts", "conn_bytes_summary",
    "conn_net_senders_count", "conn_duration_summary", "conn_short_count", "conn_top_sources",
    "conn_top_dests", "conn_top_dest_ports", "conn_bytes_per_pkt_summary", "conn_hourly",
    "conn_heavy_senders", "conn_broadcast_detail", "conn_failed_sources",
    "conn_dns_duration_summary", "conn_short_non_dns_dests",
)
SUBSET_PARAMS = {
    "conn_heavy_senders": {"with_resp_bytes": False},
    "conn_broadcast_detail": {"with_state": False},
    "conn_short_non_dns_dests": {"k": 5},
}


@register("conn_udp_bytes_summary", "conn", S.describe(["orig_bytes", "resp_bytes"], where="proto = 'udp'"))
def udp_bytes_summary(v: DataFrame) -> DataFrame:
    return describe(v.where(F.col("proto") == "udp"), ["orig_bytes", "resp_bytes"])


@register("conn_tcp_bytes_summary", "conn", S.describe(["orig_bytes", "resp_bytes"], where="proto = 'tcp'"))
def tcp_bytes_summary(v: DataFrame) -> DataFrame:
    return describe(v.where(F.col("proto") == "tcp"), ["orig_bytes", "resp_bytes"])


@register("conn_source_state_matrix", "conn",
          "SELECT id_orig_h, " + ", ".join(f"count(*) FILTER (WHERE conn_state = '{s}') AS \"{s}\"" for s in CONN_STATES)
          + f", count(*) FILTER (WHERE conn_state NOT IN {S.sql_list(CONN_STATES)}) AS other"
          + " FROM v WHERE id_orig_h IS NOT NULL AND conn_state IS NOT NULL GROUP BY id_orig_h")
def source_state_matrix(v: DataFrame, states: Sequence[str] = CONN_STATES) -> DataFrame:
    """Per source, connections in each state (one column per state, one for all others)."""
    return crosstab(v, "id_orig_h", "conn_state", states)


@register("conn_high_bytes_per_pkt", "conn", S.detail(
    f"id_orig_h, id_resp_h, orig_bytes, orig_pkts, {SQL_BPP} AS bytes_per_pkt", f"{SQL_BPP} > 50"))
def high_bytes_per_pkt(v: DataFrame) -> DataFrame:
    bpp = bytes_per_pkt()
    return (v.where(bpp > HIGH_BYTES_PER_PKT)
             .select("id_orig_h", "id_resp_h", "orig_bytes", "orig_pkts", bpp.alias("bytes_per_pkt")))


@register("conn_tcp_downloads", "conn", S.detail(
    "id_orig_h, id_resp_h, resp_bytes, duration AS duration_seconds",
    "proto = 'tcp' AND resp_bytes > 1e6"))
def tcp_downloads(v: DataFrame) -> DataFrame:
    return (v.where((F.col("proto") == "tcp") & (F.col("resp_bytes") > HEAVY_BYTES))
             .select("id_orig_h", "id_resp_h", "resp_bytes", _dur()))


hourly = define("conn_hourly", "conn", S.hourly_dense(),
    Dense(),
    "Connections per hour, every hour from the first to the last.")


broadcast_hourly = define("conn_broadcast_hourly", "conn", S.hourly_dense(SQL_BROADCAST),
    Dense(lambda: P.in_set("id_resp_h", BROADCAST_ADDRS)))


failed_hourly = define("conn_failed_hourly", "conn", S.hourly_dense(SQL_FAILED),
    Dense(lambda: _failed()))


dns_hourly = define("conn_dns_hourly", "conn", S.hourly_dense("id_resp_p = 53"),
    Dense(lambda: F.col("id_resp_p") == DNS_PORT))


non_dns_hourly = define("conn_non_dns_hourly", "conn", S.hourly_dense("id_resp_p <> 53"),
    Dense(lambda: F.col("id_resp_p") != DNS_PORT))


@register("conn_endpoints", "conn", "SELECT id_orig_h, id_resp_h, duration FROM v")
def endpoints(v: DataFrame) -> DataFrame:
    """The three-column projection of the demo reader."""
    return v.select("id_orig_h", "id_resp_h", "duration")
