"""http analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import predicates as P
from ..operators import count_hourly, mean_hourly, shape
from . import oracle as S
from .registry import Frequency, Hourly, define, register

# Request methods counted as suspicious, and the substrings of a
# browser-like user agent (regex alternation, case-sensitive).
SUSPICIOUS_METHODS = ["POST", "PUT", "DELETE"]
BROWSER_AGENT_PATTERNS = ["Mozilla", "Chrome", "Safari", "Firefox"]
BROWSER_AGENT_REGEX = "|".join(BROWSER_AGENT_PATTERNS)


@register("http_shape", "http", S.shape(11))
def http_shape(v: DataFrame) -> DataFrame:
    return shape(v)


method_counts = define("http_method_counts", "http", S.value_counts("method"), Frequency("method"))


status_counts = define("http_status_counts", "http", S.value_counts("status_code"), Frequency("status_code"))


top_sources = define("http_top_sources", "http", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_hosts = define("http_top_hosts", "http", S.value_counts("host", k=5), Frequency("host", k=5))


errors_hourly = define("http_errors_hourly", "http", S.count_hourly("id_orig_h", "status_code BETWEEN 400 AND 599"),
    Hourly("count", where=lambda: P.between("status_code", 400, 599)),
    "4xx / 5xx answers per source per hour.")


suspicious_methods_hourly = define("http_suspicious_methods_hourly", "http", S.count_hourly("id_orig_h", f"method IN {S.sql_list(SUSPICIOUS_METHODS)}"),
    Hourly("count", where=lambda: P.in_set("method", SUSPICIOUS_METHODS)),
    "POST / PUT / DELETE requests per source per hour.")


@register("http_avg_sizes_hourly", "http", S.hourly(
    "host", f"{S.rnd('avg(request_body_len)')} AS avg_request_body_len, "
            f"{S.rnd('avg(response_body_len)')} AS avg_response_body_len"))
def avg_sizes_hourly(v: DataFrame) -> DataFrame:
    """Mean request and response body length per host per hour."""
    return mean_hourly(v, "host", ["request_body_len", "response_body_len"], digits=S.DIGITS)


unique_uris_hourly = define("http_unique_uris_hourly", "http",
                            S.hourly("id_orig_h", "count(DISTINCT uri) AS unique_uris"),
                            Hourly("distinct", "unique_uris", col="uri"),
                            "Distinct URIs per source per hour.")


@register("http_unusual_agents_hourly", "http", S.count_hourly(
    "host", f"NOT coalesce(regexp_matches(user_agent, '{BROWSER_AGENT_REGEX}'), false)"))
def unusual_agents_hourly(v: DataFrame) -> DataFrame:
    """Requests whose user agent is missing or not browser-like, per host per hour."""
    return count_hourly(v, "host", P.not_matching("user_agent", BROWSER_AGENT_REGEX))


proxied_ratio_hourly = define("http_proxied_ratio_hourly", "http", S.share_hourly("id_orig_h", "proxied IS NOT NULL AND proxied <> ''", "proxied_ratio"),
    Hourly("share", "proxied_ratio", lambda: P.non_empty("proxied")),
    "Share of proxied requests per source per hour.")
