"""kerberos analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from ..operators import sample, shape
from ..sources.views import view_columns
from . import oracle as S
from .registry import Frequency, Hourly, define, register


@register("kerberos_shape", "kerberos", S.shape(9))
def kerberos_shape(v: DataFrame) -> DataFrame:
    return shape(v)


@register("kerberos_sample", "kerberos", S.sample(view_columns("kerberos")))
def kerberos_sample(v: DataFrame) -> DataFrame:
    return sample(v, 5)


request_type_counts = define("kerberos_request_type_counts", "kerberos", S.value_counts("request_type"), Frequency("request_type"))


top_clients = define("kerberos_top_clients", "kerberos", S.value_counts("client", k=5), Frequency("client", k=5))


top_services = define("kerberos_top_services", "kerberos", S.value_counts("service", k=5), Frequency("service", k=5))


success_counts = define("kerberos_success_counts", "kerberos", S.value_counts("success"), Frequency("success"))


top_sources = define("kerberos_top_sources", "kerberos", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


failed_ratio_hourly = define("kerberos_failed_ratio_hourly", "kerberos", S.share_hourly(
    "id_orig_h", "success = false OR error_msg IS NOT NULL", "failed_ratio"),
    Hourly("share", "failed_ratio", lambda: P.any_of(P.is_false("success"), F.col("error_msg").isNotNull())),
    "Share of requests that failed or carry an error message, per source per hour.")


unique_services_hourly = define("kerberos_unique_services_hourly", "kerberos", S.hourly("id_orig_h", "count(DISTINCT service) AS unique_services"),
    Hourly("distinct", "unique_services", col="service"))


# One capture day lacks the forwardable feature; its report omits this key.
SUBSET_KEYS_NO_FORWARDABLE = ("kerberos_shape", "kerberos_sample", "kerberos_request_type_counts",
                              "kerberos_top_clients", "kerberos_top_services",
                              "kerberos_success_counts", "kerberos_top_sources",
                              "kerberos_failed_ratio_hourly", "kerberos_unique_services_hourly")


forwardable_hourly = define("kerberos_forwardable_hourly", "kerberos", S.count_hourly("id_orig_h", "forwardable = true"),
    Hourly("count", where=lambda: P.is_true("forwardable")),
    "Forwardable ticket requests per source per hour.")
