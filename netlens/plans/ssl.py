"""ssl analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import predicates as P
from ..operators import sample, shape
from ..sources.views import view_columns
from . import oracle as S
from .registry import Frequency, Hourly, define, register

# Weak / deprecated cipher suites.
WEAK_CIPHERS = ["TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_RSA_WITH_RC4_128_SHA",
                "TLS_RSA_WITH_DES_CBC_SHA"]


@register("ssl_shape", "ssl", S.shape(7))
def ssl_shape(v: DataFrame) -> DataFrame:
    return shape(v)


@register("ssl_sample", "ssl", S.sample(view_columns("ssl")))
def ssl_sample(v: DataFrame) -> DataFrame:
    return sample(v, 5)


version_counts = define("ssl_version_counts", "ssl", S.value_counts("version"), Frequency("version"))


validation_counts = define("ssl_validation_counts", "ssl", S.value_counts("validation_status"), Frequency("validation_status"))


top_ciphers = define("ssl_top_ciphers", "ssl", S.value_counts("cipher", k=5), Frequency("cipher", k=5))


top_sources = define("ssl_top_sources", "ssl", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_dests = define("ssl_top_dests", "ssl", S.value_counts("id_resp_h", k=5), Frequency("id_resp_h", k=5))


invalid_cert_ratio_hourly = define("ssl_invalid_cert_ratio_hourly", "ssl", S.share_hourly(
    "id_orig_h", "validation_status IS NOT NULL AND NOT contains(lower(validation_status), 'ok')",
    "invalid_ratio"),
    Hourly("share", "invalid_ratio", lambda: P.set_and_lacks_ci("validation_status", "ok")),
    "Share of certificates whose status lacks 'ok' (any case), per source per hour. A substring test: 'Not OK yet' counts as valid.")


weak_cipher_hourly = define("ssl_weak_cipher_hourly", "ssl", S.count_hourly("id_orig_h", f"cipher IN {S.sql_list(WEAK_CIPHERS)}"),
    Hourly("count", where=lambda: P.in_set("cipher", WEAK_CIPHERS)),
    "Handshakes on a weak cipher per source per hour.")


not_established_hourly = define("ssl_not_established_hourly", "ssl", S.count_hourly("id_orig_h", "established = false"),
    Hourly("count", where=lambda: P.is_false("established")),
    "Sessions not established per source per hour.")
