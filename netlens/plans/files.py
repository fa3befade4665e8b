"""files analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import predicates as P
from ..operators import describe, sample, shape
from ..sources.views import view_columns
from . import oracle as S
from .registry import Frequency, Hourly, define, register

# MIME types that are not unusual.
COMMON_MIME_TYPES = ["text/plain", "application/pdf", "image/jpeg", "image/png", "text/html"]


@register("files_shape", "files", S.shape(8))
def files_shape(v: DataFrame) -> DataFrame:
    return shape(v)


@register("files_sample", "files", S.sample(view_columns("files")))
def files_sample(v: DataFrame) -> DataFrame:
    """Five rows in a fixed total order."""
    return sample(v, 5)


source_counts = define("files_source_counts", "files", S.value_counts("source"), Frequency("source"))


top_mime = define("files_top_mime", "files", S.value_counts("mime_type", k=5), Frequency("mime_type", k=5))


top_sources = define("files_top_sources", "files", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_dests = define("files_top_dests", "files", S.value_counts("id_resp_h", k=5), Frequency("id_resp_h", k=5))


@register("files_total_bytes_summary", "files", S.describe(["total_bytes"]))
def total_bytes_summary(v: DataFrame) -> DataFrame:
    return describe(v, ["total_bytes"])


seen_bytes_hourly = define("files_seen_bytes_hourly", "files", S.hourly("id_orig_h", "CAST(coalesce(sum(seen_bytes), 0) AS BIGINT) AS seen_bytes"),
    Hourly("sum", "seen_bytes", col="seen_bytes"),
    "Bytes seen per source per hour.")


unusual_mime_hourly = define("files_unusual_mime_hourly", "files", S.count_hourly("id_orig_h", "mime_type IS NOT NULL AND mime_type NOT IN "
                         + S.sql_list(COMMON_MIME_TYPES)),
    Hourly("count", where=lambda: P.set_and_not_in("mime_type", COMMON_MIME_TYPES)),
    "Files of an uncommon MIME type per source per hour.")


missing_ratio_hourly = define("files_missing_ratio_hourly", "files", S.hourly(
    "id_orig_h",
    "CASE WHEN coalesce(sum(total_bytes), 0) <> 0 "
    "THEN CAST(coalesce(sum(missing_bytes), 0) AS DOUBLE) / CAST(sum(total_bytes) AS DOUBLE) "
    "WHEN coalesce(sum(missing_bytes), 0) = 0 THEN 0.0 "
    "ELSE sign(sum(missing_bytes)) * CAST('inf' AS DOUBLE) END AS missing_ratio"),
    Hourly("ratio", "missing_ratio", col="missing_bytes", den="total_bytes"),
    "sum(missing_bytes) / sum(total_bytes) per source per hour (0/0 -> 0, x/0 -> inf).")
