"""weird analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import predicates as P
from ..operators import sample, shape
from ..sources.views import view_columns
from . import oracle as S
from .registry import Frequency, Hourly, define, register


@register("weird_shape", "weird", S.shape(6))
def weird_shape(v: DataFrame) -> DataFrame:
    return shape(v)


@register("weird_sample", "weird", S.sample(view_columns("weird")))
def weird_sample(v: DataFrame) -> DataFrame:
    return sample(v, 5)


name_counts = define("weird_name_counts", "weird", S.value_counts("name"), Frequency("name"))


notice_counts = define("weird_notice_counts", "weird", S.value_counts("notice"), Frequency("notice"))


source_counts = define("weird_source_counts", "weird", S.value_counts("source"), Frequency("source"))


top_sources = define("weird_top_sources", "weird", S.value_counts("id_orig_h", k=5), Frequency("id_orig_h", k=5))


top_dests = define("weird_top_dests", "weird", S.value_counts("id_resp_h", k=5), Frequency("id_resp_h", k=5))


events_hourly = define("weird_events_hourly", "weird", S.count_hourly("id_orig_h"),
    Hourly("count"),
    "Weird events per source per hour.")


unique_names_hourly = define("weird_unique_names_hourly", "weird", S.hourly("id_orig_h", "count(DISTINCT name) AS unique_names"),
    Hourly("distinct", "unique_names", col="name"))


notice_ratio_hourly = define("weird_notice_ratio_hourly", "weird", S.share_hourly("id_orig_h", "notice = true", "notice_ratio"),
    Hourly("share", "notice_ratio", lambda: P.is_true("notice")),
    "Share of notice-flagged events per source per hour.")
