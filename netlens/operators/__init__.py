from .frequency import count_where, sample, shape, top_k, value_counts
from .hourly import (count_hourly, distinct_hourly, mean_hourly, ratio_of_sums_hourly,
                     safe_ratio, share_hourly, sum_hourly)
from .summary import describe, distinct_per_key, keys_over
from .dense import crosstab, fill_hours, hourly_dense

__all__ = [
    "count_where", "sample", "shape", "top_k", "value_counts",
    "count_hourly", "distinct_hourly", "mean_hourly", "ratio_of_sums_hourly", "safe_ratio",
    "share_hourly", "sum_hourly", "describe", "distinct_per_key", "keys_over",
    "crosstab", "fill_hours", "hourly_dense",
]
