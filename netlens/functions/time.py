"""Event-time bucketing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR = "hour"


def hour_of(ts: str | Column = "ts") -> Column:
    """Start of the tumbling 1-hour window holding ``ts``.

    ``window().start`` keeps the input type (TIMESTAMP or TIMESTAMP_NTZ), which
    ``date_trunc`` does not; it is plain arithmetic inside whole-stage codegen.
    """
    return F.window(ts, "1 hour").start
