"""Report rounding: one rule, bit-identical in Spark, SQL and Python.

Engines round ties differently (decimal HALF_UP of the shortest repr, binary
half-even, scaled binary); means of few-decimal values hit ties often. The
report rule is built from IEEE operations only, so every engine gives the same
bits for the same input: sign(x) * floor(|x| * 10^d + 0.5) / 10^d (half away
from zero). From 2^53 / 10^d on a double has no d-th decimal and the scaled value
is no longer exact; such values are returned unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DIGITS = 6


def limit(digits: int = DIGITS) -> float:
    """Magnitude from which a double has no ``digits``-th decimal."""
    return float(2 ** 53) / float(10 ** digits)


def report_round(c: Column, digits: int = DIGITS) -> Column:
    scale = float(10 ** digits)
    rounded = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(F.abs(c) < limit(digits), rounded).otherwise(c)


def report_round_py(x: float | None, digits: int = DIGITS) -> float | None:
    if x is None or math.isnan(x) or abs(x) >= limit(digits):
        return x
    scale = float(10 ** digits)
    return math.copysign(1.0, x) * math.floor(abs(x) * scale + 0.5) / scale if x != 0 else 0.0


def report_round_sql(expr: str, digits: int = DIGITS, double: str = "") -> str:
    """``double``: suffix of double literals (``D`` in Spark, where plain ones are decimals)."""
    scale = f"{float(10 ** digits)!r}{double}"
    return (f"(CASE WHEN abs({expr}) < {limit(digits)!r}{double} THEN sign({expr}) * floor(abs({expr}) * {scale} + 0.5{double})"
            f" / {scale} ELSE {expr} END)")
