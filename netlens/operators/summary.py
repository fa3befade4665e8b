"""Column summaries (A6, A7) and per-key distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import report_round_sql
from .quantiles import BINS, CI, bracket_shares, column_stats, quantiles_of

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: str | Sequence[str], digits: int | None = 6, exact: bool = True,
             bins: int = BINS) -> DataFrame:
    """Count, mean, std (n-1), min, interpolated quartiles, max per column.

    One row per column (long layout); NULL and NaN are skipped. The plan is lazy: moments and
    sketches are one aggregate, whose row the exact quartiles are looked up with (see
    ``quantiles``), and no job runs until the result is used. ``exact=False`` takes the quartiles from
    the sketches (rank error at most n / 10,000)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    stats = column_stats(df, cols, bracket_shares(QUARTILES, bins) if exact else QUARTILES, bins)
    names = [c.replace("\\", "\\\\").replace("'", "\\'") for c in cols]
    rows = ", ".join(f"struct({i} AS {CI}, '{c}' AS column_name, __m{i} AS m)" for i, c in enumerate(names))
    d = stats.selectExpr(f"inline(array({rows}))")
    if exact:  # a row per column
        d = d.join(F.broadcast(quantiles_of(df, cols, stats, QUARTILES, bins)), CI, "left")
    quartiles = "quantiles" if exact else "m.sketched"
    r = (lambda c: report_round_sql(c, digits, "D")) if digits is not None else (lambda c: c)
    return d.selectExpr("column_name", "m.count AS count", *[f"{r(f'm.{x}')} AS {x}" for x in ("mean", "std", "min")],
                        *[f"{r(f'{quartiles}[{i}]')} AS {n}" for i, n in enumerate(("q25", "q50", "q75"))], f"{r('m.max')} AS max")


def distinct_per_key(df: DataFrame, key: str, col: str, name: str = "n_distinct") -> DataFrame:
    """Distinct non-NULL ``col`` values per non-NULL ``key``.

    Planned as partial aggregates on (key, col) then (key): a key holding a
    third of all rows is spread over its values before the second shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(col).alias(name))


def keys_over(df: DataFrame, key: str, col: str, threshold: int,
              name: str = "n_distinct") -> DataFrame:
    """A10 + F14: keys with more than ``threshold`` distinct ``col`` values (a table)."""
    return distinct_per_key(df, key, col, name).where(F.col(name) > threshold)
