"""Frequency tables, top-k, filtered counts, shape and sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def value_counts(df: DataFrame, cols: str | Sequence[str], dropna: bool = True,
                 k: int | None = None, name: str = "count", sort: bool = False) -> DataFrame:
    """A1-A4: rows per distinct value (tuple) of ``cols``.

    ``dropna`` drops rows with a NULL in any of ``cols`` (as pandas does).
    With ``k`` only the k most frequent are kept, ties broken by value
    ascending: ``orderBy + limit`` plans as TakeOrderedAndProject, so each task
    keeps k rows and no global sort happens. ``sort`` orders a full table for
    display (most frequent first); it adds a range shuffle.
    """
    cs = _cols(cols)
    d = df
    if dropna:
        cond = None
        for c in cs:
            cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
        d = d.where(cond)
    out = d.groupBy(*cs).agg(F.count(F.lit(1)).alias(name))
    order = [F.desc(name)] + [F.asc_nulls_first(c) for c in cs]
    if k is not None:
        return out.orderBy(*order).limit(k)
    return out.orderBy(*order) if sort else out


def top_k(df: DataFrame, col: str, k: int = 5, name: str = "count") -> DataFrame:
    """A4: the ``k`` most frequent non-NULL values."""
    return value_counts(df, col, dropna=True, k=k, name=name)


def count_where(df: DataFrame, pred: Column, name: str = "count") -> DataFrame:
    """A5: number of rows matching ``pred`` (one row)."""
    return df.agg(F.count_if(pred).alias(name))


def shape(df: DataFrame, with_columns: bool = False) -> DataFrame:
    """Row and column count (and the column names) as one row."""
    cols = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    if with_columns:
        cols.append(F.lit(",".join(df.columns)).alias("columns"))
    return df.agg(*cols)


def sample(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows, taken in a total order so the sample repeats run to run."""
    order = list(order) if order else list(df.columns)
    return df.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n)
