"""Places of rows in a total order, without a window over everything.

Rows are dealt to ranges of the order, sorted and numbered inside each task; the ranges' counts
are summed up (one row per range and group), and every row adds the sum before its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEED = 7


def in_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` dealt to ranges of ``order`` (column names or ordered columns) and sorted inside
    them. A random number is the last key, so that rows with equal keys, whatever their share,
    are split over ranges."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "__salt"]
    return df.withColumn("__salt", F.rand(SEED)).repartitionByRange(tasks, *keys) \
        .sortWithinPartitions(*keys).drop("__salt")


def _codes(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _number(group: list[str]):
    """mapInArrow function: adds ``part``, the task's number, and ``nth``, the row's place among
    the rows of its group in the task (rows of a group follow each other)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(b.schema.get_field_index(g)) for g in group]
            new = np.zeros(b.num_rows, bool)
            new[0] = last is not None and last != [c[0].as_py() for c in own]
            for c in own:
                new[1:] |= np.diff(_codes(c)) != 0
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            nth = np.where(start < 0, at + seen, at - start)
            last, seen = [c[b.num_rows - 1].as_py() for c in own], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(nth.astype(np.int64))],
                names=[*b.schema.names, "part", "nth"])

    return run


def ranked(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``df`` with ``rank`` (bigint, from 0): the row's place in ``order`` among the rows that are
    equal in ``group`` (nulls are one group; no column: all rows). Rows that tie share their
    places in any way. Written to the shared folder under ``name``."""
    schema = df.select("*", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("nth")).schema
    rows = stored(in_order(df, [*group, *order]).mapInArrow(_number(group), schema), name)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("before", F.sum("n").over(earlier)).where("before > 0") \
        .select(F.col("part").alias("__part"), *[F.col(g).alias(f"__{g}") for g in group], "before")
    # only the first group of a range goes on from the range before: at most a row per range
    same = F.col("part") == F.col("__part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return rows.join(F.broadcast(before), same, "left") \
        .select(*df.columns, (F.col("nth") + F.coalesce("before", F.lit(0))).cast("bigint").alias("rank"))
