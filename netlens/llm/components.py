"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v bigint) -> one row (node, root) for every node that has a link; root
    is the smallest node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest
    neighbour. Neighbour lists are never gathered: the smallest neighbour is an aggregate
    with map-side combine, checkpointed and joined back to the links by plain exchanges, so a
    hub's links can be split over tasks. Rounds grow with the logarithm of the
    component's diameter; the link table never grows, and each round is checkpointed in the
    shared folder. Self-links are ignored; an empty table has no components."""
    e = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours hang on the smallest of them
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
