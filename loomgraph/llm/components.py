"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sweep


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for the nodes of edges (u, v bigint); loops and repeats do no harm.

    Each step writes a table of at most as many rows as there are edges to the shared folder. Minima are aggregated
    before the shuffle, and the joins have one side with a row per node, so that a node with very many neighbours can
    be split; nothing is gathered but a count and two checksums. The shuffle files of a step go before the next one.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _nearest(large)
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        del both, large, near, small
        sweep(now.sparkSession)
        if (new := _digest(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
