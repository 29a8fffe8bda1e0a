"""Graphs from flat pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def from_edge_list(spark: SparkSession, nodes: int, flat: list[int]) -> tuple[DataFrame, DataFrame]:
    """nodes (id) 0..n-1 and edges (source, target); an odd number of ends or one out of bounds is an error."""
    if len(flat) % 2:
        raise ValueError("an edge list needs an even number of ends")
    if any(not 0 <= x < nodes for x in flat):
        raise ValueError("an edge's end is out of bounds")
    return spark.range(nodes), spark.createDataFrame(list(zip(flat[::2], flat[1::2])), "source bigint, target bigint")
