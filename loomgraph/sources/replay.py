"""Batch sources: a replay folder of JSON lines, and snapshot documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import SCHEMAS

SNAPSHOT = "version int, nodes array<struct<id:bigint,key:string,label:string,kind:string,x:float,y:float>>, edges array<struct<source:bigint,target:bigint,key:string,source_key:string,target_key:string,kind:string>>"


def read_estate(spark: SparkSession, folder: str, names: list[str] | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """The collections of a folder, schemas given and unknown fields left out; a missing one fails if strict."""
    out = {}
    for name in names or list(SCHEMAS):
        try:
            out[name] = spark.read.schema(SCHEMAS[name]).json(f"{folder}/{name}.json")
        except AnalysisException:
            if strict:
                raise
    return out


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (place, id, key, label, kind, x, y) and edges (source, target as places); raises on another version and on
    edges whose ends are not there. A repeated node id counts as its last one."""
    doc = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    if not doc.where("version IS NULL OR version <> 2").isEmpty():
        raise ValueError("unsupported snapshot version")
    nodes = doc.select(F.posexplode("nodes").alias("place", "n")).select("place", "n.*")
    last = nodes.groupBy("id").agg(F.max("place").alias("place"))
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    ends = edges.join(last.select(F.col("id").alias("source"), F.col("place").alias("s")), "source", "left").join(last.select(F.col("id").alias("target"), F.col("place").alias("t")), "target", "left")
    if not ends.where("s IS NULL OR t IS NULL").isEmpty():
        raise ValueError("an edge names an unknown node id")
    return nodes, ends.select(F.col("s").alias("source"), F.col("t").alias("target"), "key", "kind")
