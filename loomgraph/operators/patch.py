"""Differences of graphs, and their idempotent application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import DST, EDGE, NODE, SRC, Graph


@dataclass
class Patch:
    """Added and removed nodes (identity columns) and edges (identity columns)."""

    added_nodes: DataFrame
    removed_nodes: DataFrame
    added_edges: DataFrame
    removed_edges: DataFrame

    def is_empty(self) -> bool:
        return all(df.isEmpty() for df in (self.added_nodes, self.removed_nodes, self.added_edges, self.removed_edges))

    def rows(self) -> DataFrame:
        """The change log: op, entity, identity columns (those of an edge's ends; a node stands in the source columns)."""
        none = [F.lit(None).cast("string").alias(c) for c in ("edge", *DST)]
        node = lambda df, op: df.select(F.lit(op).alias("op"), F.lit("node").alias("entity"), *(F.col(n).alias(c) for n, c in zip(NODE, SRC)), *none)
        edge = lambda df, op: df.select(F.lit(op).alias("op"), F.lit("edge").alias("entity"), *SRC, F.col("kind").alias("edge"), *DST)
        return node(self.added_nodes, "add").unionByName(node(self.removed_nodes, "remove")).unionByName(edge(self.added_edges, "add")).unionByName(edge(self.removed_edges, "remove"))

    @classmethod
    def of_rows(cls, rows: DataFrame) -> Patch:
        nodes = lambda op: rows.where((F.col("entity") == "node") & (F.col("op") == op)).select(*(F.col(c).alias(n) for n, c in zip(NODE, SRC)))
        edges = lambda op: rows.where((F.col("entity") == "edge") & (F.col("op") == op)).select(*SRC, F.col("edge").alias("kind"), *DST)
        return cls(nodes("add"), nodes("remove"), edges("add"), edges("remove"))

    def summary(self) -> DataFrame:
        return self.rows().groupBy("op", "entity").agg(F.count(F.lit(1)).alias("n"))


def _sides(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One shuffle for both directions: each row with whether the old and the new graph have it."""
    tagged = old.select(*columns, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*columns, F.lit(0).alias("o"), F.lit(1).alias("n")))
    return tagged.groupBy(*columns).agg(F.max("o").alias("o"), F.max("n").alias("n"))


def diff(old: Graph, new: Graph) -> Patch:
    nodes, edges = _sides(old.nodes, new.nodes, NODE), _sides(old.edges, new.edges, EDGE)
    only = lambda df, columns, a, b: df.where((F.col(a) == 1) & (F.col(b) == 0)).select(*columns)
    return Patch(only(nodes, NODE, "n", "o"), only(nodes, NODE, "o", "n"), only(edges, EDGE, "n", "o"), only(edges, EDGE, "o", "n"))


def _end(nodes: DataFrame, side: list[str]) -> DataFrame:
    return nodes.select(*(F.col(n).alias(c) for n, c in zip(NODE, side)))


def apply_patch(graph: Graph, patch: Patch) -> Graph:
    """Edges go, nodes go with the edges that touch them, nodes come, then edges both ends of which are there.

    Applying a patch twice does what applying it once does; edges without an end are dropped.
    """
    edges = graph.edges.join(patch.removed_edges, EDGE, "left_anti")
    edges = edges.join(_end(patch.removed_nodes, SRC), SRC, "left_anti").join(_end(patch.removed_nodes, DST), DST, "left_anti")
    nodes = graph.nodes.join(patch.removed_nodes, NODE, "left_anti").select(*NODE).unionByName(patch.added_nodes.select(*NODE)).dropDuplicates()
    come = patch.added_edges.join(_end(nodes, SRC), SRC, "left_semi").join(_end(nodes, DST), DST, "left_semi")
    return Graph(nodes, edges.select(*EDGE).unionByName(come.select(*EDGE)).dropDuplicates())


def seed_positions(graph: DataFrame, added: DataFrame) -> DataFrame:
    """Positions of nodes after a patch: newcomers start at the centroid of the finite ones (or at the origin)."""
    fine = graph.where("NOT isnan(x) AND NOT isnan(y)")
    centre = fine.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("x"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("y"))
    new = added.select(*NODE).join(graph, NODE, "left_anti")
    return graph.select(*NODE, "x", "y").unionByName(new.join(F.broadcast(centre)).select(*NODE, "x", "y"))  # centre is one row
