"""The batch engine: sources to facts to a graph to files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import VERSION, Graph
from .plans import Settings, aws_facts, azure_facts, cloudflare_facts, facts_to_graph, gcp_facts
from .plans.arms import union

Tables = dict[str, DataFrame]
EMPTY = "src_kind string, src_id1 string, src_id2 string, edge string, dst_kind string, dst_id1 string, dst_id2 string"


class Engine:
    def __init__(self, spark: SparkSession, source: Callable[[], Tables], settings: Settings | None = None):
        self.spark, self.source, self.settings = spark, source, settings or Settings()
        self.graph: Graph | None = None

    def project(self, tables: Tables) -> Graph:
        found = []
        for name, facts in (("aws", lambda t: aws_facts(t, self.settings)), ("gcp", gcp_facts), ("azure", azure_facts), ("cloudflare", cloudflare_facts)):
            try:
                some = facts(tables)
                if some is not None and not self.settings.strict_sources:
                    some = some.persist()
                    some.count()  # a plan fails when it is run, not when it is made
                found.append(some)
            except Exception as error:
                if self.settings.strict_sources:
                    raise
                print(f"the source {name} failed and counts as empty: {type(error).__name__}")
        parts = [f for f in found if f is not None]
        return facts_to_graph(union(parts) if parts else self.spark.createDataFrame([], EMPTY))

    def run_once(self) -> Graph:
        """Rebuilds the graph from a full scan."""
        self.graph = self.project(self.source())
        return self.graph

    def update(self, folder: str) -> Graph:
        """A full scan, written to folder/dot and folder/json."""
        graph = self.run_once()
        export(graph, folder)
        return graph

    def run_daemon(self, folder: str, interval: float = 60.0, scans: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
        """update() again and again, a failed one is reported and the next one tried; returns how many failed after `scans`."""
        failed = done = 0
        while scans is None or done < scans:
            try:
                self.update(folder)
            except Exception as error:
                failed += 1
                print(f"the scan failed: {type(error).__name__}: {str(error)[:200]}")
            done += 1
            if scans is None or done < scans:
                sleep(interval)
        return failed


def dot_lines(graph: Graph, snapshot: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Graphviz lines: every node by its number with its label, every edge by its ends' numbers with its kind. snapshot: that
    of the graph, if it is at hand."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    nodes, edges = snapshot or graph.snapshot()
    nodes = nodes.select(F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    edges = edges.select(F.concat(F.lit("  "), F.col("source").cast("string"), F.lit(" -> "), F.col("target").cast("string"), F.lit(" [label="), quote(F.col("kind")), F.lit("];")).alias("line"))
    return nodes.unionByName(edges)


def export(graph: Graph, folder: str) -> None:
    """The graph as Graphviz text (dot) and as snapshot rows (json: nodes and edges as JSON lines, for graphs of any size)."""
    nodes, edges = graph.snapshot()
    write_dot(graph, f"{folder}/dot", (nodes, edges))
    nodes.write.mode("overwrite").json(f"{folder}/json/nodes")
    edges.write.mode("overwrite").json(f"{folder}/json/edges")


def write_positions(placed: DataFrame, path: str) -> None:
    """id, x, y as 32-bit numbers in the order of ids."""
    placed.select("id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y")).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def write_dot(graph: Graph, path: str, snapshot: tuple[DataFrame, DataFrame] | None = None) -> None:
    """A folder of part files between a head and a tail line; put together by name they are one document."""
    spark = graph.nodes.sparkSession
    body = dot_lines(graph, snapshot).select(F.lit(1).alias("part"), "line")
    frame = spark.createDataFrame([(0, "digraph {"), (2, "}")], "part int, line string")
    frame.unionByName(body).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def snapshot_document(graph: Graph) -> DataFrame:
    """One row, one column: the snapshot as JSON text. For graphs that one document can hold."""
    nodes, edges = graph.snapshot()
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "key", "label", "kind"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "key", "source_key", "target_key", "kind"))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "nodes", "edges")).alias("value"))


def patch_document(patch) -> DataFrame:
    """One row, one column: the patch as JSON text; additions as rows, removals as keys."""
    added = Graph(patch.added_nodes, patch.added_edges)
    gone = Graph(patch.removed_nodes, patch.removed_edges)
    cols = ["key", "source_key", "target_key", "kind"]
    parts = [
        added.keyed_nodes().agg(F.sort_array(F.collect_list(F.struct("key", "label", "kind"))).alias("added_nodes")),
        gone.keyed_nodes().agg(F.sort_array(F.collect_list("key")).alias("removed_nodes")),
        added.keyed_edges().agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("added_edges")),
        gone.keyed_edges().agg(F.sort_array(F.collect_list("key")).alias("removed_edges")),
    ]
    one = parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # four tables of one row
    return one.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "added_nodes", "removed_nodes", "added_edges", "removed_edges")).alias("value"))
