"""A typed, directed multigraph as two DataFrames.

nodes: kind, id1, id2 (id2 is '' for kinds with one identity field). edges: src_kind, src_id1, src_id2, kind, dst_kind,
dst_id1, dst_id2. These columns are the identity; keys, labels and providers are derived from them when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import edge_color, edge_key, node_key, node_label, node_size, provider_color, provider_of

NODE = ["kind", "id1", "id2"]
SRC, DST = ["src_kind", "src_id1", "src_id2"], ["dst_kind", "dst_id1", "dst_id2"]
EDGE = [*SRC, "kind", *DST]
VERSION = 2


def endpoint(edges: DataFrame, side: list[str]) -> DataFrame:
    return edges.select(*(F.col(c).alias(n) for c, n in zip(side, NODE)))


def stored(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read from there; kept by the executors where no folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def dedup(self) -> Graph:
        """Each node and each edge once."""
        return Graph(self.nodes.select(*NODE).dropDuplicates(), self.edges.select(*EDGE).dropDuplicates())

    def persist(self) -> Graph:
        """Kept for several uses; what is lost is computed again."""
        return Graph(self.nodes.persist(), self.edges.persist())

    def merge(self, other: Graph) -> Graph:
        return Graph(self.nodes.select(*NODE).unionByName(other.nodes.select(*NODE)), self.edges.select(*EDGE).unionByName(other.edges.select(*EDGE))).dedup()

    def closed(self) -> Graph:
        """With every endpoint of an edge among the nodes."""
        return Graph(self.nodes.select(*NODE).unionByName(endpoint(self.edges, SRC)).unionByName(endpoint(self.edges, DST)), self.edges).dedup()

    # derived columns

    def keyed_nodes(self) -> DataFrame:
        args = [F.col(c) for c in NODE]
        return self.nodes.select(*NODE, node_key(*args).alias("key"), node_label(*args).alias("label"))

    def keyed_edges(self) -> DataFrame:
        s, d = node_key(*(F.col(c) for c in SRC)), node_key(*(F.col(c) for c in DST))
        return self.edges.select(*EDGE, edge_key(F.col("kind"), s, d).alias("key"), s.alias("source_key"), d.alias("target_key"))

    # aggregates

    def node_counts(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def edge_counts(self) -> DataFrame:
        return self.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def legend(self) -> DataFrame:
        """Nodes by provider, most first."""
        return self.nodes.groupBy(provider_of(F.col("kind")).alias("provider")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider")

    def coverage(self, kinds: DataFrame) -> DataFrame:
        """kind, n, covered for all kinds (a column kind), in the order of their names."""
        return kinds.select("kind").join(self.node_counts(), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered")).orderBy("kind")

    def missing_kinds(self, kinds: DataFrame) -> DataFrame:
        return kinds.select("kind").join(self.nodes.select("kind").distinct(), "kind", "left_anti")

    def degrees(self) -> DataFrame:
        """degree (a loop counts twice), mass and size of every node."""
        ends = endpoint(self.edges, SRC).unionByName(endpoint(self.edges, DST)).withColumn("one", F.lit(1))
        rows = ends.unionByName(self.nodes.select(*NODE, F.lit(0).alias("one")))
        degree = rows.groupBy(*NODE).agg(F.sum("one").alias("degree"))
        return degree.select(*NODE, "degree", (F.col("degree") + 1).alias("mass"), node_size(F.col("degree")).alias("size"))

    # serving

    def numbered(self) -> DataFrame:
        """Nodes with a dense id by (kind, id1, id2), without gathering the rows: ranges are counted, then numbered.

        The sorted rows are stored once, so that counts and numbers are of the same ranges.
        """
        parts = stored(self.nodes.select(*NODE).repartitionByRange(*NODE).sortWithinPartitions(*NODE).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % F.lit(1 << 33)))
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        return parts.join(F.broadcast(starts), "part").select(*NODE, (F.col("start") + F.col("place")).alias("id"))

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """nodes (id, key, label, kind) and edges (source, target, key, source_key, target_key, kind)."""
        ids = self.numbered()
        args = [F.col(c) for c in NODE]
        nodes = ids.select("id", node_key(*args).alias("key"), node_label(*args).alias("label"), "kind")
        at = lambda side, name: ids.select(*(F.col(n).alias(c) for c, n in zip(side, NODE)), F.col("id").alias(name))
        joined = self.keyed_edges().join(at(SRC, "source"), SRC).join(at(DST, "target"), DST)
        return nodes, joined.select("source", "target", "key", "source_key", "target_key", "kind")

    @classmethod
    def of_snapshot(cls, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What a client draws of a snapshot's rows: nodes by key (the last of each), with colour and size, and edges by key."""
        ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
        last = nodes.groupBy("key").agg(F.max_by(F.struct("label", "kind"), "id").alias("n")).select("key", "n.*")
        drawn = last.join(ends, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        drawn = drawn.select("key", "label", "kind", node_size(F.col("degree")).alias("size"), provider_color(provider_of(F.col("kind"))).alias("color"))
        once = edges.groupBy("key").agg(F.first("source_key").alias("source_key"), F.first("target_key").alias("target_key"), F.first("kind").alias("kind"))
        return drawn, once.withColumn("color", edge_color(F.col("kind")))

    def totals(self) -> DataFrame:
        """One row: how many nodes and edges there are."""
        n, e = self.nodes.agg(F.count(F.lit(1)).alias("nodes")), self.edges.agg(F.count(F.lit(1)).alias("edges"))
        return n.join(e)  # two tables of one row

    def _incident(self, key: str) -> tuple[DataFrame, DataFrame]:
        """The edges that leave and that reach the node with this key. Its kind is looked for first, and reaches the scan."""
        kind, s, d = key.split("#", 1)[0], node_key(*(F.col(c) for c in SRC)), node_key(*(F.col(c) for c in DST))
        return tuple(Graph(self.nodes, self.edges.where((F.col(f"{side}_kind") == kind) & (k == key))).keyed_edges() for side, k in (("src", s), ("dst", d)))

    def neighbors(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Of the node with this key: one row of the other end for each of its edges in either direction (a bag; a loop
        comes twice), and the edges themselves (as often)."""
        out, into = self._incident(key)
        far = endpoint(out, DST).unionAll(endpoint(into, SRC))
        args = [F.col(c) for c in NODE]
        return far.select(*NODE, node_key(*args).alias("key"), node_label(*args).alias("label")), out.unionAll(into).select("key", "source_key", "target_key", "kind")

    def neighborhood(self, key: str) -> tuple[DataFrame, DataFrame]:
        """What a client is told of a node: nodes (place, id, key, label, kind), the centre at place 0 and then one for each of
        its edges, and edges (source, target, key, source_key, target_key, kind). Raises KeyError if no node has the key."""
        args = [F.col(c) for c in NODE]
        ids = self.numbered()
        centre = ids.where((F.col("kind") == key.split("#", 1)[0]) & (node_key(*args) == key)).orderBy("id").limit(1)
        if centre.isEmpty():
            raise KeyError(f"no node with key {key}")
        out, into = self._incident(key)
        far = endpoint(out, DST).unionAll(endpoint(into, SRC)).join(ids, NODE).withColumn("place", F.lit(1))
        nodes = centre.withColumn("place", F.lit(0)).unionByName(far).select("place", "id", node_key(*args).alias("key"), node_label(*args).alias("label"), "kind")
        at = lambda side, name: ids.select(*(F.col(n).alias(c) for c, n in zip(side, NODE)), F.col("id").alias(name))
        edges = out.unionAll(into).join(at(SRC, "source"), SRC).join(at(DST, "target"), DST)
        return nodes, edges.select("source", "target", "key", "source_key", "target_key", "kind")

    def seams(self, kinds: tuple[str, ...] = ("GenericIpAddress", "GenericHostname")) -> DataFrame:
        """Shared nodes (of the given kinds) with the providers whose nodes touch them, where these are two or more."""
        both = self.edges.select(*(F.col(c).alias(f"p_{c[4:]}") for c in SRC), F.col("dst_kind").alias("other")).unionByName(self.edges.select(*(F.col(c).alias(f"p_{c[4:]}") for c in DST), F.col("src_kind").alias("other")))
        met = both.where(F.col("p_kind").isin(*kinds)).select("p_kind", "p_id1", provider_of(F.col("other")).alias("provider")).where("provider <> 'Generic'").distinct()
        return met.groupBy("p_kind", "p_id1").agg(F.sort_array(F.collect_list("provider")).alias("providers")).where(F.size("providers") > 1).select(F.col("p_kind").alias("kind"), F.col("p_id1").alias("id1"), "providers")
