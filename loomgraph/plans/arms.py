"""What projections are made of: facts, rows that say "this node is there" or "this edge is there".

A fact has a source node and, unless it is about a lone node, an edge kind and a destination node. All arms of all
providers are unioned and deduplicated once, so that the whole projection is one plan with one shuffle for nodes and one
for edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph

FACT = ["src_kind", "src_id1", "src_id2", "edge", "dst_kind", "dst_id1", "dst_id2"]


@dataclass
class Settings:
    regions: list[str] = field(default_factory=list)
    gcp_projects: list[str] = field(default_factory=list)
    azure_subscriptions: list[str] = field(default_factory=list)
    cloudflare: bool = False
    verbose: bool = False
    exclude_by_default: bool = False
    #: Raise if a source fails; otherwise a failed source counts as empty.
    strict_sources: bool = False


@dataclass
class Node:
    kind: str | Column
    id1: str | Column
    id2: str | Column | None = None

    def columns(self, side: str) -> list[Column]:
        kind = self.kind if isinstance(self.kind, Column) else F.lit(self.kind)
        id1 = self.id1 if isinstance(self.id1, Column) else F.col(self.id1)
        id2 = F.lit("") if self.id2 is None else self.id2 if isinstance(self.id2, Column) else F.col(self.id2)
        return [kind.alias(f"{side}_kind"), id1.cast("string").alias(f"{side}_id1"), id2.cast("string").alias(f"{side}_id2")]


def _known(side: str) -> Column:
    return F.col(f"{side}_kind").isNotNull() & F.col(f"{side}_id1").isNotNull() & F.col(f"{side}_id2").isNotNull()


def there(df: DataFrame, node: Node) -> DataFrame:
    """Lone nodes; rows without an identity say nothing."""
    none = [F.lit(None).cast("string").alias(c) for c in FACT[3:]]
    return df.select(*node.columns("src"), *none).where(_known("src"))


def _facts(rows: DataFrame) -> DataFrame:
    """One fact of each row of FACT columns: an edge if both ends have an identity, else the end that has one, alone."""
    src, dst = _known("src"), _known("dst")
    lone = [F.when(src, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(FACT[:3], FACT[4:])]
    return rows.where(src | dst).select(*lone, *(F.when(src & dst, F.col(c)).alias(c) for c in FACT[3:]))


def link(df: DataFrame, source: Node, edge: str, destination: Node) -> DataFrame:
    """Edges where both ends have an identity. An end that is there alone is a lone node."""
    return _facts(df.select(*source.columns("src"), F.lit(edge).alias("edge"), *destination.columns("dst")))


def links(df: DataFrame, *many: tuple[Node, str, Node]) -> DataFrame:
    """Several links of each row, in one pass over df."""
    rows = [F.struct(*source.columns("src"), F.lit(edge).alias("edge"), *destination.columns("dst")) for source, edge, destination in many]
    return _facts(df.select(F.explode(F.array(*rows)).alias("f")).select("f.*"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def facts_to_graph(facts: DataFrame) -> Graph:
    """Nodes are all sources and destinations, edges all facts with an edge, each once."""
    end = lambda side: F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("kind", "id1", "id2")))
    ends = F.when(F.col("edge").isNull(), F.array(end("src"))).otherwise(F.array(end("src"), end("dst")))
    nodes = facts.select(F.explode(ends).alias("n")).select("n.*")
    edges = facts.where("edge IS NOT NULL").select(*FACT[:3], F.col("edge").alias("kind"), *FACT[4:])
    return Graph(nodes, edges).dedup()


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the first entry (by order) of each key: what a linear search would find."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    return df.join(first, key).where(F.col(order) == F.col("__first")).drop("__first")
