"""python -m loomgraph.demo: the fixture estate's kinds of nodes and edges, and exit code 1 if one does not occur."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .kinds import EDGE_KINDS, node_kinds
from .sources import fixture_tables


def report(spark: SparkSession) -> tuple[list[str], bool]:
    """The report's lines, and whether all kinds occur."""
    graph = Engine(spark, lambda: fixture_tables(spark)).run_once().persist()
    total = graph.totals().first()
    rows = graph.coverage(node_kinds(spark)).collect()  # a row for each of the kinds
    edges = {r["kind"]: r["n"] for r in graph.edge_counts().collect()}
    lines = [f"{total['nodes']} nodes, {total['edges']} edges"]
    lines += [f"{'ok     ' if r['covered'] else 'missing'} {r['kind']} {r['n']}" for r in rows]
    lines += [f"{'ok     ' if k in edges else 'missing'} {k} {edges.get(k, 0)}" for k in sorted(EDGE_KINDS)]
    return lines, all(r["covered"] for r in rows) and set(EDGE_KINDS) <= set(edges)


if __name__ == "__main__":
    lines, whole = report(SparkSession.builder.getOrCreate())
    print("\n".join(lines))
    sys.exit(0 if whole else 1)
