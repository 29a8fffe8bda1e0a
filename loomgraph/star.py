"""The graph of the star schema: its rows as nodes, its keys as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph
from .plans.arms import Node, facts_to_graph, link, links, there, union


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(url):
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def star_facts(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders") if orders is None else orders
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    pages, events = t("pages").select("page_id", host(F.col("url")).alias("host")), t("events")
    customer, part = Node("Customer", "c_custkey"), Node("Part", "p_partkey")
    order, supplier = Node("Order", "l_orderkey"), Node("Supplier", "l_suppkey")
    return union(
        [
            link(t("nation"), Node("Region", "n_regionkey"), "Contains", Node("Nation", "n_nationkey")),
            links(t("customer"), (Node("Nation", "c_nationkey"), "Contains", customer), (customer, "DependsOn", Node("Tag", F.lit("mktsegment"), "c_mktsegment"))),
            link(t("supplier"), Node("Nation", "s_nationkey"), "Contains", Node("Supplier", "s_suppkey")),
            link(t("part"), part, "DependsOn", Node("Tag", F.lit("brand"), "p_brand")),
            link(orders, Node("Customer", "o_custkey"), "ConnectsTo", Node("Order", "o_orderkey")),
            links(lines, (order, "AttachedTo", Node("Part", "l_partkey")), (order, "RoutesTo", supplier), (supplier, "HasIp", Node("Part", "l_partkey"))),
            link(pages, Node("Page", "page_id"), "ResolvesTo", Node("Hostname", "host")),
            there(events.select(F.explode(F.array(F.struct(F.lit("User").alias("k"), F.col("user_id").cast("string").alias("v")), F.struct(F.lit("EventType").alias("k"), F.col("event_type").alias("v")))).alias("e")), Node(F.col("e.k"), "e.v")),
            there(t("region"), Node("Region", "r_regionkey")),
        ]
    )


def star_graph(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> Graph:
    return facts_to_graph(star_facts(spark, sf_dir, orders))


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """The graph of orders before 1999, and that of orders from 1998 on."""
    orders = table(spark, sf_dir, "orders")
    old, new = (star_graph(spark, sf_dir, orders.where(w)) for w in ("o_orderdate < TIMESTAMP_NTZ '1999-01-01'", "o_orderdate >= TIMESTAMP_NTZ '1998-01-01'"))
    return old.persist(), new.persist()
