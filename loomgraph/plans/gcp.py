"""Projection of the second provider's collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_large_cidr, segment_after, strip_scheme
from .arms import Node, link, there, union

NETWORK = Node("GcpComputeNetwork", "network")


def leaf(kind: str, col: str):
    return lambda t: [there(t, Node(kind, col))]


def pair(source: Node, edge: str, destination: Node, guard: str):
    return lambda t: [link(t.where(F.col(guard).isNotNull()), source, edge, destination)]


def instances(t: DataFrame) -> list[DataFrame]:
    me = Node("GcpComputeInstance", "id")
    nics = t.where("id IS NOT NULL").select("id", F.explode("networkInterfaces").alias("x"))
    return [
        there(t, me),
        link(t, Node("GcpProject", segment_after(F.col("selfLink"), "/projects/")), "DependsOn", me),
        link(t, Node("GcpComputeZone", segment_after(F.col("selfLink"), "/zones/")), "Contains", me),
        link(nics, Node("GcpComputeNetwork", "x.network"), "Contains", me),
    ]


def firewalls(t: DataFrame) -> list[DataFrame]:
    t = t.where("id IS NOT NULL")
    me = Node("GcpComputeFirewall", "id")
    out = t.where("direction = 'EGRESS'").select("id", F.explode("destinationRanges").alias("cidr")).where(~is_large_cidr(F.col("cidr")))
    return [link(t, NETWORK, "Contains", me), link(out, me, "RoutesTo", Node("GenericIpAddress", "cidr"))]


def sql_instances(t: DataFrame) -> list[DataFrame]:
    t = t.where("name IS NOT NULL")
    me = Node("GcpSqlInstance", "name")
    return [there(t, me), link(t.select("name", F.explode("ipAddresses").alias("x")), me, "ConnectsTo", Node("GenericIpAddress", "x.ipAddress"))]


ARMS = {
    "gcp_instances": instances,
    "gcp_firewalls": firewalls,
    "gcp_sql": sql_instances,
    "gcp_dns_zones": leaf("GcpDnsManagedZone", "name"),
    "gcp_gke": pair(NETWORK, "Contains", Node("GcpGkeCluster", "name"), "name"),
    "gcp_functions": leaf("GcpCloudFunction", "name"),
    "gcp_buckets": leaf("GcpStorageBucket", "id"),
    "gcp_topics": leaf("GcpPubSubTopic", "name"),
    "gcp_subscriptions": pair(Node("GcpPubSubSubscription", "name"), "ConnectsTo", Node("GcpPubSubTopic", "topic"), "name"),
    "gcp_run": lambda t: [link(t.where("name IS NOT NULL"), Node("GenericHostname", strip_scheme(F.col("uri"))), "RoutesTo", Node("GcpCloudRunService", "name"))],
    "gcp_networks": leaf("GcpComputeNetwork", "selfLink"),
    "gcp_subnetworks": pair(NETWORK, "Contains", Node("GcpComputeSubnetwork", "selfLink"), "selfLink"),
    "gcp_forwarding_rules": pair(Node("GcpComputeForwardingRule", "id"), "ConnectsTo", Node("GenericIpAddress", "IPAddress"), "id"),
}


def gcp_facts(tables: dict[str, DataFrame]) -> DataFrame | None:
    parts = [p for name, arm in ARMS.items() if name in tables for p in arm(tables[name])]
    return union(parts) if parts else None
