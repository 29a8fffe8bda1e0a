"""Decoding and projection of the third provider's collections.

Raw rows of the resource graph (id, name, type, location, properties as JSON text) are routed by type; properties are
parsed once per route with an explicit schema, and what does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_large_cidr, is_service_tag
from .arms import Node, link, there, union
from .gcp import leaf, pair

NSG_PROPERTIES = "securityRules array<struct<properties:struct<direction:string,destinationAddressPrefix:string,destinationAddressPrefixes:array<string>>>>"
#: leaf collections by resource type
LEAVES = {
    "microsoft.storage/storageaccounts": ("azure_storage", "AzureStorageAccount"),
    "microsoft.containerservice/managedclusters": ("azure_aks", "AzureManagedCluster"),
    "microsoft.sql/servers": ("azure_sql", "AzureSqlServer"),
    "microsoft.apimanagement/service": ("azure_apim", "AzureApiManagement"),
    "microsoft.documentdb/databaseaccounts": ("azure_cosmos", "AzureCosmosDb"),
    "microsoft.servicebus/namespaces": ("azure_service_bus", "AzureServiceBus"),
    "microsoft.eventgrid/topics": ("azure_event_grid", "AzureEventGridTopic"),
    "microsoft.network/dnszones": ("azure_dns", "AzureDnsZone"),
    "microsoft.cdn/profiles": ("azure_cdn", "AzureCdnProfile"),
}


def map_resources(raw: DataFrame) -> dict[str, DataFrame]:
    """The collections of raw rows by name; rows of other types are left out."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    of = lambda t: raw.where(kind == t)
    props = lambda schema: F.from_json("properties", schema)
    base = ["id", "name", "location"]
    nics = "struct<networkInterfaces:array<struct<id:string>>>"
    vms = of("microsoft.compute/virtualmachines").select(*base, props(f"networkProfile {nics}").alias("p"))
    nets = of("microsoft.network/virtualnetworks").select(*base, props("subnets array<struct<id:string,name:string,properties:struct<networkSecurityGroup:struct<id:string>>>>").alias("p"))
    present = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    hoisted = nets.select(F.col("id").alias("vnet_id"), F.explode("p.subnets").alias("s"))
    sites = of("microsoft.web/sites").select(*base, props("kind string, defaultHostName string").alias("properties"))
    function = F.coalesce(F.contains("properties.kind", F.lit("functionapp")), F.lit(False))
    out = {
        "azure_vms": vms.select(*base, present(F.col("p.networkProfile.networkInterfaces.id")).alias("network_interfaces")),
        "azure_vnets": nets.select(*base, present(F.col("p.subnets.id")).alias("subnets")),
        "azure_subnets": hoisted.select("s.id", "s.name", "vnet_id", F.col("s.properties.networkSecurityGroup.id").alias("network_security_group_id")),
        "azure_nsgs": of("microsoft.network/networksecuritygroups").select(*base, props(NSG_PROPERTIES).alias("properties")),
        "azure_public_ips": of("microsoft.network/publicipaddresses").select("id", "name", F.get_json_object("properties", "$.ipAddress").alias("ip_address")),
        "azure_app_services": sites.where(~function),
        "azure_function_apps": sites.where(function).select(*base),
    }
    return out | {name: of(t).select(*base) for t, (name, _) in LEAVES.items()}


def virtual_machines(t: DataFrame) -> list[DataFrame]:
    t = t.where("id IS NOT NULL")
    me = Node("AzureVirtualMachine", "id")
    return [there(t, me), link(t.select("id", F.explode("network_interfaces").alias("x")), me, "ConnectsTo", Node("AzureNetworkInterface", "x"))]


def virtual_networks(t: DataFrame) -> list[DataFrame]:
    t = t.where("id IS NOT NULL")
    me = Node("AzureVirtualNetwork", "id")
    return [there(t, me), link(t.select("id", F.explode("subnets").alias("x")), me, "Contains", Node("AzureSubnet", "x"))]


def subnets(t: DataFrame) -> list[DataFrame]:
    t = t.where("id IS NOT NULL")
    me = Node("AzureSubnet", "id")
    return [link(t, Node("AzureVirtualNetwork", "vnet_id"), "Contains", me), link(t, me, "ConnectsTo", Node("AzureNetworkSecurityGroup", "network_security_group_id"))]


def security_groups(t: DataFrame) -> list[DataFrame]:
    t = t.where("id IS NOT NULL")
    me = Node("AzureNetworkSecurityGroup", "id")
    rules = t.select("id", F.explode("properties.securityRules").alias("r")).select("id", "r.properties.*").where(F.lower("direction") == "outbound")
    single = F.filter(F.array("destinationAddressPrefix"), lambda x: x.isNotNull())
    many = F.coalesce("destinationAddressPrefixes", F.array().cast("array<string>"))
    each = rules.select("id", F.explode(F.concat(single, many)).alias("to")).where("to IS NOT NULL")
    tag = is_service_tag(F.col("to"))
    kept = each.where(tag | ~is_large_cidr(F.col("to")))
    return [there(t, me), link(kept, me, "RoutesTo", Node(F.when(tag, "AzureServiceTag").otherwise("GenericIpAddress"), "to"))]


ARMS = {
    "azure_vms": virtual_machines,
    "azure_vnets": virtual_networks,
    "azure_subnets": subnets,
    "azure_nsgs": security_groups,
    "azure_public_ips": pair(Node("AzurePublicIpAddress", "id"), "ConnectsTo", Node("GenericIpAddress", "ip_address"), "id"),
    "azure_app_services": pair(Node("GenericHostname", "properties.defaultHostName"), "RoutesTo", Node("AzureAppService", "id"), "id"),
    "azure_function_apps": leaf("AzureFunctionApp", "id"),
} | {name: leaf(kind, "id") for name, kind in LEAVES.values()}


def azure_facts(tables: dict[str, DataFrame]) -> DataFrame | None:
    if "azure_raw" in tables:
        tables = tables | map_resources(tables["azure_raw"])
    parts = [p for name, arm in ARMS.items() if name in tables for p in arm(tables[name])]
    return union(parts) if parts else None
