"""Projection of the fourth provider's collections. Child tables (records, bindings) carry the parent's id and, where a
parent is listed more than once, an `entry` number: only the first entry of a parent counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import canonical_address, is_database_uri, service_of_uri
from .arms import Node, first_per_key, link, there, union
from .gcp import leaf


def _first(t: DataFrame, key: str) -> DataFrame:
    """Rows of the first entry of each parent; rows that say nothing of entries are of one."""
    if "entry" not in t.columns:
        return t
    return first_per_key(t.withColumn("entry", F.coalesce("entry", F.lit(0))), key, "entry")


def accounts(zones: DataFrame) -> DataFrame:
    """Each account of the zones once: what is fetched by account is fetched once."""
    return zones.select(F.col("account.id").alias("account_id")).where("account_id IS NOT NULL").dropDuplicates()


def zones(t: DataFrame, records: DataFrame | None) -> list[DataFrame]:
    me = Node("CloudflareZone", "id")
    out = [there(t, me)]
    if records is not None:
        own = _first(records, "zone_id").withColumnRenamed("id", "record_id").withColumnRenamed("name", "host")
        rows = t.select("id").where("id IS NOT NULL").distinct().join(own, F.col("id") == F.col("zone_id"))
        address = F.col("type").isin("A", "AAAA")
        target = Node(F.when(address, "GenericIpAddress").when(F.col("type") == "CNAME", "GenericHostname"), F.when(address, canonical_address(F.col("content"))).otherwise(F.col("content")))
        host = Node("GenericHostname", "host")
        out += [link(rows, me, "Contains", Node("CloudflareDnsRecord", "record_id")), link(rows, Node("CloudflareDnsRecord", "record_id"), "RoutesTo", host), link(rows.where(F.col("type").isin("A", "AAAA", "CNAME")), host, "ResolvesTo", target)]
    return out


def workers(t: DataFrame, bindings: DataFrame | None) -> list[DataFrame]:
    me = Node("CloudflareWorker", "worker")
    t = t.select(F.col("id").alias("worker"))
    out = [there(t, me)]
    if bindings is not None:
        rows = t.where("worker IS NOT NULL").distinct().join(_first(bindings, "worker_id"), F.col("worker") == F.col("worker_id"))
        uri = F.element_at("extra", F.lit("text"))
        secret = F.col("type").isin("secret", "plain_text") & is_database_uri(uri)
        routes = [("kv_namespace", "CloudflareKvNamespace", F.col("namespace_id")), ("r2_bucket", "CloudflareR2Bucket", F.col("bucket_name")), ("durable_object_namespace", "CloudflareDurableObject", F.col("namespace_id")), ("d1", "CloudflareD1Database", F.col("id"))]
        kind, place = F.when(secret, "ExternalService"), F.when(secret, service_of_uri(uri))
        for name, node, col in routes:
            kind, place = kind.when(F.col("type") == name, node), place.when(F.col("type") == name, col)
        out.append(link(rows, me, "ConnectsTo", Node(kind, place)))
    return out


def cloudflare_facts(tables: dict[str, DataFrame]) -> DataFrame | None:
    parts: list[DataFrame] = []
    if "cf_zones" in tables:
        parts += zones(tables["cf_zones"], tables.get("cf_dns_records"))
    if "cf_workers" in tables:
        parts += workers(tables["cf_workers"], tables.get("cf_worker_bindings"))
    for name, kind, col in (("cf_kv", "CloudflareKvNamespace", "id"), ("cf_r2", "CloudflareR2Bucket", "name"), ("cf_durable_objects", "CloudflareDurableObject", "id"), ("cf_d1", "CloudflareD1Database", "uuid")):
        if name in tables:
            parts += leaf(kind, col)(tables[name])
    return union(parts) if parts else None
