"""Scalar functions as column expressions; only the canonical form of an address needs Python (Arrow batches)."""

from __future__ import annotations

import ipaddress
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..kinds import ALLOW_LIST, PREFIXES

LARGE_BELOW = 16
DATABASE_URI = "^(postgres|postgresql|mongodb|mysql)://"


def is_large_cidr(cidr: Column) -> Column:
    """All addresses, or a prefix length below 16 after the first slash; what is no number from 0 to 255 is not large."""
    size = F.regexp_extract(cidr, r"^[^/]*/\+?([0-9]+)$", 1).try_cast("int")
    return F.coalesce(cidr.isin("0.0.0.0/0", "::/0", "*") | (size < LARGE_BELOW), F.lit(False))


def is_service_tag(destination: Column) -> Column:
    return ~F.contains(destination, F.lit(".")) & ~F.contains(destination, F.lit(":")) & (destination != "*")


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def use_resource(resource_type: Column, exclude_by_default: bool) -> Column:
    """The allow-list's word, else the default."""
    return F.coalesce(F.element_at(_map(ALLOW_LIST), resource_type), F.lit(not exclude_by_default))


def is_global(resource_type: Column) -> Column:
    return resource_type == "AWS::S3::Bucket"


def segment_after(path: Column, marker: str) -> Column:
    """What stands between the first marker and the next slash; null without the marker."""
    return F.get(F.split(F.get(F.split(path, marker, -1), F.lit(1)), "/", -1), F.lit(0))


def strip_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(https://)*(http://)*", "")


def is_database_uri(uri: Column) -> Column:
    return uri.rlike(DATABASE_URI)


def service_of_uri(uri: Column) -> Column:
    """scheme://host of a URI, without user, port and path; null if it has no host."""
    host = F.try_parse_url(uri, F.lit("HOST"))
    return F.when(host.isNotNull() & (host != ""), F.concat(F.try_parse_url(uri, F.lit("PROTOCOL")), F.lit("://"), host))


def node_label(kind: Column, id1: Column, id2: Column) -> Column:
    usual = F.concat(F.element_at(_map({k: p for k, p in PREFIXES.items() if p}), kind), F.lit("("), id1, F.lit(")"))
    return (
        F.when(kind == "AwsTag", F.concat(F.lit("AWS::Tag("), id1, F.lit("="), id2, F.lit(")")))
        .when(kind == "AwsConfigResource", F.concat(id1, F.lit("("), id2, F.lit(")")))
        .when(kind == "AwsEc2Eni", F.concat(F.lit("AWS::Ec2Eni("), id1, F.lit("-eni)")))
        .otherwise(F.coalesce(usual, F.concat(kind, F.lit("("), id1, F.lit(")"))))
    )


def node_key(kind: Column, id1: Column, id2: Column) -> Column:
    """The wire identity. Not injective: compare nodes by (kind, id1, id2)."""
    return F.concat(kind, F.lit("#"), node_label(kind, id1, id2))


def edge_key(kind: Column, source_key: Column, target_key: Column) -> Column:
    return F.concat(kind, F.lit("|"), source_key, F.lit("->"), target_key)


def provider_of(kind: Column) -> Column:
    out = F.when(kind == "ExternalService", "External")
    for prefix, name in (("Aws", "AWS"), ("Gcp", "GCP"), ("Azure", "Azure"), ("Cloudflare", "Cloudflare")):
        out = out.when(F.startswith(kind, F.lit(prefix)), name)
    return out.otherwise("Generic")


# The colours of providers and of kinds of edges.
PROVIDER_COLORS = {"AWS": "#ff9900", "GCP": "#4285f4", "Azure": "#00b7c3", "Cloudflare": "#f4442e", "External": "#b07cd8", "Generic": "#8b93a1"}
EDGE_COLORS = {"Contains": "#333b47", "AttachedTo": "#333b47", "ConnectsTo": "#54604f", "DependsOn": "#5c4f36", "HasIp": "#38585e", "RoutesTo": "#2f6285", "ResolvesTo": "#6c4a78"}
OTHER_EDGE_COLOR = "#333b47"


def provider_color(provider: Column) -> Column:
    return F.element_at(_map(PROVIDER_COLORS), provider)


def edge_color(kind: Column) -> Column:
    return F.coalesce(F.element_at(_map(EDGE_COLORS), kind), F.lit(OTHER_EDGE_COLOR))


def azure_id(rest: Column) -> Column:
    """The full id of a resource of the fixture estate."""
    return F.concat(F.lit("/subscriptions/sub-globex/resourceGroups/rg-globex/providers/"), rest)


def node_size(degree: Column) -> Column:
    return 2 + 2 * F.sqrt(degree)


@pandas_udf(StringType())
def canonical_address(text: pd.Series) -> pd.Series:
    """Addresses in their shortest standard form; what is none comes back as it is."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else str(ipaddress.ip_address(x.strip()))
        except ValueError:
            return x

    return text.map(one)
