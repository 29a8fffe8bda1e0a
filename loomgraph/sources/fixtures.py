"""Schemas of all collections, and a small estate of all four providers that exercises every kind of node."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = "array<struct<group_id:string>>"
SCHEMAS = {
    "aws_instances": f"instance_id string, vpc_id string, subnet_id string, private_ip_address string, placement struct<availability_zone:string>, tags array<struct<key:string,value:string>>, security_groups {_GROUP}, state struct<name:string>, region string",
    "aws_ecs_clusters": "cluster_arn string, region string",
    "aws_lambdas": "function_name string, role string, vpc_config struct<security_group_ids:array<string>>, region string",
    "aws_event_buses": "name string, region string",
    "aws_config_resources": "resources map<string,array<struct<resource_id:string>>>, region string",
    "aws_load_balancers": "load_balancer_arn string, vpc_id string, region string",
    "aws_target_groups": "target_group_arn string, vpc_id string, region string",
    "aws_listeners": "load_balancer_arn string, default_actions array<struct<target_group_arn:string>>, region string",
    "aws_target_health": "health map<string,array<struct<target:struct<id:string>>>>, region string",
    "aws_hosted_zones": "id string, name string, region string",
    "aws_record_sets": "name string, type string, resource_records array<struct<value:string>>, region string",
    "aws_eks": "name string, resources_vpc_config struct<vpc_id:string,security_group_ids:array<string>>, region string",
    "aws_rest_apis": "id string, region string",
    "aws_rds": "db_instance_identifier string, db_subnet_group struct<vpc_id:string>, vpc_security_groups array<struct<vpc_security_group_id:string>>, region string",
    "aws_dynamodb": "value string, region string",
    "aws_sqs": "value string, region string",
    "aws_sns": "topic_arn string, region string",
    "aws_cloudfront": "id string, region string",
    "aws_security_groups": f"group_id string, ip_permissions array<struct<user_id_group_pairs:{_GROUP}>>, ip_permissions_egress array<struct<ip_ranges:array<struct<cidr_ip:string>>,ipv6_ranges:array<struct<cidr_ipv6:string>>>>, region string",
    "aws_internet_gateways": "internet_gateway_id string, attachments array<struct<vpc_id:string>>, region string",
    "aws_nat_gateways": "nat_gateway_id string, subnet_id string, nat_gateway_addresses array<struct<allocation_id:string,public_ip:string>>, region string",
    "aws_addresses": "allocation_id string, public_ip string, region string",
    "aws_route_tables": "route_table_id string, vpc_id string, associations array<struct<subnet_id:string>>, routes array<struct<destination_cidr_block:string,gateway_id:string,nat_gateway_id:string>>, region string",
    "gcp_instances": "id string, name string, selfLink string, networkInterfaces array<struct<network:string,subnetwork:string,networkIP:string>>",
    "gcp_firewalls": "id string, name string, network string, selfLink string, sourceRanges array<string>, destinationRanges array<string>, allowed array<struct<IPProtocol:string,ports:array<string>>>, direction string, targetTags array<string>",
    "gcp_sql": "name string, selfLink string, databaseVersion string, connectionName string, ipAddresses array<struct<type:string,ipAddress:string>>",
    "gcp_dns_zones": "name string, dnsName string, id string",
    "gcp_gke": "name string, selfLink string, endpoint string, network string, subnetwork string",
    "gcp_functions": "name string, environment string, buildConfig struct<runtime:string,entryPoint:string>",
    "gcp_buckets": "id string, name string, location string, storageClass string",
    "gcp_topics": "name string",
    "gcp_subscriptions": "name string, topic string",
    "gcp_run": "name string, uid string, uri string",
    "gcp_networks": "id string, name string, selfLink string",
    "gcp_subnetworks": "id string, name string, network string, selfLink string",
    "gcp_forwarding_rules": "id string, name string, IPAddress string, target string, selfLink string",
    "azure_raw": "id string, name string, type string, location string, properties string",
    "cf_zones": "id string, name string, account struct<id:string,name:string>",
    "cf_dns_records": "zone_id string, entry int, ord int, id string, name string, type string, content string",
    "cf_workers": "id string, created_on string, modified_on string",
    "cf_worker_bindings": "worker_id string, entry int, name string, type string, namespace_id string, bucket_name string, id string, extra map<string,string>",
    "cf_kv": "id string, title string",
    "cf_r2": "name string, creation_date string",
    "cf_durable_objects": "id string, name string, class string, script string",
    "cf_d1": "uuid string, name string, version string",
}

R = "us-east-1"
VPC, SG, PUB, PRIV = "vpc-globex", [{"group_id": "sg-web"}], "subnet-public-1a", "subnet-private-1a"
_instance = lambda k, tags: {"instance_id": f"i-globex-web-0{k}", "vpc_id": VPC, "subnet_id": PUB, "private_ip_address": f"10.10.1.{9 + k}", "placement": {"availability_zone": "us-east-1a"}, "tags": tags, "security_groups": SG}
LB, TG = "app/globex/1", "globex-web/1"
_AWS = {
    "aws_instances": [_instance(1, [{"key": "env", "value": "prod"}]), _instance(2, [])],
    "aws_ecs_clusters": [{"cluster_arn": "globex-services"}],
    "aws_lambdas": [{"function_name": "globex-events-handler", "role": "globex-lambda-role", "vpc_config": {"security_group_ids": ["sg-web"]}}],
    "aws_event_buses": [{"name": "globex-bus"}],
    "aws_config_resources": [{"resources": {"AWS::S3::Bucket": [{"resource_id": "globex-assets"}], "AWS::SNS::Topic": [{"resource_id": "left-out"}]}}],
    "aws_load_balancers": [{"load_balancer_arn": LB, "vpc_id": VPC}],
    "aws_target_groups": [{"target_group_arn": TG, "vpc_id": VPC}],
    "aws_listeners": [{"load_balancer_arn": LB, "default_actions": [{"target_group_arn": TG}]}],
    "aws_target_health": [{"health": {TG: [{"target": {"id": "i-globex-web-01"}}]}}],
    "aws_hosted_zones": [{"id": "/hostedzone/ZGLOBEX", "name": "globex.io."}],
    "aws_record_sets": [{"name": "origin.globex.io.", "type": "A", "resource_records": [{"value": "203.0.113.10"}]}, {"name": "app.globex.io.", "type": "CNAME", "resource_records": [{"value": "app-globex.azurewebsites.net"}]}],
    "aws_eks": [{"name": "globex-k8s", "resources_vpc_config": {"vpc_id": VPC, "security_group_ids": ["sg-web"]}}],
    "aws_rest_apis": [{"id": "api-globex"}],
    "aws_rds": [{"db_instance_identifier": "globex-orders-db", "db_subnet_group": {"vpc_id": VPC}, "vpc_security_groups": [{"vpc_security_group_id": "sg-web"}]}],
    "aws_dynamodb": [{"value": "globex-events"}],
    "aws_sqs": [{"value": "globex-jobs"}],
    "aws_sns": [{"topic_arn": "globex-alerts"}],
    "aws_cloudfront": [{"id": "EGLOBEX1"}],
    "aws_security_groups": [{"group_id": "sg-web", "ip_permissions": [{"user_id_group_pairs": [{"group_id": "sg-lb"}]}], "ip_permissions_egress": [{"ip_ranges": [{"cidr_ip": "0.0.0.0/0"}, {"cidr_ip": "192.0.2.44/32"}], "ipv6_ranges": [{"cidr_ipv6": "::/0"}, {"cidr_ipv6": "2001:db8::44/128"}]}]}],
    "aws_internet_gateways": [{"internet_gateway_id": "igw-globex", "attachments": [{"vpc_id": VPC}]}],
    "aws_nat_gateways": [{"nat_gateway_id": "nat-globex", "subnet_id": PUB, "nat_gateway_addresses": [{"allocation_id": "eipalloc-globex", "public_ip": "203.0.113.50"}]}],
    "aws_addresses": [{"allocation_id": "eipalloc-globex", "public_ip": "203.0.113.50"}],
    "aws_route_tables": [
        {"route_table_id": "rtb-public", "vpc_id": VPC, "associations": [{"subnet_id": PUB}], "routes": [{"destination_cidr_block": "10.10.0.0/16", "gateway_id": "local"}, {"destination_cidr_block": "0.0.0.0/0", "gateway_id": "igw-globex"}]},
        {"route_table_id": "rtb-private", "vpc_id": VPC, "associations": [{"subnet_id": PRIV}], "routes": [{"destination_cidr_block": "0.0.0.0/0", "nat_gateway_id": "nat-globex"}]},
    ],
}
_LINK = "https://compute.example/v1/projects/globex-prod/zones/us-central1-a/instances/gce-worker"
_GCP = {
    "gcp_instances": [{"id": "7000000000000000001", "name": "gce-worker", "selfLink": _LINK, "networkInterfaces": [{"networkIP": "10.20.0.2"}]}],
    "gcp_firewalls": [{"id": "fw-egress-globex", "network": VPC, "direction": "EGRESS", "destinationRanges": ["192.0.2.55", "0.0.0.0/0"]}],
    "gcp_sql": [{"name": "globex-analytics-db", "ipAddresses": [{"type": "PRIVATE", "ipAddress": "10.20.0.5"}]}],
    "gcp_dns_zones": [{"name": "globex-internal"}],
    "gcp_gke": [{"name": "gke-globex", "network": VPC}],
    "gcp_functions": [{"name": "resize-images"}],
    "gcp_buckets": [{"id": "globex-datalake"}],
    "gcp_topics": [{"name": "globex-events"}],
    "gcp_subscriptions": [{"name": "globex-sink", "topic": "globex-events"}],
    "gcp_run": [{"name": "globex-api", "uri": "https://run.globex.app"}],
    "gcp_networks": [{"selfLink": VPC}],
    "gcp_subnetworks": [{"selfLink": "subnet-data", "network": VPC}],
    "gcp_forwarding_rules": [{"id": "fr-globex-lb", "IPAddress": "34.120.0.9"}],
}


def _azure(resource_type: str, name: str, **properties) -> dict:
    return {"id": name, "name": name, "type": resource_type, "location": "westeurope", "properties": json.dumps(properties)}


_NSG = {"securityRules": [{"properties": {"direction": "Outbound", "destinationAddressPrefix": "AzureCloud", "destinationAddressPrefixes": ["10.20.0.5", "10.0.0.0/8"]}}, {"properties": {"direction": "Inbound", "destinationAddressPrefix": "198.51.100.99"}}]}
_AZURE = {
    "azure_raw": [
        _azure("Microsoft.Compute/virtualMachines", "vm-worker", networkProfile={"networkInterfaces": [{"id": "nic-worker"}]}),
        _azure("Microsoft.Network/virtualNetworks", "vnet-globex", subnets=[{"id": "default", "name": "default", "properties": {"networkSecurityGroup": {"id": "nsg-worker"}}}]),
        _azure("Microsoft.Network/networkSecurityGroups", "nsg-worker", **_NSG),
        _azure("Microsoft.Network/publicIPAddresses", "pip-globex", ipAddress="198.51.100.10"),
        _azure("Microsoft.Web/sites", "app-globex", kind="app", defaultHostName="app-globex.azurewebsites.net"),
        _azure("Microsoft.Web/sites", "func-globex", kind="functionapp,linux"),
        _azure("Microsoft.Unknown/things", "left-out"),
        *(_azure(t, f"leaf-{k}") for k, t in enumerate(["microsoft.storage/storageaccounts", "microsoft.containerservice/managedclusters", "microsoft.sql/servers", "microsoft.apimanagement/service", "microsoft.documentdb/databaseaccounts", "microsoft.servicebus/namespaces", "microsoft.eventgrid/topics", "microsoft.network/dnszones", "microsoft.cdn/profiles"])),
    ]
}


def _record(name: str, kind: str, content: str) -> dict:
    return {"zone_id": "zone-globex", "id": f"rec-{name}", "name": f"{name}.globex.io", "type": kind, "content": content}


_CLOUDFLARE = {
    "cf_zones": [{"id": "zone-globex", "name": "globex.io", "account": {"id": "acc", "name": "globex"}}],
    "cf_dns_records": [_record("app", "CNAME", "app-globex.azurewebsites.net"), _record("data", "CNAME", "run.globex.app"), _record("db", "A", "198.51.100.10"), _record("v6", "AAAA", "2001:0db8:0:0:0:0:0:10")],
    "cf_workers": [{"id": "edge-router"}],
    "cf_worker_bindings": [
        {"worker_id": "edge-router", "type": "kv_namespace", "namespace_id": "kv-sessions"},
        {"worker_id": "edge-router", "type": "r2_bucket", "bucket_name": "r2-media"},
        {"worker_id": "edge-router", "type": "durable_object_namespace", "namespace_id": "do-coordinator"},
        {"worker_id": "edge-router", "type": "d1", "id": "d1-edge-cache"},
        {"worker_id": "edge-router", "type": "plain_text", "extra": {"text": "postgres://app@db.internal.globex.io:5432/orders"}},
        {"worker_id": "edge-router", "type": "plain_text", "extra": {"text": "just words"}},
    ],
    "cf_kv": [{"id": "kv-sessions", "title": "sessions"}],
    "cf_r2": [{"name": "r2-media"}],
    "cf_durable_objects": [{"id": "do-coordinator"}],
    "cf_d1": [{"uuid": "d1-edge-cache"}],
}
ESTATE = {n: [{**r, "region": R} for r in rows] for n, rows in _AWS.items()} | _GCP | _AZURE | _CLOUDFLARE


def fixture_tables(spark: SparkSession) -> dict[str, DataFrame]:
    def table(name: str) -> DataFrame:
        rows = spark.createDataFrame([(json.dumps(r),) for r in ESTATE[name]], "j string").coalesce(1)
        return rows.select(F.from_json("j", SCHEMAS[name]).alias("r")).select("r.*")

    return {name: table(name) for name in ESTATE}


def write_fixtures(folder: str) -> None:
    """The estate as a replay folder: a file of JSON lines for each collection."""
    for name, rows in ESTATE.items():
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
