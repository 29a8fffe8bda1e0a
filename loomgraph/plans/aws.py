"""Projection of the first provider's collections. Tables have a region column; a table that is missing is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_global, is_large_cidr, use_resource
from .arms import Node, Settings, link, there, union

REGION = Node("AwsRegion", "region")


def _global() -> Node:
    return Node("AwsRegion", F.lit("global"))


def _global_node(t: DataFrame) -> DataFrame:
    """The global region is there even if the collection is empty."""
    return there(t.sparkSession.range(1), _global())


def _sg(col) -> Node:
    return Node("AwsEc2SecurityGroup", col)


def _vpc_or_region(df: DataFrame, vpc: str) -> Node:
    has = F.col(vpc).isNotNull()
    return Node(F.when(has, "AwsEc2Vpc").otherwise("AwsRegion"), F.coalesce(F.col(vpc), F.col("region")))


def instances(t: DataFrame, settings: Settings) -> list[DataFrame]:
    me = Node("AwsEc2Instance", "instance_id")
    if "state" in t.columns:  # the scan's filter: instances that run or are about to; rows that do not say count as such
        t = t.where(F.col("state.name").isNull() | F.col("state.name").isin("running", "pending"))
    full = t.where("instance_id IS NOT NULL AND subnet_id IS NOT NULL")
    tags = t.select("instance_id", F.explode("tags").alias("x")).where("x.key IS NOT NULL AND x.value IS NOT NULL")
    groups = t.select("instance_id", F.explode("security_groups").alias("x"))
    return [
        there(t, me),
        link(t, REGION, "Contains", Node("AwsEc2Vpc", "vpc_id")),
        link(t, Node("AwsEc2Vpc", "vpc_id"), "Contains", Node("AwsEc2Subnet", "subnet_id")),
        link(full, me, "HasIp", Node("AwsEc2Eni", "instance_id")),
        link(full, Node("AwsEc2Eni", "instance_id"), "AttachedTo", Node("AwsEc2Subnet", "subnet_id")),
        link(t, Node("AwsEc2AvailabilityZone", "placement.availability_zone"), "Contains", me),
        link(t, me, "ConnectsTo", Node("GenericIpAddress", "private_ip_address")),
        link(tags, me, "DependsOn", Node("AwsTag", "x.key", "x.value")),
        link(groups, me, "ConnectsTo", _sg("x.group_id")),
    ]


def config_resources(t: DataFrame, settings: Settings) -> list[DataFrame]:
    types = t.select("region", F.explode("resources").alias("type", "list")).where(use_resource(F.col("type"), settings.exclude_by_default))
    each = types.select("region", "type", F.explode("list").alias("x")).where("x.resource_id IS NOT NULL")
    where = Node("AwsRegion", F.when(is_global(F.col("type")), "global").otherwise(F.col("region")))
    return [link(each, where, "Contains", Node("AwsConfigResource", "type", "x.resource_id"))]


def _contained(kind: str, col: str):
    def arm(t: DataFrame, settings: Settings) -> list[DataFrame]:
        return [link(t.where(F.col(col).isNotNull()), REGION, "Contains", Node(kind, col))]

    return arm


def lambdas(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("function_name IS NOT NULL")
    me = Node("AwsLambdaFunction", "function_name")
    groups = t.select("function_name", F.explode("vpc_config.security_group_ids").alias("x"))
    return [link(t, REGION, "Contains", me), link(t, me, "DependsOn", Node("AwsIamRole", "role")), link(groups, me, "ConnectsTo", _sg("x"))]


def load_balancers(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("load_balancer_arn IS NOT NULL")
    return [link(t, _vpc_or_region(t, "vpc_id"), "Contains", Node("AwsElbLoadBalancer", "load_balancer_arn"))]


def target_groups(t: DataFrame, settings: Settings, health: DataFrame | None = None) -> list[DataFrame]:
    t = t.where("target_group_arn IS NOT NULL")
    me = Node("AwsElbTargetGroup", "target_group_arn")
    out = [link(t, Node("AwsEc2Vpc", "vpc_id"), "Contains", me)]
    if health is not None:
        found = health.select(F.explode("health").alias("target_group_arn", "list"))
        targets = t.select("target_group_arn").join(found, "target_group_arn").select("target_group_arn", F.explode("list").alias("x"))
        out.append(link(targets, me, "ConnectsTo", Node("AwsEc2Instance", "x.target.id")))
    return out


def listeners(t: DataFrame, settings: Settings) -> list[DataFrame]:
    each = t.where("load_balancer_arn IS NOT NULL").select("load_balancer_arn", F.explode("default_actions").alias("x")).where("x.target_group_arn IS NOT NULL")
    return [link(each, Node("AwsElbLoadBalancer", "load_balancer_arn"), "ConnectsTo", Node("AwsElbTargetGroup", "x.target_group_arn"))]


def hosted_zones(t: DataFrame, settings: Settings) -> list[DataFrame]:
    return [_global_node(t), link(t.where("id IS NOT NULL"), _global(), "Contains", Node("AwsRoute53HostedZone", "id"))]


def record_sets(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("name IS NOT NULL")
    me = Node("AwsRoute53RecordSet", "name")
    values = t.select("name", "type", F.explode("resource_records").alias("x"))
    kind = F.when(F.col("type").isin("A", "AAAA"), "GenericIpAddress").otherwise("GenericHostname")
    return [link(t, _global(), "Contains", me), link(values, me, "ConnectsTo", Node(kind, "x.value"))]


def eks(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("name IS NOT NULL").withColumn("vpc", F.col("resources_vpc_config.vpc_id"))
    me = Node("AwsEksCluster", "name")
    groups = t.select("name", F.explode("resources_vpc_config.security_group_ids").alias("x"))
    return [link(t, _vpc_or_region(t, "vpc"), "Contains", me), link(groups, me, "ConnectsTo", _sg("x"))]


def rds(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("db_instance_identifier IS NOT NULL").withColumn("vpc", F.col("db_subnet_group.vpc_id"))
    me = Node("AwsRdsDbInstance", "db_instance_identifier")
    groups = t.select("db_instance_identifier", F.explode("vpc_security_groups").alias("x"))
    return [link(t, _vpc_or_region(t, "vpc"), "Contains", me), link(groups, me, "ConnectsTo", _sg("x.vpc_security_group_id"))]


def cloudfront(t: DataFrame, settings: Settings) -> list[DataFrame]:
    return [_global_node(t), link(t.where("id IS NOT NULL"), _global(), "Contains", Node("AwsCloudFrontDistribution", "id"))]


def _eip(t: DataFrame, prefix: str = "") -> Node:
    return Node("AwsEc2Eip", F.coalesce(F.col(f"{prefix}allocation_id"), F.col(f"{prefix}public_ip")))


def addresses(t: DataFrame, settings: Settings) -> list[DataFrame]:
    return [link(t.where("allocation_id IS NOT NULL OR public_ip IS NOT NULL"), _eip(t), "ConnectsTo", Node("GenericIpAddress", "public_ip"))]


def internet_gateways(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("internet_gateway_id IS NOT NULL")
    me = Node("AwsEc2InternetGateway", "internet_gateway_id")
    return [there(t, me), link(t.select("internet_gateway_id", F.explode("attachments").alias("x")), me, "AttachedTo", Node("AwsEc2Vpc", "x.vpc_id"))]


def nat_gateways(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("nat_gateway_id IS NOT NULL")
    me = Node("AwsEc2NatGateway", "nat_gateway_id")
    each = t.select("nat_gateway_id", F.explode("nat_gateway_addresses").alias("x"))
    return [link(t, me, "AttachedTo", Node("AwsEc2Subnet", "subnet_id")), link(each, me, "HasIp", _eip(each, "x."))]


def route_tables(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("route_table_id IS NOT NULL")
    me = Node("AwsEc2RouteTable", "route_table_id")
    subnets = t.select("route_table_id", F.explode("associations").alias("x")).where("x.subnet_id IS NOT NULL")
    routes = t.select("route_table_id", F.explode("routes").alias("x"))
    nat, gate = F.col("x.nat_gateway_id"), F.col("x.gateway_id")
    to_gate = nat.isNull() & F.startswith(gate, F.lit("igw-"))
    via = Node(F.when(nat.isNotNull(), "AwsEc2NatGateway").when(to_gate, "AwsEc2InternetGateway"), F.when(nat.isNotNull(), nat).when(to_gate, gate))
    return [link(t, Node("AwsEc2Vpc", "vpc_id"), "Contains", me), link(subnets, Node("AwsEc2Subnet", "x.subnet_id"), "AttachedTo", me), link(routes, me, "RoutesTo", via)]


def security_groups(t: DataFrame, settings: Settings) -> list[DataFrame]:
    t = t.where("group_id IS NOT NULL")
    pairs = t.select("group_id", F.explode("ip_permissions").alias("p")).select("group_id", F.explode("p.user_id_group_pairs").alias("x")).where("x.group_id IS NOT NULL")
    out = t.select("group_id", F.explode("ip_permissions_egress").alias("p"))
    v4 = out.select("group_id", F.explode("p.ip_ranges").alias("x")).select("group_id", F.col("x.cidr_ip").alias("cidr"))
    v6 = out.select("group_id", F.explode("p.ipv6_ranges").alias("x")).select("group_id", F.col("x.cidr_ipv6").alias("cidr"))
    far = v4.unionByName(v6).where(F.col("cidr").isNotNull() & ~is_large_cidr(F.col("cidr")))
    return [link(t, REGION, "Contains", _sg("group_id")), link(pairs, _sg("x.group_id"), "ConnectsTo", _sg("group_id")), link(far, _sg("group_id"), "RoutesTo", Node("GenericIpAddress", "cidr"))]


ARMS = {
    "aws_instances": instances,
    "aws_ecs_clusters": _contained("AwsEcsCluster", "cluster_arn"),
    "aws_lambdas": lambdas,
    "aws_event_buses": lambda t, settings: [],
    "aws_config_resources": config_resources,
    "aws_load_balancers": load_balancers,
    "aws_listeners": listeners,
    "aws_hosted_zones": hosted_zones,
    "aws_record_sets": record_sets,
    "aws_eks": eks,
    "aws_rest_apis": _contained("AwsApiGatewayRestApi", "id"),
    "aws_rds": rds,
    "aws_dynamodb": _contained("AwsDynamoDbTable", "value"),
    "aws_sqs": _contained("AwsSqsQueue", "value"),
    "aws_sns": _contained("AwsSnsTopic", "topic_arn"),
    "aws_cloudfront": cloudfront,
    "aws_security_groups": security_groups,
    "aws_internet_gateways": internet_gateways,
    "aws_nat_gateways": nat_gateways,
    "aws_addresses": addresses,
    "aws_route_tables": route_tables,
}


def aws_facts(tables: dict[str, DataFrame], settings: Settings) -> DataFrame | None:
    """Facts of all tables; the regions of the settings and of all rows are nodes even if nothing else is."""
    parts: list[DataFrame] = []
    for name, arm in ARMS.items():
        if name in tables:
            parts += [there(tables[name], REGION), *arm(tables[name], settings)]
    if "aws_target_groups" in tables:
        parts += [there(tables["aws_target_groups"], REGION), *target_groups(tables["aws_target_groups"], settings, tables.get("aws_target_health"))]
    if parts and settings.regions:
        spark = parts[0].sparkSession
        parts.append(there(spark.createDataFrame([(r,) for r in settings.regions], "region string"), REGION))
    return union(parts) if parts else None
