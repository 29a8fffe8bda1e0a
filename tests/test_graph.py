"""Projection of the fixture estate, graph operators, differences and their application."""

import pytest
from pyspark.sql import functions as F

from loomgraph.demo import report
from loomgraph.engine import Engine, dot_lines, patch_document, snapshot_document, write_positions
from loomgraph.functions import exprs as E
from loomgraph.kinds import EDGE_KINDS, node_kinds
from loomgraph.operators import Graph, Patch, apply_patch, diff
from loomgraph.operators.patch import seed_positions
from loomgraph.plans import Settings, facts_to_graph
from loomgraph.plans.arms import Node as ArmNode
from loomgraph.plans.arms import link, links
from loomgraph.plans.cloudflare import accounts
from loomgraph.sources import fixture_tables, read_estate, write_fixtures
from loomgraph.sources.fixtures import SCHEMAS
from loomgraph.streaming import demo_tick

NODE = "kind string, id1 string, id2 string"
EDGE = "src_kind string, src_id1 string, src_id2 string, kind string, dst_kind string, dst_id1 string, dst_id2 string"


@pytest.fixture(scope="module")
def estate(spark):
    g = Engine(spark, lambda: fixture_tables(spark)).run_once()
    return Graph(g.nodes.cache(), g.edges.cache())


def graph(spark, nodes, edges):
    n = spark.createDataFrame([("N", x, "") for x in nodes], NODE)
    return Graph(n, spark.createDataFrame([("N", a, "", k, "N", b, "") for a, k, b in edges], EDGE))


def names(df):
    return sorted(r["id1"] for r in df.collect())


def test_golden_counts(estate):
    assert (estate.nodes.count(), estate.edges.count()) == (95, 84)
    assert {r["kind"]: r["n"] for r in estate.edge_counts().collect()} == {"Contains": 31, "ConnectsTo": 24, "RoutesTo": 13, "AttachedTo": 6, "ResolvesTo": 4, "DependsOn": 3, "HasIp": 3}
    assert [(r["provider"], r["n"]) for r in estate.legend().collect()] == [("AWS", 34), ("Azure", 18), ("Generic", 17), ("GCP", 15), ("Cloudflare", 10), ("External", 1)]


@pytest.mark.parametrize(("prefix", "nodes", "edges"), [("aws_", 41, 50), ("gcp_", 19, 10), ("azure_", 21, 7), ("cf_", 19, 17)])
def test_golden_by_provider(spark, prefix, nodes, edges):
    g = Engine(spark, lambda: {n: t for n, t in fixture_tables(spark).items() if n.startswith(prefix)}).run_once()
    assert (g.nodes.count(), g.edges.count()) == (nodes, edges)


def test_every_kind_occurs(spark, estate):
    assert estate.missing_kinds(node_kinds(spark)).count() == 0
    assert {r["kind"] for r in estate.edge_counts().collect()} == set(EDGE_KINDS)


def test_some_golden_edges(estate):
    have = {(r["source_key"], r["kind"], r["target_key"]) for r in estate.keyed_edges().collect()}
    for e in [
        ("AwsEc2SecurityGroup#AWS::Ec2SecurityGroup(sg-lb)", "ConnectsTo", "AwsEc2SecurityGroup#AWS::Ec2SecurityGroup(sg-web)"),
        ("AwsEc2Instance#AWS::Ec2Instance(i-globex-web-01)", "HasIp", "AwsEc2Eni#AWS::Ec2Eni(i-globex-web-01-eni)"),
        ("AwsEc2Instance#AWS::Ec2Instance(i-globex-web-01)", "DependsOn", "AwsTag#AWS::Tag(env=prod)"),
        ("AwsRegion#AWS::Region(global)", "Contains", "AwsConfigResource#AWS::S3::Bucket(globex-assets)"),
        ("GenericHostname#Generic::Hostname(v6.globex.io)", "ResolvesTo", "GenericIpAddress#Generic::IpAddress(2001:db8::10)"),
        ("CloudflareWorker#Cloudflare::Worker(edge-router)", "ConnectsTo", "ExternalService#External::Service(postgres://db.internal.globex.io)"),
        ("AzureNetworkSecurityGroup#Azure::Network::NetworkSecurityGroup(nsg-worker)", "RoutesTo", "AzureServiceTag#Azure::Network::ServiceTag(AzureCloud)"),
        ("AwsEc2RouteTable#AWS::EC2::RouteTable(rtb-private)", "RoutesTo", "AwsEc2NatGateway#AWS::EC2::NatGateway(nat-globex)"),
    ]:
        assert e in have


def test_seams(estate):
    assert names(estate.seams()) == ["10.20.0.5", "app-globex.azurewebsites.net"]


def test_replay_and_default(spark, tmp_path, estate):
    write_fixtures(str(tmp_path))
    g = Engine(spark, lambda: read_estate(spark, str(tmp_path))).run_once()
    assert diff(estate, g).is_empty()
    tables = {"aws_config_resources": spark.createDataFrame([({"AWS::Unknown::Widget": [{"resource_id": "w"}]}, "r")], "resources map<string,array<struct<resource_id:string>>>, region string")}
    assert Engine(spark, lambda: tables).run_once().edges.count() == 1
    assert Engine(spark, lambda: tables, Settings(exclude_by_default=True)).run_once().edges.count() == 0


def test_demo_tick(spark, estate):
    odd = demo_tick(estate, 1)
    assert (odd.nodes.count(), odd.edges.count()) == (97, 85)
    patch = diff(estate, odd)
    assert (patch.added_nodes.count(), patch.added_edges.count(), patch.removed_nodes.count()) == (2, 1, 0)
    assert diff(odd, demo_tick(estate, 2)).removed_nodes.count() == 2


def test_dedup_and_merge(spark):
    g = graph(spark, ["a", "a", "b"], [("a", "x", "b"), ("a", "x", "b"), ("a", "y", "b")]).dedup()
    assert (g.nodes.count(), g.edges.count()) == (2, 2)
    m = g.merge(graph(spark, ["b", "c"], [("b", "x", "c")]))
    assert (m.nodes.count(), m.edges.count()) == (3, 3)


def test_patch_application(spark):
    g = graph(spark, ["a", "b", "c"], [("a", "x", "b"), ("b", "x", "c")])
    h = graph(spark, ["a", "c", "d"], [("a", "x", "d")])
    p = diff(g, h)
    once = apply_patch(g, p)
    assert diff(once, h).is_empty() and diff(apply_patch(once, p), h).is_empty()
    orphan = Patch(p.added_nodes.limit(0), p.removed_nodes.limit(0), graph(spark, [], [("a", "x", "nowhere")]).edges, p.removed_edges.limit(0))
    assert diff(apply_patch(g, orphan), g).is_empty()
    assert diff(g, apply_patch(g, Patch.of_rows(p.rows()))).is_empty() is False
    assert diff(g, g).is_empty()


def test_neighbors_are_a_bag(spark):
    g = graph(spark, ["a", "b"], [("a", "x", "b"), ("a", "y", "b"), ("a", "x", "a")])
    near, edges = g.neighbors("N#N(a)")
    assert names(near) == ["a", "a", "b", "b"] and edges.count() == 4
    assert g.neighbors("N#nothing")[0].count() == 0


def test_degrees_and_snapshot(spark):
    g = graph(spark, ["a", "b", "c"], [("a", "x", "b"), ("a", "x", "a")])
    assert {r["id1"]: (r["degree"], r["mass"]) for r in g.degrees().collect()} == {"a": (3, 4), "b": (1, 2), "c": (0, 1)}
    nodes, edges = g.snapshot()
    assert sorted(r["id"] for r in nodes.collect()) == [0, 1, 2] and edges.count() == 2
    assert '"version":2' in snapshot_document(g).first()["value"] and dot_lines(g).count() == 5
    assert '"added_nodes":[]' in patch_document(diff(g, g)).first()["value"]


def test_neighborhood(spark):
    g = graph(spark, ["a", "b", "c"], [("a", "x", "b"), ("a", "y", "b"), ("a", "x", "a")])
    nodes, edges = g.neighborhood("N#N(a)")
    assert sorted((r["place"], r["id"], r["key"]) for r in nodes.collect()) == [(0, 0, "N#N(a)"), (1, 0, "N#N(a)"), (1, 0, "N#N(a)"), (1, 1, "N#N(b)"), (1, 1, "N#N(b)")]
    assert sorted((r["source"], r["target"], r["kind"]) for r in edges.collect()) == [(0, 0, "x"), (0, 0, "x"), (0, 1, "x"), (0, 1, "y")]
    with pytest.raises(KeyError):
        g.neighborhood("N#N(d)")


def test_lone_ends_and_many_links(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None), (None, "d"), (None, None), ("a", "b")], "s string, t string")
    g = facts_to_graph(link(df, ArmNode("N", "s"), "x", ArmNode("N", "t")))
    assert names(g.nodes) == ["a", "b", "c", "d"] and g.edges.count() == 1
    two = facts_to_graph(links(df, (ArmNode("N", "s"), "x", ArmNode("N", "t")), (ArmNode("N", "t"), "y", ArmNode("M", "s"))))
    assert (two.nodes.count(), two.edges.count()) == (6, 2)


def test_daemon_and_export(spark, tmp_path, capsys):
    calls = []

    def source():
        calls.append(1)
        if len(calls) == 2:
            raise OSError("gone")
        return {n: t for n, t in fixture_tables(spark).items() if n.startswith("cf_")}

    waits = []
    assert Engine(spark, source).run_daemon(str(tmp_path / "out"), 5.0, scans=3, sleep=waits.append) == 1 and waits == [5.0, 5.0]
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "dot")).collect()]
    assert len(lines) == 19 + 17 + 2 and sum(" -> " in x for x in lines) == 17
    assert spark.read.json(str(tmp_path / "out" / "json" / "nodes")).count() == 19
    write_positions(spark.createDataFrame([(1, 2.0, 3.0), (0, 1.0, 1.0)], "id bigint, x double, y double"), str(tmp_path / "xy"))
    assert dict(spark.read.parquet(str(tmp_path / "xy")).dtypes)["x"] == "float"


def test_a_source_that_fails_when_read_counts_as_empty(spark):
    tables = fixture_tables(spark)
    broken = {"gcp_topics": tables["gcp_topics"].withColumn("name", F.raise_error(F.lit("unreadable"))), "cf_kv": tables["cf_kv"], "gcp_gke": tables["gcp_gke"]}
    g = Engine(spark, lambda: broken).run_once()
    assert [r["kind"] for r in g.nodes.select("kind").distinct().collect()] == ["CloudflareKvNamespace"]
    with pytest.raises(Exception, match="unreadable"):
        Engine(spark, lambda: broken, Settings(strict_sources=True)).run_once().nodes.count()


def test_empty_collections_states_and_first_entries(spark):
    one = lambda name, rows: {name: spark.createDataFrame(rows, SCHEMAS[name])}
    run = lambda tables: Engine(spark, lambda: tables).run_once()
    assert names(run(one("aws_cloudfront", [])).nodes) == ["global"]
    state = lambda i, s: {"instance_id": i, "state": {"name": s} if s else None}
    assert names(run(one("aws_instances", [state("a", "running"), state("b", "terminated"), state("c", None), state("d", "pending")])).nodes) == ["a", "c", "d"]
    record = lambda entry, i: {"zone_id": "z", "entry": entry, "id": i, "name": "h", "type": "TXT"}
    g = run({**one("cf_zones", [{"id": "z"}, {"id": "z"}]), **one("cf_dns_records", [record(1, "late"), record(0, "r1"), record(0, "r2")])})
    assert names(g.nodes.where("kind = 'CloudflareDnsRecord'")) == ["r1", "r2"]
    zones = [{"id": str(i), "account": {"id": "acc"}} for i in range(3)]
    assert accounts(one("cf_zones", zones)["cf_zones"]).count() == 1


def test_report(spark, estate):
    lines, whole = report(spark)
    assert whole and lines[0] == "95 nodes, 84 edges" and len(lines) == 1 + 70 + 7 and lines[1:71] == sorted(lines[1:71])
    nodes, edges = Graph.of_snapshot(*estate.snapshot())
    assert nodes.count() <= 95 and nodes.where("color = '#ff9900'").count() > 0 and edges.where("color IS NULL").count() == 0


def test_seeding(spark):
    placed = spark.createDataFrame([("N", "a", "", 100.0, 40.0), ("N", "b", "", 200.0, 60.0)], NODE + ", x double, y double")
    new = seed_positions(placed, spark.createDataFrame([("N", "c", "")], NODE)).where("id1 = 'c'").first()
    assert (new["x"], new["y"]) == (150.0, 50.0)


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"c {kind}")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_scalar_functions(spark):
    cidrs = ["0.0.0.0/0", "::/0", "*", "10.0.0.0/8", "x/+8", "x/008", "10.20.0.5", "192.0.2.44/32", "10.0.0.0/16", "/300", "/8/9", "/", "/-1"]
    assert values(spark, E.is_large_cidr, cidrs) == [True] * 6 + [False] * 7
    assert values(spark, E.is_service_tag, ["AzureCloud", "AzureCloud.West", "::1", "*"]) == [True, False, False, False]
    assert values(spark, lambda c: E.segment_after(c, "/projects/"), ["x/projects/p/zones/z", "x/projects/", "x", None]) == ["p", "", None, None]
    assert values(spark, E.strip_scheme, ["https://https://a/b", "http://a:1", "a"]) == ["a/b", "a:1", "a"]
    assert values(spark, E.service_of_uri, ["postgres://u:p@h:5/x", "mysql://[::1]/d", "nothing"]) == ["postgres://h", "mysql://[::1]", None]
    assert values(spark, E.canonical_address, ["2001:0db8:0:0:0:0:0:10", "1.2.3.4", "no", None]) == ["2001:db8::10", "1.2.3.4", "no", None]
    assert values(spark, E.node_size, [0, 1, 4], "int") == [2.0, 4.0, 6.0]
    assert values(spark, E.edge_color, ["HasIp", "other"]) == ["#38585e", "#333b47"] and values(spark, E.provider_color, ["GCP"]) == ["#4285f4"]
    assert values(spark, E.azure_id, ["x/y"]) == ["/subscriptions/sub-globex/resourceGroups/rg-globex/providers/x/y"]
