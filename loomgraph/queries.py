"""The graph operators as queries over the star schema, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import dot_lines
from .functions import exprs as E
from .operators import layout as L
from .operators.graph import EDGE, NODE, Graph
from .operators.patch import Patch, apply_patch, diff, seed_positions
from .plans import Settings, aws, cloudflare
from .plans.arms import Node, facts_to_graph, first_per_key, link, union
from .star import host, star_graph, table, two_scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def facts_sql(orders: str = "orders") -> str:
    """The star graph's facts for some orders, as common table expressions named f, n and e."""
    line = f"(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {orders}))"
    edge = lambda s, a, k, d, b, t, b1="NULL": f"SELECT '{s}' AS src_kind, CAST({a} AS VARCHAR) AS src_id1, '' AS src_id2, '{k}' AS kind, '{d}' AS dst_kind, " + (f"CAST({b} AS VARCHAR) AS dst_id1, '' AS dst_id2" if b1 == "NULL" else f"'{b1}' AS dst_id1, CAST({b} AS VARCHAR) AS dst_id2") + f" FROM {t}"
    parts = [
        edge("Region", "n_regionkey", "Contains", "Nation", "n_nationkey", "nation"),
        edge("Nation", "c_nationkey", "Contains", "Customer", "c_custkey", "customer"),
        edge("Nation", "s_nationkey", "Contains", "Supplier", "s_suppkey", "supplier"),
        edge("Customer", "c_custkey", "DependsOn", "Tag", "c_mktsegment", "customer", "mktsegment"),
        edge("Part", "p_partkey", "DependsOn", "Tag", "p_brand", "part", "brand"),
        edge("Customer", "o_custkey", "ConnectsTo", "Order", "o_orderkey", orders),
        edge("Order", "l_orderkey", "AttachedTo", "Part", "l_partkey", line),
        edge("Order", "l_orderkey", "RoutesTo", "Supplier", "l_suppkey", line),
        edge("Supplier", "l_suppkey", "HasIp", "Part", "l_partkey", line),
        edge("Page", "page_id", "ResolvesTo", "Hostname", "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", "pages"),
    ]
    return " UNION ".join(parts)


LONE_SQL = "SELECT 'User' AS kind, CAST(user_id AS VARCHAR) AS id1, '' AS id2 FROM events UNION SELECT 'EventType', event_type, '' FROM events UNION SELECT 'Region', CAST(r_regionkey AS VARCHAR), '' FROM region"


def graph_sql(suffix: str = "", orders: str = "orders") -> str:
    return f"e{suffix} AS ({facts_sql(orders)}), n{suffix} AS (SELECT src_kind AS kind, src_id1 AS id1, src_id2 AS id2 FROM e{suffix} UNION SELECT dst_kind, dst_id1, dst_id2 FROM e{suffix} UNION {LONE_SQL})"


GRAPH = f"WITH {graph_sql()}"
SCANS = f"WITH o1 AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), o2 AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'), {graph_sql('1', 'o1')}, {graph_sql('2', 'o2')}"
key_sql = lambda k, a: f"{k} || '#' || {k} || '(' || {a} || ')'"
N3, E7 = "kind, id1, id2", ", ".join(EDGE)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def on_graph(name: str, f: Callable[[Graph], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf: f(star_graph(spark, sf))
    if sql:
        SQL[name] = f"{GRAPH} {sql}"


DEGREE = f"d AS (SELECT {N3}, CAST(sum(one) AS BIGINT) AS degree FROM (SELECT src_kind AS kind, src_id1 AS id1, src_id2 AS id2, 1 AS one FROM e UNION ALL SELECT dst_kind, dst_id1, dst_id2, 1 FROM e UNION ALL SELECT {N3}, 0 FROM n) GROUP BY {N3})"
PROVIDER = "CASE WHEN kind LIKE 'Aws%' THEN 'AWS' WHEN kind = 'ExternalService' THEN 'External' ELSE 'Generic' END"
on_graph("nodes_distinct", lambda g: g.nodes, f"SELECT {N3} FROM n")
on_graph("edges_distinct", lambda g: g.edges, f"SELECT {E7} FROM e")
on_graph("node_kind_counts", lambda g: g.node_counts(), "SELECT kind, count(*) AS n FROM n GROUP BY kind")
on_graph("edge_kind_counts", lambda g: g.edge_counts(), "SELECT kind, count(*) AS n FROM e GROUP BY kind")
on_graph("provider_legend", lambda g: g.legend(), f"SELECT {PROVIDER} AS provider, count(*) AS n FROM n GROUP BY 1 ORDER BY n DESC")
on_graph("labels_keys", lambda g: g.keyed_nodes().select("key", "label"), f"SELECT {key_sql('kind', 'id1')} AS key, kind || '(' || id1 || ')' AS label FROM n")
on_graph("edge_keys", lambda g: g.keyed_edges().select("key", "source_key", "target_key"), f"SELECT kind || '|' || {key_sql('src_kind', 'src_id1')} || '->' || {key_sql('dst_kind', 'dst_id1')} AS key, {key_sql('src_kind', 'src_id1')} AS source_key, {key_sql('dst_kind', 'dst_id1')} AS target_key FROM e")
on_graph("node_degree", lambda g: g.degrees().select(*NODE, F.col("degree").cast("bigint").alias("degree")), f"SELECT {N3}, CAST(sum(one) AS BIGINT) AS degree FROM (SELECT src_kind AS kind, src_id1 AS id1, src_id2 AS id2, 1 AS one FROM e UNION ALL SELECT dst_kind, dst_id1, dst_id2, 1 FROM e UNION ALL SELECT {N3}, 0 FROM n) GROUP BY {N3}")
for _name, _col, _sql in (("node_mass", "mass", "degree + 1"), ("node_size", "size", "round(2 + 2 * sqrt(degree), 9)")):
    QUERIES[_name] = lambda spark, sf, c=_col: star_graph(spark, sf).degrees().select(*NODE, (F.round(c, 9) if c == "size" else F.col(c).cast("bigint")).alias(c))
    SQL[_name] = f"{GRAPH}, {DEGREE} SELECT {N3}, {_sql} AS {_col} FROM d"
IDS = "i AS (SELECT kind, id1, id2, row_number() OVER (ORDER BY kind, id1, id2) - 1 AS id FROM n)"
QUERIES["snapshot_nodes"] = lambda spark, sf: star_graph(spark, sf).snapshot()[0]
SQL["snapshot_nodes"] = f"{GRAPH}, {IDS} SELECT id, {key_sql('kind', 'id1')} AS key, kind || '(' || id1 || ')' AS label, kind FROM i"
QUERIES["snapshot_edges"] = lambda spark, sf: star_graph(spark, sf).snapshot()[1].select("source", "target", "kind")
SQL["snapshot_edges"] = f"{GRAPH}, {IDS} SELECT a.id AS source, b.id AS target, e.kind FROM e JOIN i a ON a.kind = src_kind AND a.id1 = src_id1 AND a.id2 = src_id2 JOIN i b ON b.kind = dst_kind AND b.id1 = dst_id1 AND b.id2 = dst_id2"
KINDS_SQL = "VALUES ('Region'), ('Nation'), ('Gateway'), ('Router')"
QUERIES["missing_kinds"] = lambda spark, sf: star_graph(spark, sf).missing_kinds(spark.createDataFrame([("Region",), ("Nation",), ("Gateway",), ("Router",)], "kind string"))
SQL["missing_kinds"] = f"{GRAPH}, k(kind) AS ({KINDS_SQL}) SELECT kind FROM k WHERE kind NOT IN (SELECT kind FROM n)"
on_graph("dot_lines", lambda g: dot_lines(g), None)
SQL["dot_lines"] = f"{GRAPH}, {IDS} SELECT '  ' || id || ' [label=\"' || kind || '(' || replace(id1, '\"', '\\\"') || ')\"];' AS line FROM i UNION ALL SELECT '  ' || a.id || ' -> ' || b.id || ' [label=\"' || e.kind || '\"];' FROM e JOIN i a ON a.kind = src_kind AND a.id1 = src_id1 AND a.id2 = src_id2 JOIN i b ON b.kind = dst_kind AND b.id1 = dst_id1 AND b.id2 = dst_id2"

CENTER = "Nation#Nation(3)"
FAR = "SELECT dst_kind AS kind, dst_id1 AS id1, dst_id2 AS id2 FROM e WHERE src_kind = 'Nation' AND src_id1 = '3' UNION ALL SELECT src_kind, src_id1, src_id2 FROM e WHERE dst_kind = 'Nation' AND dst_id1 = '3'"
on_graph("neighbors_nodes", lambda g: g.neighbors(CENTER)[0].select("key", "label"), f"SELECT {key_sql('kind', 'id1')} AS key, kind || '(' || id1 || ')' AS label FROM ({FAR})")
on_graph("neighbors_edges", lambda g: g.neighbors(CENTER)[1].select("source_key", "target_key", "kind"), f"SELECT {key_sql('src_kind', 'src_id1')} AS source_key, {key_sql('dst_kind', 'dst_id1')} AS target_key, kind FROM e WHERE (src_kind = 'Nation' AND src_id1 = '3') OR (dst_kind = 'Nation' AND dst_id1 = '3')")

# differences and patches


def on_scans(name: str, f: Callable[[Graph, Graph], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: f(*two_scans(spark, sf))
    SQL[name] = f"{SCANS} {sql}"


on_scans("diff_nodes_added", lambda a, b: diff(a, b).added_nodes, "SELECT * FROM n2 EXCEPT SELECT * FROM n1")
on_scans("diff_nodes_removed", lambda a, b: diff(a, b).removed_nodes, "SELECT * FROM n1 EXCEPT SELECT * FROM n2")
on_scans("diff_edges_added", lambda a, b: diff(a, b).added_edges, "SELECT * FROM e2 EXCEPT SELECT * FROM e1")
on_scans("diff_edges_removed", lambda a, b: diff(a, b).removed_edges, "SELECT * FROM e1 EXCEPT SELECT * FROM e2")
on_scans("patch_summary", lambda a, b: diff(a, b).summary(), " UNION ALL ".join(f"SELECT '{op}' AS op, '{w}' AS entity, count(*) AS n FROM (SELECT * FROM {t}{x} EXCEPT SELECT * FROM {t}{y})" for op, x, y in (("add", 2, 1), ("remove", 1, 2)) for w, t in (("node", "n"), ("edge", "e"))))
on_scans("patch_apply_nodes", lambda a, b: apply_patch(a, diff(a, b)).nodes, "SELECT * FROM n2")
on_scans("patch_apply_edges", lambda a, b: apply_patch(a, diff(a, b)).edges, "SELECT * FROM e2")
on_scans("patch_replay_idempotent", lambda a, b: (lambda p: apply_patch(apply_patch(a, p), p).edges)(diff(a, b)), "SELECT * FROM e2")
on_scans("merge_nodes", lambda a, b: a.merge(b).nodes, "SELECT * FROM n1 UNION SELECT * FROM n2")
on_scans("merge_edges", lambda a, b: a.merge(b).edges, "SELECT * FROM e1 UNION SELECT * FROM e2")
on_scans("nodes_in_both", lambda a, b: a.nodes.intersect(b.nodes), "SELECT * FROM n1 INTERSECT SELECT * FROM n2")


def _orphans(a: Graph, b: Graph) -> DataFrame:
    p = diff(a, b)
    none = p.added_nodes.where("false")
    return apply_patch(a, Patch(none, none, p.added_edges, p.removed_edges.where("false"))).edges


on_scans("patch_orphan_edges_dropped", _orphans, "SELECT * FROM e1 UNION SELECT e2.* FROM e2 JOIN n1 s ON s.kind = src_kind AND s.id1 = src_id1 AND s.id2 = src_id2 JOIN n1 d ON d.kind = dst_kind AND d.id1 = dst_id1 AND d.id2 = dst_id2")


def _cascade(a: Graph, b: Graph) -> DataFrame:
    none = a.edges.where("false")
    gone = a.nodes.where("kind = 'Part' AND try_cast(id1 AS BIGINT) % 7 = 0")
    return apply_patch(a, Patch(a.nodes.where("false"), gone, none, none)).edges


on_scans("patch_remove_cascades", _cascade, "SELECT * FROM e1 WHERE NOT (dst_kind = 'Part' AND CAST(CASE WHEN dst_kind = 'Part' THEN dst_id1 ELSE '1' END AS BIGINT) % 7 = 0) AND NOT (src_kind = 'Part' AND CAST(CASE WHEN src_kind = 'Part' THEN src_id1 ELSE '1' END AS BIGINT) % 7 = 0)")

# joins and projections of the arms


@query("WITH t AS (SELECT l_suppkey AS ip, CASE l_linenumber % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' END AS provider FROM lineitem), m AS (SELECT DISTINCT ip, provider FROM t WHERE provider IS NOT NULL) SELECT 'GenericIpAddress' AS kind, CAST(ip AS VARCHAR) AS id1, string_agg(provider, ',' ORDER BY provider) AS providers FROM m GROUP BY ip HAVING count(*) > 1")
def seams(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses (suppliers) that nodes of two providers (line numbers) touch; some touch them as generic hosts only."""
    k = F.col("l_linenumber") % 3
    mine = Node(F.when(k == 0, "AwsEc2Instance").when(k == 1, "GcpComputeInstance").otherwise("GenericHostname"), "l_orderkey")
    graph = facts_to_graph(link(table(spark, sf, "lineitem"), mine, "ConnectsTo", Node("GenericIpAddress", "l_suppkey")))
    return graph.seams(("GenericIpAddress",)).select("kind", "id1", F.array_join("providers", ",").alias("providers"))


@query("SELECT n_nationkey AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def pivot_seams(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers that meet at a nation: counted on both sides before the join."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, "nation").select("nation", (F.col("c") * F.col("s")).alias("pairs"))


@query("WITH f AS (SELECT l_orderkey, min(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN f ON f.l_orderkey = o_orderkey AND l_linenumber = m")
def first_match_join(spark: SparkSession, sf: str) -> DataFrame:
    first = first_per_key(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "orders").select("o_orderkey").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT CASE WHEN c_acctbal >= 0 THEN 'Nation' ELSE 'Region' END AS src_kind, CAST(CASE WHEN c_acctbal >= 0 THEN n_nationkey ELSE n_regionkey END AS VARCHAR) AS src_id1, CAST(c_custkey AS VARCHAR) AS dst_id1 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def contains_else_fallback(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("inner_place", F.when(F.col("c_acctbal") >= 0, F.col("n_nationkey")))
    has = F.col("inner_place").isNotNull()
    source = Node(F.when(has, "Nation").otherwise("Region"), F.coalesce("inner_place", "n_regionkey"))
    return link(t, source, "Contains", Node("Customer", "c_custkey")).where("edge IS NOT NULL").select("src_kind", "src_id1", "dst_id1")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus) AS place FROM orders")
def coalesce_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.col("o_orderstatus")).alias("place"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Supplier' WHEN starts_with(l_linestatus, 'O') THEN 'Part' END AS via, CASE WHEN l_returnflag = 'R' THEN l_suppkey WHEN starts_with(l_linestatus, 'O') THEN l_partkey END AS id FROM lineitem WHERE l_returnflag = 'R' OR starts_with(l_linestatus, 'O')")
def priority_route(spark: SparkSession, sf: str) -> DataFrame:
    back, open_ = F.col("l_returnflag") == "R", F.startswith(F.col("l_linestatus"), F.lit("O"))
    via, id_ = F.when(back, "Supplier").when(open_, "Part"), F.when(back, F.col("l_suppkey")).when(open_, F.col("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", via.alias("via"), id_.alias("id")).where("via IS NOT NULL")


edges_of = lambda parts: union(parts).where("edge IS NOT NULL").select("src_kind", "src_id1", "edge", "dst_kind", "dst_id1").distinct()


@query("SELECT DISTINCT 'AwsEc2RouteTable' AS src_kind, CAST(l_orderkey AS VARCHAR) AS src_id1, 'RoutesTo' AS edge, CASE WHEN l_returnflag = 'R' THEN 'AwsEc2NatGateway' ELSE 'AwsEc2InternetGateway' END AS dst_kind, CASE WHEN l_returnflag = 'R' THEN 'nat-' || l_suppkey ELSE 'igw-' || l_partkey END AS dst_id1 FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' UNION SELECT 'AwsEc2Vpc', CAST(o_custkey AS VARCHAR), 'Contains', 'AwsEc2RouteTable', CAST(o_orderkey AS VARCHAR) FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def arm_route_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as route tables of their customers' networks, lines as their routes: over NAT, over a gateway, or neither."""
    route = F.struct(F.lit(None).cast("string").alias("destination_cidr_block"), F.concat(F.when(F.col("l_linestatus") == "O", "igw-").otherwise("vgw-"), F.col("l_partkey")).alias("gateway_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("nat-"), F.col("l_suppkey"))).alias("nat_gateway_id"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(route).alias("routes"))
    t = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("route_table_id"), F.col("o_custkey").cast("string").alias("vpc_id"), "routes", F.array().cast("array<struct<subnet_id:string>>").alias("associations"))
    return edges_of(aws.route_tables(t, Settings()))


@query("SELECT CASE WHEN c_acctbal >= 0 THEN 'AwsEc2Vpc' ELSE 'AwsRegion' END AS src_kind, CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS src_id1, 'Contains' AS edge, 'AwsElbLoadBalancer' AS dst_kind, CAST(c_custkey AS VARCHAR) AS dst_id1 FROM customer")
def arm_load_balancers(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("load_balancer_arn"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).alias("vpc_id"), F.col("c_mktsegment").alias("region"))
    return edges_of(aws.load_balancers(t, Settings()))


@query("SELECT DISTINCT 'AwsElbTargetGroup' AS src_kind, CAST(o_custkey AS VARCHAR) AS src_id1, 'ConnectsTo' AS edge, 'AwsEc2Instance' AS dst_kind, CAST(o_orderkey AS VARCHAR) AS dst_id1 FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT 'AwsEc2Vpc', CAST(c_nationkey AS VARCHAR), 'Contains', 'AwsElbTargetGroup', CAST(c_custkey AS VARCHAR) FROM customer")
def arm_target_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as target groups; the orders that a separate collection lists for each are their targets."""
    t = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("target_group_arn"), F.col("c_nationkey").cast("string").alias("vpc_id"))
    target = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("target"))
    health = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.collect_list(target).alias("v")).select(F.create_map("k", "v").alias("health"))
    return edges_of(aws.target_groups(t, Settings(), health))


@query("SELECT 'AwsEc2Eip' AS src_kind, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus) AS src_id1, 'ConnectsTo' AS edge, 'GenericIpAddress' AS dst_kind, o_orderstatus AS dst_id1 FROM orders GROUP BY ALL")
def arm_addresses(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("allocation_id"), F.col("o_orderstatus").alias("public_ip"))
    return edges_of(aws.addresses(t, Settings()))


@query("WITH r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '0.0.0.0/0' WHEN 1 THEN '10.0.0.0/' || (s_nationkey + 8) ELSE '192.0.2.1/32' END AS c, s_nationkey + 8 AS size FROM supplier) SELECT 'AwsEc2SecurityGroup' AS src_kind, CAST(s_suppkey AS VARCHAR) AS src_id1, 'RoutesTo' AS edge, 'GenericIpAddress' AS dst_kind, c AS dst_id1 FROM r WHERE s_suppkey % 3 = 2 OR (s_suppkey % 3 = 1 AND size >= 16) UNION SELECT 'AwsRegion', CAST(s_nationkey AS VARCHAR), 'Contains', 'AwsEc2SecurityGroup', CAST(s_suppkey AS VARCHAR) FROM supplier")
def arm_security_groups(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    cidr = F.when(k == 0, "0.0.0.0/0").when(k == 1, F.concat(F.lit("10.0.0.0/"), F.col("s_nationkey") + 8)).otherwise("192.0.2.1/32")
    out = F.array(F.struct(F.array(F.struct(cidr.alias("cidr_ip"))).alias("ip_ranges"), F.array().cast("array<struct<cidr_ipv6:string>>").alias("ipv6_ranges")))
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("group_id"), F.col("s_nationkey").cast("string").alias("region"), out.alias("ip_permissions_egress"), F.array().cast("array<struct<user_id_group_pairs:array<struct<group_id:string>>>>").alias("ip_permissions"))
    return edges_of(aws.security_groups(t, Settings()))


@query("WITH f AS (SELECT o_custkey AS z, min(month(o_orderdate)) AS m FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders JOIN f ON z = o_custkey AND month(o_orderdate) = m JOIN customer ON c_custkey = o_custkey) SELECT 'CloudflareZone' AS src_kind, CAST(o_custkey AS VARCHAR) AS src_id1, 'Contains' AS edge, 'CloudflareDnsRecord' AS dst_kind, CAST(o_orderkey AS VARCHAR) AS dst_id1 FROM r UNION SELECT 'CloudflareDnsRecord', CAST(o_orderkey AS VARCHAR), 'RoutesTo', 'GenericHostname', o_orderpriority FROM r")
def arm_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as zones, their orders as records; of a zone that is listed for several months the first entry counts."""
    o = table(spark, sf, "orders")
    records = o.select(F.col("o_custkey").cast("string").alias("zone_id"), F.month("o_orderdate").alias("entry"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("TXT").alias("type"), F.lit("-").alias("content"))
    return edges_of(cloudflare.zones(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id")), records))


@query(f"{GRAPH}, {IDS}, near AS ({FAR}) SELECT 0 AS place, id, {key_sql('kind', 'id1')} AS key FROM i WHERE kind = 'Nation' AND id1 = '3' UNION ALL SELECT 1, i.id, {key_sql('i.kind', 'i.id1')} FROM near JOIN i ON i.kind = near.kind AND i.id1 = near.id1 AND i.id2 = near.id2")
def neighborhood_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).neighborhood(CENTER)[0].select("place", "id", "key")


@query(f"{GRAPH} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).totals()


@query(f"{GRAPH} SELECT k.kind, count(n.kind) AS n, count(n.kind) > 0 AS covered FROM (VALUES ('Region'), ('Part'), ('Gateway')) k(kind) LEFT JOIN n ON n.kind = k.kind GROUP BY k.kind")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).coverage(spark.createDataFrame([("Region",), ("Part",), ("Gateway",)], "kind string"))


@query(f"{GRAPH} SELECT kind, CASE kind WHEN 'ConnectsTo' THEN '#54604f' WHEN 'DependsOn' THEN '#5c4f36' WHEN 'HasIp' THEN '#38585e' WHEN 'RoutesTo' THEN '#2f6285' WHEN 'ResolvesTo' THEN '#6c4a78' ELSE '#333b47' END AS color FROM (SELECT DISTINCT kind FROM e)")
def edge_colors(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).edges.select("kind").distinct().select("kind", E.edge_color(F.col("kind")).alias("color"))


CIDR = "'10.0.0.0/' || CAST(o_orderkey % 40 AS VARCHAR)"


@query(f"SELECT o_orderkey, {CIDR} AS cidr FROM orders WHERE o_orderkey % 40 >= 16")
def cidr_filter(spark: SparkSession, sf: str) -> DataFrame:
    cidr = F.concat(F.lit("10.0.0.0/"), (F.col("o_orderkey") % 40).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", cidr.alias("cidr")).where(~E.is_large_cidr(F.col("cidr")))


@query("WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AzureCloud' WHEN 1 THEN 'Storage.West' WHEN 2 THEN '10.0.0.0/24' ELSE '*' END AS d FROM part) SELECT p_partkey, CASE WHEN d = 'AzureCloud' THEN 'tag' ELSE 'address' END AS route FROM t WHERE d <> '*'")
def service_tag_route(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    d = F.when(k == 0, "AzureCloud").when(k == 1, "Storage.West").when(k == 2, "10.0.0.0/24").otherwise("*")
    tag = E.is_service_tag(F.col("d"))
    return table(spark, sf, "part").select("p_partkey", d.alias("d")).where(tag | ~E.is_large_cidr(F.col("d"))).select("p_partkey", F.when(tag, "tag").otherwise("address").alias("route"))


RESOURCE = "CASE l_linenumber % 4 WHEN 0 THEN 'AWS::S3::Bucket' WHEN 1 THEN 'AWS::SNS::Topic' WHEN 2 THEN 'AWS::Other::Thing' ELSE 'AWS::EC2::VPC' END"


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "AWS::S3::Bucket").when(k == 1, "AWS::SNS::Topic").when(k == 2, "AWS::Other::Thing").otherwise("AWS::EC2::VPC")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", kind.alias("resource"))


@query(f"SELECT resource, count(*) AS n FROM (SELECT {RESOURCE} AS resource FROM lineitem) WHERE resource NOT IN ('AWS::SNS::Topic', 'AWS::Other::Thing') GROUP BY resource")
def allow_list(spark: SparkSession, sf: str) -> DataFrame:
    return _resources(spark, sf).where(E.use_resource(F.col("resource"), True)).groupBy("resource").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT place, resource, count(*) AS n FROM (SELECT CASE WHEN r = 'AWS::S3::Bucket' THEN 'global' ELSE l_returnflag END AS place, r AS resource FROM (SELECT l_returnflag, {RESOURCE} AS r FROM lineitem)) GROUP BY place, resource")
def global_vs_region(spark: SparkSession, sf: str) -> DataFrame:
    place = F.when(E.is_global(F.col("resource")), "global").otherwise(F.col("l_returnflag"))
    return _resources(spark, sf).groupBy(place.alias("place"), "resource").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE WHEN strpos(url, '/en/') > 0 THEN split_part(substr(url, strpos(url, '/en/') + 4), '/', 1) END AS segment FROM pages")
def path_segment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", E.segment_after(F.col("url"), "/en/").alias("segment"))


@query("SELECT page_id, regexp_replace(url, '^(https://)*(http://)*', '') AS rest FROM pages")
def scheme_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", E.strip_scheme(F.col("url")).alias("rest"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS service FROM pages")
def url_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"), E.service_of_uri(F.col("url")).alias("service"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE lower(event_type) IN ('click', 'error') GROUP BY event_type")
def route_by_type(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events")
    routes = [t.where(F.lower("event_type") == k) for k in ("click", "error")]
    return union(routes).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, round(CAST(embedding[i] AS DOUBLE), 5) + CAST(0 AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def unnest_hoist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "v")).select("vec_id", "place", (F.round(F.col("v").cast("double"), 5) + F.lit(0.0)).alias("v"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def page_cap_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", r.alias("r")).where("r <= 3").drop("r")


# layout


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """All parts at places told by their columns."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3 % 101 + F.col("p_partkey") / 1000).alias("x"), (F.col("p_size") + F.col("p_partkey") / 500).alias("y"), (F.col("p_size") % 5 + 1).cast("double").alias("mass"))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 7 % F.lit(max(1, p.count()))).alias("target"))


PLACED = "p AS (SELECT p_partkey AS id, (p_partkey * 3 % 101) + p_partkey / 1000 AS x, p_size + p_partkey / 500 AS y, CAST(p_size % 5 + 1 AS DOUBLE) AS mass FROM part), pe AS (SELECT p_partkey AS source, p_partkey * 7 % (SELECT count(*) FROM part) AS target FROM part)"
rounded = lambda df, *c: df.select("id", *((F.round(x, 6) + F.lit(0.0)).alias(x) for x in c))  # noqa: E731  no negative zeros


@query(f"WITH {PLACED} SELECT round(avg(x), 6) + CAST(0 AS DOUBLE) AS x, round(avg(y), 6) + CAST(0 AS DOUBLE) AS y FROM p")
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return L.centroid(placed(spark, sf)).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {PLACED} SELECT round(min(x) - 0.08 * (max(x) - min(x)), 6) AS min_x, round(max(x) + 0.08 * (max(x) - min(x)), 6) AS max_x, round(min(y) - 0.08 * (max(y) - min(y)), 6) AS min_y, round(max(y) + 0.08 * (max(y) - min(y)), 6) AS max_y FROM p")
def bbox(spark: SparkSession, sf: str) -> DataFrame:
    return L.bounding_box(placed(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@query("SELECT p_partkey AS id, round(10 * sqrt(p_partkey) * cos(CAST(2.3999632 AS DOUBLE) * p_partkey), 6) + CAST(0 AS DOUBLE) AS x, round(10 * sqrt(p_partkey) * sin(CAST(2.3999632 AS DOUBLE) * p_partkey), 6) + CAST(0 AS DOUBLE) AS y FROM part")
def initial_spiral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.initial_positions(table(spark, sf, "part").select(F.col("p_partkey").alias("id"))), "x", "y")


@query()
def repulsion_exact(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs: tested against the kernel, for SQL would join them too."""
    return rounded(L.repulsion_exact(placed(spark, sf)), "fx", "fy")


@query(f"WITH {PLACED}, d AS (SELECT source, target, b.x - a.x AS dx, b.y - a.y AS dy FROM pe JOIN p a ON a.id = source JOIN p b ON b.id = target) SELECT id, round(sum(dx), 6) + CAST(0 AS DOUBLE) AS fx, round(sum(dy), 6) + CAST(0 AS DOUBLE) AS fy FROM (SELECT source AS id, dx, dy FROM d UNION ALL SELECT target, -dx, -dy FROM d) GROUP BY id")
def attraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.attraction(placed(spark, sf), part_edges(spark, sf)), "fx", "fy")


@query(f"WITH {PLACED} SELECT id, round(-mass * x / sqrt(x * x + y * y), 6) + CAST(0 AS DOUBLE) AS fx, round(-mass * y / sqrt(x * x + y * y), 6) + CAST(0 AS DOUBLE) AS fy FROM p WHERE x * x + y * y > 0")
def gravity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.gravity(placed(spark, sf)), "fx", "fy")


@query(f"WITH {PLACED}, g AS (SELECT id, mass, -mass * x / sqrt(x * x + y * y) AS fx, -mass * y / sqrt(x * x + y * y) AS fy FROM p WHERE x * x + y * y > 0) SELECT round(sum(mass * sqrt((fx - 1) ** 2 + (fy - 1) ** 2)), 5) AS swing, round(sum(mass * sqrt((fx + 1) ** 2 + (fy + 1) ** 2) / 2), 5) AS traction FROM g")
def swing_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Mass-weighted swing and traction of the pull to the origin against a force of (1, 1) before."""
    forces = L.gravity(placed(spark, sf)).select("mass", "fx", "fy", F.lit(1.0).alias("ox"), F.lit(1.0).alias("oy"))
    return L.swing_and_traction(forces).select(F.round("swing", 5).alias("swing"), F.round("traction", 5).alias("traction"))


@query()
def barnes_hut_repulsion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.repulsion_by_tree(placed(spark, sf), theta=0.5), "fx", "fy")


@query()
def layout_run(spark: SparkSession, sf: str) -> DataFrame:
    return L.layout(placed(spark, sf).select("id"), part_edges(spark, sf), 50)


@query()
def warm_pinned(spark: SparkSession, sf: str) -> DataFrame:
    some = F.when(F.col("id") % 3 > 0, F.col("x")).otherwise(F.lit(float("nan")))
    return L.layout(placed(spark, sf).select("id", some.alias("x"), "y"), part_edges(spark, sf), 20)


@query("WITH c AS (SELECT avg(c_acctbal) AS x, avg(c_nationkey) AS y FROM customer WHERE c_custkey % 2 = 0) SELECT CAST(c_custkey AS VARCHAR) AS id1, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c.x END, 4) AS x, round(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c.y END, 4) AS y FROM customer, c")
def patch_seed_positions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("Customer").alias("kind"), F.col("c_custkey").cast("string").alias("id1"), F.lit("").alias("id2"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), "c_custkey")
    out = seed_positions(c.where("c_custkey % 2 = 0").drop("c_custkey"), c)
    return out.select("id1", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def stream_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of days, each a full scan of that day's users and events; the edges of the graph after the last."""
    import uuid

    from .streaming import Reconciler

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        given = sc.getConf().get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="loomgraph-"))
    folder = f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").where("ts IS NOT NULL").select(F.to_date("ts").cast("string").alias("day"), "user_id", "event_type")
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "day").write.partitionBy("day").parquet(f"{folder}/in")
    state = Reconciler(spark, f"{folder}/state")
    fs, path = state._fs(f"{folder}/in")
    days = sorted((d.getPath() for d in fs.listStatus(path) if d.isDirectory()), key=lambda p: p.getName())
    for k, day in enumerate(days):  # a file each; they are taken in the order of their times
        for file in fs.listStatus(day):
            fs.setTimes(file.getPath(), 1_000_000_000_000 + 1000 * k, -1)
    stream = spark.readStream.schema("user_id bigint, event_type string, day string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def scan(df: DataFrame, batch_id: int) -> Graph:
        return facts_to_graph(link(df, Node("User", "user_id"), "ConnectsTo", Node("EventType", "event_type")))

    state.stream(stream, scan, f"{folder}/offsets").awaitTermination()
    newest = state.replay(Graph(*state._nothing()), 0)
    return newest.edges.select(F.col("src_id1").alias("user_id"), F.col("dst_id1").alias("event_type"))
