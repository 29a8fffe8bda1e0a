"""The paged source, snapshots, edge lists and the reconciled stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import Graph, diff
from loomgraph.plans.arms import Node, facts_to_graph, link
from loomgraph.sources import read_snapshot
from loomgraph.sources.edge_list import from_edge_list
from loomgraph.sources.paged import register
from loomgraph.streaming import Reconciler, Session


def pages(folder, scope, *bodies):
    at = folder / scope
    at.mkdir(parents=True)
    for k, body in enumerate(bodies):
        (at / ("first.json" if k == 0 else f"t{k}.json")).write_text(json.dumps(body))


def test_paged(spark, tmp_path):
    register(spark)
    pages(tmp_path / "a", "one", {"items": [{"id": 1, "type": "X"}, {"id": 2, "type": "y"}], "nextPageToken": "t1"}, {"items": [{"id": 3, "type": "x"}]})
    pages(tmp_path / "a", "two", {"items": None})
    df = spark.read.format("paged_json").option("path", str(tmp_path / "a")).load()
    assert sorted(json.loads(r["row"])["id"] for r in df.collect()) == [1, 2, 3]
    typed = spark.read.format("paged_json").option("path", str(tmp_path / "a")).option("pushable", "type").load()
    assert sorted(json.loads(r["row"])["id"] for r in typed.where("type IN ('X', 'x')").collect()) == [1, 3]
    pages(tmp_path / "b", "z", {"items": {"zone1": {"rows": [{"id": 4}]}, "zone2": {}}})
    inner = spark.read.format("paged_json").option("path", str(tmp_path / "b")).option("inner", "rows").load()
    assert [json.loads(r["row"])["id"] for r in inner.collect()] == [4]
    capped = spark.read.format("paged_json").option("path", str(tmp_path / "a"))
    assert sorted(json.loads(r["row"])["id"] for r in capped.option("pages", 1).load().collect()) == [1, 2]
    assert [json.loads(r["row"])["id"] for r in capped.option("limit", 1).load().collect()] == [1]
    pages(tmp_path / "c", "bad", {"success": False})
    read = spark.read.format("paged_json").option("path", str(tmp_path / "c"))
    with pytest.raises(Exception, match="failed"):
        read.load().collect()
    assert read.option("tolerant", "true").load().count() == 0


def test_snapshot_and_edge_list(spark, tmp_path):
    doc = {"version": 2, "nodes": [{"id": 10, "key": "a"}, {"id": 99, "key": "b"}], "edges": [{"source": 99, "target": 10}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    nodes, edges = read_snapshot(spark, str(path))
    assert nodes.count() == 2 and [(r["source"], r["target"]) for r in edges.collect()] == [(1, 0)]
    for broken in ({**doc, "version": 3}, {**doc, "edges": [{"source": 1, "target": 10}]}):
        path.write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            read_snapshot(spark, str(path))
    assert from_edge_list(spark, 3, [0, 1, 1, 2])[1].count() == 2
    for flat in ([0], [0, 3]):
        with pytest.raises(ValueError):
            from_edge_list(spark, 3, flat)


def test_stream(spark, tmp_path):
    for day, rows in enumerate([["a x", "b x"], ["b x"], ["b x"], ["b y", "c y"]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        path = tmp_path / "in" / f"{day}.csv"
        path.write_text("".join(f"{r.split()[0]},{r.split()[1]}\n" for r in rows))
        os.utime(path, (1e9 + 10 * day, 1e9 + 10 * day))  # files are taken in the order of their times
    state = Reconciler(spark, str(tmp_path / "state"))
    scan = lambda df, v: facts_to_graph(link(df, Node("U", "u"), "ConnectsTo", Node("T", "t")))
    stream = spark.readStream.schema("u string, t string").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    state.stream(stream, scan, str(tmp_path / "offsets")).awaitTermination()
    newest = state.graph()
    assert sorted((r["src_id1"], r["dst_id1"]) for r in newest.edges.collect()) == [("b", "y"), ("c", "y")]
    empty = Graph(*state._nothing())
    assert diff(state.replay(empty, 0), newest).is_empty() and diff(state.replay(newest, state.versions()[-1]), newest).is_empty()
    assert state.log().where(F.col("op") == "remove").count() > 0 and len(state.versions()) == 3
    client = Session(state)
    assert json.loads(client.greet())["type"] == json.loads(client.answer('{"type": "subscribe"}'))["type"] == "snapshot" and client.news() == []
    told = json.loads(client.answer('{"type": "get_neighbors", "key": "U#U(b)"}'))
    assert [n["key"] for n in told["nodes"]] == ["U#U(b)", "T#T(y)"] and len(told["edges"]) == 1
    errors = [json.loads(client.answer(m))["message"] for m in ("no json", '{"type": "what"}', '{"type": "get_neighbors"}', '{"type": "get_neighbors", "key": "U#none"}')]
    assert all(e.startswith("bad message") for e in errors[:3]) and errors[3] == "no node with key U#none"
    assert state.tick(empty, 99) and [json.loads(x)["type"] for x in client.news()] == ["patch"]
    assert not state.tick(empty, 100) and 100 not in state.versions()
    late = Session(state, buffer=0)
    late.seen = -1
    assert [json.loads(x)["type"] for x in late.news()] == ["snapshot"]


def test_stream_query_takes_all_days(spark, tmp_path, monkeypatch):
    from loomgraph import queries

    rows = [(day, user, kind) for day in range(1, 13) for user, kind in ((day % 4, "a"), (day, "b"))]
    events = spark.createDataFrame([(f"2024-01-{d:02} 10:00:00", u, k) for d, u, k in rows], "ts string, user_id bigint, event_type string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    tick = Reconciler.tick

    def watched(self, scan, version):
        seen.append(sorted((r["src_id1"], r["dst_id1"]) for r in scan.edges.collect()))
        return tick(self, scan, version)

    monkeypatch.setattr(Reconciler, "tick", watched)
    last = sorted((r["user_id"], r["event_type"]) for r in queries.stream_reconcile(spark, str(tmp_path)).collect())
    assert seen == [sorted((str(u), k) for d, u, k in rows if d == day) for day in range(1, 13)] and last == seen[-1]
