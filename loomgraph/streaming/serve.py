"""What a client asks of the newest graph, and what it is told: JSON texts in, JSON texts out, without a transport."""

from __future__ import annotations

import json

from ..engine import patch_document, snapshot_document
from ..operators.patch import Patch
from .reconcile import Reconciler


class Session:
    """A client of a reconciled graph. It is sent a snapshot first, then the patches of later versions, at least once each."""

    def __init__(self, state: Reconciler, buffer: int = 256):
        self.state, self.buffer = state, buffer
        known = state.versions()
        self.seen = known[-1] if known else -1  # before the snapshot is taken, so that no patch falls between

    def _snapshot(self) -> str:
        return json.dumps({"type": "snapshot", **json.loads(snapshot_document(self.state.graph()).first()["value"])})

    def greet(self) -> str:
        return self._snapshot()

    def answer(self, message: str) -> str:
        """To subscribe, get_snapshot, and get_neighbors with a key; all else is an error, told to the client."""
        try:
            asked = json.loads(message)
            kind = asked["type"]
            if kind in ("subscribe", "get_snapshot"):
                return self._snapshot()
            if kind != "get_neighbors":
                raise ValueError(f"unknown type {kind}")
            key = asked["key"]
        except (ValueError, KeyError, TypeError) as error:
            return json.dumps({"type": "error", "message": f"bad message: {error}"})
        try:
            nodes, edges = self.state.graph().neighborhood(key)
        except KeyError:
            return json.dumps({"type": "error", "message": f"no node with key {key}"})
        rows = sorted(nodes.collect(), key=lambda r: (r["place"], r["id"]))  # one node's edges
        return json.dumps({"type": "neighbors", "key": key, "nodes": [{c: r[c] for c in ("id", "key", "label", "kind")} for r in rows], "edges": [r.asDict() for r in edges.collect()]})

    def news(self) -> list[str]:
        """The patches since the last call; a snapshot instead if they are more than the buffer holds."""
        new = [v for v in self.state.versions() if v > self.seen]
        if not new:
            return []
        self.seen = new[-1]
        if len(new) > self.buffer:
            return [self._snapshot()]
        log = lambda v: Patch.of_rows(self.state.spark.read.parquet(f"{self.state.folder}/log/v={v}"))
        return [json.dumps({"type": "patch", **json.loads(patch_document(log(v)).first()["value"])}) for v in new]
