"""A Python data source for paged JSON collections.

Options: `path`, a folder with a folder for each scope (region, project, zone) in which `first.json` is the first page and
`<token>.json` those that follow; `items`, the field with the rows; `inner`, for pages whose items are a map of scopes, the
field of each with the rows; `token`, the field with the next page's name (default nextPageToken); `pushable`, a column whose
equality and IN filters are applied while reading, without case; `pages` and `limit`, the most pages and rows that are read of
a scope. A page with a `status` other than 2xx or with
`success: false` is an error; with `tolerant` such a scope is empty. Each scope is a partition; rows are JSON texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


def register(spark) -> None:
    """Makes the source known to a session, filter pushdown of Python sources included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        pushable = self.options.get("pushable")
        return "scope string, row string" + (f", {pushable} string" if pushable else "")

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        column = self.options.get("pushable")
        for f in filters:
            if column and isinstance(f, (EqualTo, In)) and f.attribute == (column,):
                values = f.value if isinstance(f, In) else [f.value]
                new = {str(v).lower() for v in values}
                self.wanted = new if self.wanted is None else self.wanted & new
            yield f  # letter case may differ, so Spark still looks

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.name) for p in sorted(Path(self.options["path"]).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        column = self.options.get("pushable")
        try:
            rows = list(self._rows(partition.value)) if self.options.get("tolerant") == "true" else self._rows(partition.value)
        except RuntimeError:
            return
        for row in rows:
            kind = row.get(column) if column else None
            if self.wanted is None or str(kind).lower() in self.wanted:
                yield (partition.value, json.dumps(row), *([kind] if column else []))

    def _rows(self, scope: str) -> Iterator[dict]:
        limit = self.options.get("limit")
        return islice(self._all_rows(scope), int(limit) if limit else None)

    def _all_rows(self, scope: str) -> Iterator[dict]:
        token, seen = "first", set()
        most = int(self.options.get("pages", 0))
        while token and not (most and len(seen) == most):
            if token in seen:
                raise RuntimeError(f"{scope}: page {token} names itself again")
            seen.add(token)
            page = json.loads(Path(self.options["path"], scope, f"{token}.json").read_text())
            status = int(page.get("status", 200))
            if not 200 <= status < 300 or page.get("success") is False:
                raise RuntimeError(f"{scope}: page {token} failed with {status}")
            items = page.get(self.options.get("items", "items")) or []
            if inner := self.options.get("inner"):
                items = [row for group in items.values() for row in group.get(inner) or []]
            yield from items
            token = page.get(self.options.get("token", "nextPageToken"))
