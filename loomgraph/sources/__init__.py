from .fixtures import SCHEMAS, fixture_tables, write_fixtures
from .paged import PagedJson
from .replay import read_estate, read_snapshot

__all__ = ["SCHEMAS", "fixture_tables", "write_fixtures", "PagedJson", "read_estate", "read_snapshot"]
