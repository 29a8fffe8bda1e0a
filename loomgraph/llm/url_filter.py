"""URL filters as a sort-merge range join.

A url's key for one of its ancestor hosts (itself, then what follows each dot) is the host with its labels reversed,
a slash, and the path. All urls that a rule fits have, under the rule's own host, keys that begin with the rule's key:
one interval of the sorted keys. Keys and rules are dealt by range to buckets, a rule to every bucket that its interval
meets; in each bucket a sorted sweep keeps the stack of rules that are open (nested prefixes) and the top one wins.

Scale: buckets are cut by (key, salt), so that a hot url or host is spread over buckets; the only things the driver
sees are the cut points, at most SAMPLES per partition. Pages that agree in id and url are swept once and counted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, table

#: (verdict, host, path) of the production rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"
SAMPLES = 20
LAST = "\U0010ffff"
URL_ROW = "key string, salt int, page_id bigint, url string, bucket int, kind int, rule string, verdict string, length int, host_length int"


def split_url(url):
    """(host, path) columns; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def reversed_key(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + "/" + path


def _deal_urls(cuts: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            keys = [reversed_key(h, p) for h, p in zip(x["ancestor"], x["path"])]
            n = len(keys)
            out = {
                "key": keys, "salt": x["salt"], "page_id": x["page_id"], "url": x["url"],
                "bucket": [bisect_right(cuts, k) for k in zip(keys, x["salt"])], "kind": [1] * n,
                "rule": [None] * n, "verdict": [None] * n, "length": [0] * n, "host_length": [0] * n,
            }
            yield pa.RecordBatch.from_pydict(out, schema=ROW)

    return run


def _deal_rules(cuts: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = reversed_key(r["host"], r["path"])
                first, last = bisect_right(cuts, (key, -1)), bisect_right(cuts, (key + LAST, 1 << 31))
                out += [{"key": key, "salt": -1, "page_id": None, "url": None, "bucket": k, "kind": 0, "rule": r["host"] + r["path"], "verdict": r["verdict"], "length": len(r["host"] + r["path"]), "host_length": len(r["host"])} for k in range(first, last + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=ROW)

    return run


ROW = pa.schema([("key", pa.string()), ("salt", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("rule", pa.string()), ("verdict", pa.string()), ("length", pa.int32()), ("host_length", pa.int32())])
HIT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("length", pa.int32()), ("host_length", pa.int32())])
HIT_ROW = "page_id bigint, url string, rule string, verdict string, length int, host_length int"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key, kind, verdict): rules open before the urls that they cover."""
    stack: list[tuple] = []
    bucket = None
    for b in batches:
        out = []
        for key, page, url, at, kind, rule, verdict, length, hl in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "url", "bucket", "kind", "rule", "verdict", "length", "host_length"))):
            if at != bucket:
                bucket, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict, length, hl))
            elif stack:
                out.append((page, url, *stack[-1][1:]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), HIT)] if out else [pa.array([], type=f.type) for f in HIT], schema=HIT)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of pages (page_id, url; other columns are left out).

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the longest
    host + path wins, between equally long ones that of the longer host, between equal ones block. No rule: rule is null
    and the verdict default. Rows with a null or odd url have an empty host and path, which no rule fits; null ids and
    repeated rows are kept; rules with a null in host or path fit nothing; empty tables give empty results.
    """
    spark, p = pages.sparkSession, partitions(pages.sparkSession)
    host, path = split_url(F.col("url"))
    urls = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies")).select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select("host", "path", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    labels = F.split("host", r"\.", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.where("host <> ''").select("page_id", "url", "path", F.explode(F.array_distinct(ancestors)).alias("ancestor"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)).cast("int").alias("salt"))
    keys = keys.join(rules.select(F.col("host").alias("ancestor")).distinct(), "ancestor", "left_semi")
    sample = keys.orderBy(F.xxhash64("salt", "ancestor"), "url").limit(SAMPLES * p).select("ancestor", "path", "salt").collect()
    points = sorted((reversed_key(r.ancestor, r.path), r.salt) for r in sample)
    cuts = points[SAMPLES :: SAMPLES] if len(points) > SAMPLES else []
    dealt = keys.mapInArrow(_deal_urls(cuts), URL_ROW).unionByName(rules.mapInArrow(_deal_rules(cuts), URL_ROW))
    hits = dealt.repartition(p, "bucket").sortWithinPartitions("bucket", "key", "kind", "verdict").mapInArrow(sweep, HIT_ROW)
    best = F.max(F.struct("length", "host_length", F.col("verdict").alias("v"), F.col("rule").alias("r")))
    none = urls.select("page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias("length"), F.lit(-1).alias("host_length"), "copies")
    found = none.unionByName(hits.withColumn("copies", F.lit(0).cast("bigint"))).groupBy("page_id", "url").agg(best.alias("b"), F.sum("copies").alias("copies"))
    host, path = split_url(F.col("url"))
    out = found.select("page_id", "url", host.alias("host"), path.alias("path"), F.col("b.r").alias("rule"), F.col("b.v").alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(verdict, rh, rp) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
rest AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT rid, page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM rest),
fit AS (SELECT rid, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON f.rid = p.rid AND f.k = 1
"""
