"""Line dedup: sharded cuckoo filters in front of exact reference counts, reversible.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased; keys of at least MIN_CHARS code
points count. A key found in two documents or more loses its lines in all but the document with the smallest id.

State (class LineIndex): `filters`, one cuckoo filter per shard of key hashes; `counts`, one row per key with its number
of lines and the smallest and largest document that holds it; `log`, one row per document and key. Filters say of most
new keys that they are surely new, so that only the others meet the exact counts. Deleting documents takes their lines
out of the counts and keys without lines out of the filters; a key whose keeper goes is given the next one. clean() drops
from texts what the state says of their lines now; dedup_lines() puts documents into a new state and cleans them by it.

Scale: a document sends each of its keys once, and these are summed on each task before the shuffle, so a line that a third
of all documents share costs its shard a row per task. To clean, documents are dealt to blocks of about BLOCK_BYTES by a hash,
and each block asks for each of its keys once; a block's texts are shuffled once and meet the answers in a co-grouped
pass. Keys are 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, chunks, cut, partitions, table
from .cuckoo import CuckooFilter

MIN_CHARS = 10
#: Text of one block, and keys of one shard, about; there are at least as many of both as there are shuffle partitions.
BLOCK_BYTES, SHARD_KEYS = 8 << 20, 1 << 18
FLUSH_LINES = 1 << 20
#: A null document id counts as one document, that of the largest id there can be.
NO_ID = (1 << 63) - 1
KEY = pa.schema([("shard", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("lines", pa.int64())])
KEY_ROW = "shard int, h1 bigint, h2 bigint, doc_id bigint, lines bigint"
ASKED_ROW = "block int, h1 bigint, h2 bigint"


def line_keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(all lines, the row of each, which are long enough to count, the two halves of those keys' hashes)."""
    lists = pc.split_pattern(pc.cast(pc.fill_null(texts, ""), pa.large_string()), "\n")
    lines, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=SPACES))
    counts = pc.greater_equal(pc.utf8_length(keys), MIN_CHARS).to_numpy(zero_copy_only=False)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(k) for k in keys.filter(pa.array(counts)).to_pylist()])
    return lines, row, counts, np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.astype(np.uint64) % np.uint64(shards)).astype(np.int32)


def _document_keys(shards: int):
    """Each key once for each row of documents, with its number of lines there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            _, row, counts, h = line_keys(b.column("text"))
            row = row[counts]
            order = np.lexsort((h[:, 1], h[:, 0], row))
            row, h1, h2 = row[order], h[order, 0], h[order, 1]
            at = starts_of(row, h1, h2)
            doc = pc.fill_null(b.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)[row[at]]
            cols = [shard_of(h1[at], shards), h1[at], h2[at], doc, np.diff(np.append(at, len(row)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, KEY)], schema=KEY)

    return run


def _asked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key once per block, as far as FLUSH_LINES lines at a time go."""

    def flush(parts: list) -> pa.RecordBatch:
        block, h1, h2 = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((h2, h1, block))
        block, h1, h2 = block[order], h1[order], h2[order]
        at = starts_of(block, h1, h2)
        return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), pa.array(h1[at]), pa.array(h2[at])], names=["block", "h1", "h2"])

    parts, n = [], 0
    for b in chunks(batches, "text"):
        _, row, counts, h = line_keys(b.column("text"))
        if len(h):
            parts.append((b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)[row[counts]], h[:, 0], h[:, 1]))
            n += len(h)
        if n > FLUSH_LINES:
            yield flush(parts)
            parts, n = [], 0
    if parts:
        yield flush(parts)


def drop_lines(docs: pa.Table, drops: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of docs without the lines whose key is in drops, unless the row is the key's keeper."""
    order = np.lexsort((drops.column("h2").to_numpy(), drops.column("h1").to_numpy()))
    d1, d2, keep = (drops.column(c).to_numpy()[order] for c in ("h1", "h2", "keep_doc"))
    for b in chunks(docs.to_batches(), "text"):
        lines, row, counts, h = line_keys(b.column("text"))
        ids = pc.fill_null(b.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
        gone = np.zeros(len(row), dtype=bool)
        if len(d1) and len(h):
            at = np.searchsorted(d1, h[:, 0])
            hit = np.zeros(len(h), dtype=bool)
            while True:  # keys that share a first half lie next to each other
                ok = at < len(d1)
                same = ok & (d1[np.where(ok, at, 0)] == h[:, 0])
                found = same & (d2[np.where(ok, at, 0)] == h[:, 1])
                hit[found] = keep[at[found]] != ids[row[counts]][found]
                at = np.where(same & ~found, at + 1, len(d1))
                if not (same & ~found).any():
                    break
            gone[counts] = hit
        n_lines, n_gone = np.bincount(row, minlength=b.num_rows), np.bincount(row[gone], minlength=b.num_rows)
        text = pc.cast(pc.fill_null(b.column("text"), ""), pa.large_string())
        changed = np.flatnonzero(n_gone)
        if len(changed):
            begin = np.concatenate([[0], np.cumsum(n_lines)])
            new = ["\n".join(lines.slice(begin[k], n_lines[k]).filter(pa.array(~gone[begin[k] : begin[k + 1]])).to_pylist()) for k in changed]
            text = pc.replace_with_mask(text, pa.array(n_gone > 0), pa.array(new, pa.large_string()))
        made = {"text": text.cast(pa.string()), "n_lines": pa.array(n_lines.astype(np.int64)), "n_dropped": pa.array(n_gone.astype(np.int64))}
        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any other columns) with repeated lines gone from text, and n_lines (before), n_dropped.

    Null or empty texts are one empty line and come back empty. Null ids count as one document that comes last. Rows with
    the same id are one document. Columns named n_lines or n_dropped are replaced; empty tables give empty results.
    """
    return LineIndex(docs.sparkSession).insert(docs).clean(docs)


class LineIndex:
    """The reversible state: insert(documents) and delete(ids) give new states, clean(documents) their texts by this one.

    Tables are written to the shared checkpoint folder at each step. doc_id null counts as NO_ID. The number of shards is
    chosen by the first documents, unless given.
    """

    def __init__(self, spark: SparkSession, shards: int | None = None):
        self.spark, self.shards, self.empty = spark, shards, True
        self.filters = spark.createDataFrame([], "shard int, filter binary, room bigint")
        self.log = spark.createDataFrame([], KEY_ROW)
        self.counts = spark.createDataFrame([], "shard int, h1 bigint, h2 bigint, first_doc bigint, last_doc bigint, lines bigint")

    def _next(self, filters: DataFrame, log: DataFrame, counts: DataFrame, shards: int | None = None) -> LineIndex:
        out = LineIndex(self.spark, shards or self.shards)
        out.filters, out.log, out.counts, out.empty = cut(filters), log, cut(counts), False
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those whose ids are in the index already are left out, and nothing of them is counted twice."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        shards = self.shards or max(partitions(self.spark), -(-_size(rows) // (64 * SHARD_KEYS)))  # a line of some 64 bytes
        each = rows.mapInArrow(_document_keys(shards), KEY_ROW)
        if not self.empty:
            each = each.join(self.log.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEY.names)
        log = cut(each)  # rows with one id are one document, whose keys may come more than once here
        new = log.groupBy("shard", "h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("lines").alias("lines"))
        shape = "shard int, h1 bigint, h2 bigint, first_doc bigint, last_doc bigint, lines bigint, held boolean, filter binary, room bigint"
        if self.empty:
            told = cut(new.withColumn("old", F.lit(False)).groupBy("shard").applyInArrow(_fill_shard, shape))
            counts = told.where("filter IS NULL").select(*COUNTS)
            return self._next(told.where("filter IS NOT NULL").select("shard", "filter", "room"), log, counts, shards)
        # a filter without room for the new keys is built anew, twice as large, from the exact counts of its shard
        full = self.filters.join(new.groupBy("shard").count(), "shard").where("count > room").select("shard")
        before = self.counts.join(full, "shard", "left_semi")
        new = new.withColumn("old", F.lit(False)).unionByName(before.withColumn("old", F.lit(True)))
        told = cut(self.filters.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_insert_shard, shape))
        rows = told.where("filter IS NULL")
        known, sure = rows.where("held").select(*COUNTS), rows.where("NOT held").select(*COUNTS)
        old = self.counts.join(known.select("h1", "h2"), ["h1", "h2"], "left_semi")
        rest = self.counts.join(known.select("h1", "h2"), ["h1", "h2"], "left_anti")
        merged = old.unionByName(known).groupBy("shard", "h1", "h2").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("lines").alias("lines"))
        return self._next(told.where("filter IS NOT NULL").select("shard", "filter", "room"), self.log.unionByName(log), rest.unionByName(merged).unionByName(sure))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents (a column doc_id) out again; ids that are not in the index do nothing."""
        ids = ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id")).distinct()
        log = cut(self.log.join(ids, "doc_id", "left_anti").select(*KEY.names))
        touched = cut(self.log.join(ids, "doc_id", "left_semi").select("shard", "h1", "h2").distinct())
        left = log.join(touched, ["shard", "h1", "h2"], "left_semi").groupBy("shard", "h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("lines").alias("lines"))
        left = cut(left)
        gone = touched.join(left, ["shard", "h1", "h2"], "left_anti")
        filters = self.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_delete_shard, "shard int, filter binary, room bigint")
        counts = self.counts.join(touched.select("h1", "h2"), ["h1", "h2"], "left_anti").select(*COUNTS).unionByName(left.select(*COUNTS))
        return self._next(filters, log, counts)

    def repeated(self) -> DataFrame:
        """h1, h2, keep_doc of the keys that two documents or more hold."""
        return self.counts.where("first_doc <> last_doc").select("h1", "h2", F.col("first_doc").alias("keep_doc"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text, any other columns) without the lines that the index gives to another document, with n_lines
        (before) and n_dropped, as dedup_lines() states."""
        from pyspark.sql.pandas.types import to_arrow_schema

        plain = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("bigint"))
        p, names = partitions(self.spark), plain.columns
        n = max(p, -(-_size(plain) // BLOCK_BYTES))
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias(BLOCK)
        blocks = plain.select(*names, block).repartition(p, F.col(BLOCK))
        asked = blocks.select("text", BLOCK).mapInArrow(_asked_keys, ASKED_ROW)
        answers = asked.join(self.repeated(), ["h1", "h2"]).select("block", "h1", "h2", "keep_doc")
        out = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        schema = to_arrow_schema(out)

        def apply(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches(drop_lines(left, right, schema), schema=schema)

        return blocks.groupBy(BLOCK).cogroup(answers.groupBy("block")).applyInArrow(apply, out)


COUNTS = ["shard", "h1", "h2", "first_doc", "last_doc", "lines"]
#: The column of a row's block while texts meet the answers; docs must not have one of this name.
BLOCK = "__line_dedup_block"


def _size(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


STATE = pa.schema([("shard", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("lines", pa.int64()), ("held", pa.bool_()), ("filter", pa.binary()), ("room", pa.int64())])


def _fill_shard(new: pa.Table) -> pa.Table:
    """_insert_shard() where there is no filter yet."""
    return _insert_shard(pa.table({"shard": [], "filter": [], "room": []}), new)


def _insert_shard(old: pa.Table, new: pa.Table) -> pa.Table:
    """The new keys with what the filter said of each, and a row with the filter that now holds them too."""
    if not new.num_rows:
        shard, filt = old.column("shard")[0].as_py(), CuckooFilter.from_bytes(old.column("filter")[0].as_py())
        rows = STATE.empty_table()
    else:
        shard = new.column("shard")[0].as_py()
        before = new.filter(new.column("old"))
        new = new.filter(pc.invert(new.column("old")))
        if before.num_rows or not old.num_rows:
            filt = CuckooFilter(2 * (before.num_rows + new.num_rows))
            filt.add(np.unique(before.column("h1").to_numpy().astype(np.uint64)))
        else:
            filt = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
        keys, back = np.unique(new.column("h1").to_numpy().astype(np.uint64), return_inverse=True)
        held = filt.insert(keys)
        filt.add(keys[held])  # each key has a print of its own, so that deleting one never hides another
        n = new.num_rows
        cols = [new.column(c).combine_chunks().cast(STATE.field(c).type) for c in STATE.names[:6]]
        rows = pa.table([*cols, pa.array(held[back]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=STATE)
    state = [pa.array([shard], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.bool_()), pa.array([filt.to_bytes()], pa.binary()), pa.array([filt.room()], pa.int64())]
    return pa.concat_tables([rows, pa.table(state, schema=STATE)])


def _delete_shard(old: pa.Table, gone: pa.Table) -> pa.Table:
    filt = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(1)
    if gone.num_rows:
        filt.delete(np.unique(gone.column("h1").to_numpy().astype(np.uint64)))
    shard = (old if old.num_rows else gone).column("shard")[0].as_py()
    return pa.table([pa.array([shard], pa.int32()), pa.array([filt.to_bytes()], pa.binary()), pa.array([filt.room()], pa.int64())], names=["shard", "filter", "room"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM rows),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
many AS (SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, (keep IS NOT NULL AND keep <> doc_id) AS gone FROM keyed LEFT JOIN many USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
