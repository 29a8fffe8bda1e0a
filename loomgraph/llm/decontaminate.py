"""Benchmark decontamination with an FM-index per shard of the documents.

A window is WINDOW consecutive words of a benchmark item (all of a shorter one). A shard is a chunk of documents: their
words become numbers of the benchmark's vocabulary, stretches that no window can reach (runs of known words shorter than
the shortest window) shrink to a separator, and an FM-index is built over the rest. All windows are searched backwards
at once through wavelet-tree ranks, their occurrences located by sampled suffix positions and merged to spans.

Scale: no shuffle of the documents. The benchmark is sent to the tasks in blocks of at most BLOCK_WORDS words, each a pass
of its own over what the pass before yields. After PASSES of them the documents are written to the shared folder and the
blocks sent are given up, so that neither plan, driver nor tasks hold more than so many blocks of a benchmark of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, chunks, cut, runs, string_views, table, text_buffer
from .fm_index import FMIndex

WINDOW = 10
BLOCK_WORDS, PASSES = 200_000, 8
#: byte -> lower-cased byte of a word, or 0: digits, letters and all bytes of other characters than ASCII
WORD_BYTES = LOWER_BYTES.copy()
WORD_BYTES[[b for b in range(128) if not (48 <= b <= 57 or 97 <= LOWER_BYTES[b] <= 122)]] = 0
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with 0 between words, text offsets, starts, ends of all words)."""
    data, offsets = text_buffer(texts)
    low = WORD_BYTES[data]
    starts, ends = runs(low != 0, offsets)
    return low, offsets, starts, ends


class Windows:
    """The windows of some items: vocabulary, patterns (numbers from 1 on), and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for k in range(max(1, len(ids) - size + 1)) if ids else ():
                found.setdefault(tuple(ids[k : k + size]), set()).update([name] if name is not None else [])
        self.vocabulary = pa.array(list(vocabulary), pa.binary())
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), size), dtype=np.int32)
        for row, w in enumerate(found):
            self.patterns[row, : len(w)] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lengths.min(initial=size))


def search_chunk(texts: pa.Array, w: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: number of words, byte spans of hit words (runs of them, merged), items with occurring windows."""
    low, offsets, starts, ends = words_of(texts)
    n = len(offsets) - 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(owner, minlength=n)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if not len(w.lengths) or not len(starts):
        return n_words, spans, items
    words = string_views(low, starts, ends).cast(pa.large_binary())
    ids = pc.fill_null(pc.index_in(words, value_set=w.vocabulary.cast(pa.large_binary())), -1).to_numpy().astype(np.int64) + 1
    first = np.searchsorted(owner, np.arange(n + 1))
    a, b = runs(ids > 0, first)
    long = b - a >= w.shortest
    a, b = a[long], b[long]
    if not len(a):
        return n_words, spans, items
    size = b - a + 1  # a separator after each run
    begin = np.cumsum(size) - size
    word = np.arange(size.sum()) - np.repeat(begin - a, size)  # place in the sequence -> word
    sequence = ids[np.minimum(word, len(ids) - 1)]
    sequence[begin + size - 1] = 0
    index = FMIndex(sequence)
    lo, hi = index.search(w.patterns, w.lengths)
    hit = np.flatnonzero(hi > lo)
    count = hi[hit] - lo[hit]
    if not len(hit):
        return n_words, spans, items
    rows = np.repeat(lo[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = word[index.locate(rows)]
    which = np.repeat(hit, count)
    for text, k in np.unique(np.stack([owner[at], which]), axis=1).T.tolist():
        items[text].update(w.items[k])
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + w.lengths[which], -1)
    s, e = runs(np.cumsum(edge[:-1]) > 0, first)
    for text, x, y in zip(owner[s].tolist(), s.tolist(), e.tolist()):
        spans[text].append((x, y))
    return n_words, spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(shared, schema: pa.Schema, first_pass: bool):
    """Adds what these windows hit: __words (number), __hits (word spans within the text), __items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in chunks(batches, "text"):
            n_words, spans, items = search_chunk(b.column("text"), w)
            base = np.cumsum(n_words) - n_words
            hits = [[(x - o, y - o) for x, y in s] for s, o in zip(spans, base.tolist())]
            if not first_pass:
                hits = [merge(h + [(x["start"], x["end"]) for x in old]) for h, old in zip(hits, b.column("__hits").to_pylist())]
                items = [i | set(old) for i, old in zip(items, b.column("__items").to_pylist())]
            made = {"__words": pa.array(n_words.astype(np.int64)), "__hits": pa.array([[{"start": x, "end": y} for x, y in h] for h in hits], FOUND), "__items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def _cut_spans(schema: pa.Schema):
    """__spans: code points from the first hit word of a span to its last; __clean: the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            hits = b.column("__hits").to_pylist()
            clean = pc.fill_null(b.column("text"), "").to_pylist()
            spans: list[list[dict]] = [[] for _ in hits]
            for k in (k for k, h in enumerate(hits) if h):
                text = clean[k]
                raw = text.encode()
                _, _, starts, ends = words_of(pa.array([text], pa.string()))
                bounds = [(int(starts[h["start"]]), int(ends[h["end"] - 1])) for h in hits[k]]
                spans[k] = [{"start": len(raw[:x].decode()), "end": len(raw[:y].decode())} for x, y in bounds]
                kept, at = [], 0
                for s in spans[k]:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                clean[k] = "".join([*kept, text[at:]])
            made = {"__spans": pa.array(spans, FOUND), "__clean": pa.array(clean, pa.string())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def benchmark_blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Windows]:
    """Windows of the items, at most block_words words (or one item) at a time; the driver sees one block at a time."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").orderBy("item").toLocalIterator():
        low, _, starts, ends = words_of(pa.array([r["text"]], pa.string()))
        words = [low[a:b].tobytes() for a, b in zip(starts, ends)]
        if block and n + len(words) > block_words:
            yield Windows(block, size)
            block, n = [], 0
        block.append((r["item"], words))
        n += len(words)
    yield Windows(block, size)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = True) -> DataFrame:
    """docs (doc_id, text, any other columns) with __words, __hits (spans of hit words), __items and, if clean, __spans, __clean.

    Null and empty texts have no words; items without words have no windows; windows of items with a null id hit words
    but name no item; items with the same id are one. Repeated rows and null ids are kept, an empty benchmark hits
    nothing. Texts of any length are searched whole. Columns with those five names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = docs.drop("__words", "__hits", "__items", "__spans", "__clean")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    shape = T.StructType([*plain.schema.fields, T.StructField("__words", T.LongType()), T.StructField("__hits", spans), T.StructField("__items", T.ArrayType(T.StringType()))])
    whole = T.StructType([*shape.fields, T.StructField("__spans", spans), T.StructField("__clean", T.StringType())])
    arrow = lambda s: to_arrow_schema(s)
    out, sent = plain, []
    for n, w in enumerate(benchmark_blocks(benchmark, size, block_words)):
        if sent and n % PASSES == 0:
            out = cut(out)
            while sent:
                sent.pop().destroy()
        sent.append(docs.sparkSession.sparkContext.broadcast(w))  # at most block_words words
        out = out.mapInArrow(_pass(sent[-1], arrow(shape), n == 0), shape)
    return out.mapInArrow(_cut_spans(arrow(whole)), whole) if clean else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), clean=False)
    hit = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.sort_array("__items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
grams AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
occ AS (SELECT rid, item, i, pat.n FROM grams JOIN pat ON grams.p = pat.p AND grams.n = pat.n),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM occ) GROUP BY rid),
who AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN who USING (rid)
"""
