"""The near-duplicate stage: SimHash candidates by covering hashing, confirmed on word shingles.

Documents of one set of WIDTH-word shingles are one node (texts without words are one too). A node's fingerprint is the
SimHash of its distinct PRINT_WIDTH-word shingles, which stands nearer to that of a near copy than one of longer shingles
does. Nodes within RADIUS differing bits, equal fingerprints included, are candidates; the covering masks of two halves of
the bits (RADIUS // 2 differing bits in one of them) guarantee each such pair. A candidate is kept if the two texts share
at least SIMILARITY of their shingles (Jaccard). The first candidates are thin links, so that a group of copies of any size
gives few more of them than it has nodes. Where these left pairs out, the nodes' sketches (a bit for each shingle, a byte of them
for a shingle) are dealt to the tables' buckets, and all pairs there that confirmed links do not join already are held
against the most that their sketches let them share. Only nodes of pairs that may be alike then go to these buckets with
their shingle sets, to be compared. Components keep their smallest id.

Scale: texts are read where they lie for a digest and a fingerprint; they are shuffled by id once for the shingle sets of
nodes with candidates, as sorted 64-bit hashes, and once to keep the rows that stay. Links are compared in a join whose keys
are nodes; no step gives a row for each pair of a bucket, and large buckets are compared in blocks by several tasks. Nothing
is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, cut, partitions, release, sweep
from .components import connected_components
from .simhash import covering_masks, majority, near_links, shingle_hashes, signed, unmet

RADIUS, PARTS, PRINT_WIDTH, WIDTH, SIMILARITY = 9, 2, 2, 5, 0.8
#: Rows of two shingle sets that a task compares at a time.
PAIR_ROWS = 256
#: Sets that a task holds of one bucket: so many, of so many shingles in all. Larger buckets are split.
HELD_SETS, HELD_SHINGLES = 4096, 4 << 20
#: Bytes of the smallest sketch.
SKETCH = 64
#: What a row of a bucket is for: kept, kept and compared with those before it, compared only.
KEPT, BOTH, PASSING = 0, 1, 2


def distinct(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each group (h[group[g]:group[g + 1]]), and where each group's begin."""
    owner = np.repeat(np.arange(len(group) - 1), np.diff(group))
    order = np.lexsort((h, owner))
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(group) - 1))])


def shingle_sets(texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """(128-bit digests, sorted distinct shingles as bytes) of all texts."""
    h, at = distinct(*shingle_hashes(texts, WIDTH))
    sets = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    return [blake2b(s, digest_size=16).digest() for s in sets], sets


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash fingerprints of the distinct shingles of PRINT_WIDTH words."""
    return majority(*distinct(*shingle_hashes(texts, PRINT_WIDTH)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text", CHUNK_BYTES // 2):
        digests, sets = shingle_sets(b.column("text"))
        size = np.array([len(s) // 8 for s in sets], np.int32)
        fp = fingerprints(b.column("text")).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(fp), pa.array(size)], names=["doc_id", "digest", "fp", "size"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text", CHUNK_BYTES // 2):
        digests, sets = shingle_sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of 64-bit hashes; two empty sets are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _confirm(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                b = batch.slice(at, PAIR_ROWS)
                ok = [jaccard(x, y) >= least for x, y in zip(b.column("su").to_pylist(), b.column("sv").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, shingles for the nodes in ends, from the texts of the documents that stand for them."""
    wanted = nodes.join(ends, "node", "left_semi").select("node", "digest", "doc_id")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    made = texts.mapInArrow(_shingle_rows, "digest binary, shingles binary")
    found = made.join(wanted.select("node", "digest").hint("shuffle_hash"), "digest").select("node", "shingles")
    return cut(found)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v: nodes) whose texts are alike enough."""
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")).join(pairs.hint("shuffle_hash"), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    return cut(both.select("u", "v", "su", "sv").mapInArrow(_confirm(similarity), "u bigint, v bigint").distinct())


def _labelled(nodes: DataFrame, sure: DataFrame) -> DataFrame:
    labels = connected_components(sure)
    return cut(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_components(nodes: DataFrame, docs: DataFrame, radius: int, similarity: float) -> DataFrame:
    """nodes (node, digest, fp, size, doc_id) with label: components of all pairs within radius bits and of the similarity.

    Thin links that sketches allow are confirmed first; nodes with further pairs are then compared in their buckets. docs has
    one text for each doc_id of nodes, or more, one of which has the digest.
    """
    slim = nodes.select("node", "fp", "size")
    heads = cut(slim.groupBy("fp").agg(F.min("node").alias("head")))
    found = cut(near_links(heads.select("fp"), radius, kind="open", parts=PARTS).distinct())
    near = cut(_ordered(found.where("u <> v")))
    stars = slim.join(heads, "fp").where("node <> head").select("node", "head")
    faced = near.select(F.col("u").alias("fp")).union(near.select(F.col("v").alias("fp"))).distinct().join(heads, "fp").select(F.col("head").alias("node"))
    ends = cut(faced.union(stars.select("node")).union(stars.select("head")).distinct())
    sets = _sets_of(ends, nodes, docs)  # every later pair is of these nodes too
    sketches = cut(sets.mapInArrow(_sketch_rows, "node bigint, shingles binary"))
    known = sketches.join(slim.hint("shuffle_hash"), "node")
    side = lambda key, name: known.select(F.col(key).alias(name), F.col("node").alias(f"node_{name}"), F.col("size").alias(f"size_{name}"), F.col("shingles").alias(f"sketch_{name}"))
    first = known.join(heads.select(F.col("head").alias("node")), "node", "left_semi")
    head = lambda name: first.select(F.col("fp").alias(name), F.col("node").alias(f"node_{name}"), F.col("size").alias(f"size_{name}"), F.col("shingles").alias(f"sketch_{name}"))
    thin = near.join(head("u"), "u").join(head("v"), "v").select(*LINK_ROW)
    spokes = stars.select(F.col("node").alias("u"), F.col("head").alias("v")).join(side("node", "u"), "u").join(side("node", "v"), "v").select(*LINK_ROW)
    sweep(nodes.sparkSession)
    able = cut(thin.unionByName(spokes).mapInArrow(_able(similarity), "u bigint, v bigint"))
    sure = _confirmed(able, sets, similarity)
    labelled = _labelled(nodes, sure)
    sweep(nodes.sparkSession)
    several = cut(slim.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    beside = [near.join(several.withColumnRenamed("fp", a), a, "left_semi").select(F.col(b).alias("fp")) for a, b in (("u", "v"), ("v", "u"))]
    untold = found.where("u = v").select(F.col("u").alias("fp")).union(several).union(beside[0]).union(beside[1]).distinct()
    members = cut(labelled.join(untold, "fp", "left_semi").select("node", "fp", "size", "label"))
    if members.isEmpty():
        return labelled
    sweep(nodes.sparkSession)
    dealt = cut(_dealt(members, radius))
    sweep(nodes.sparkSession)
    open_ = cut(_met(dealt, sketches, _may_meet(radius, similarity), radius, "mask bigint, node bigint"))
    if open_.isEmpty():
        return labelled
    met = dealt.join(open_.distinct().hint("shuffle_hash"), ["mask", "node"], "left_semi")
    more = cut(_met(met, sets, _meet(radius, similarity), radius, "u bigint, v bigint").distinct())
    return labelled if more.isEmpty() else _labelled(nodes, sure.unionByName(more))


def _tables(radius: int) -> np.ndarray:
    return np.array([signed(m) for m in covering_masks(radius, PARTS)])


def _dealt(members: DataFrame, radius: int) -> DataFrame:
    """mask, key, node, fp, size, label, part, side: members (node, fp, size, label) in all buckets that hold several labels.

    In a bucket, nodes of labels other than the most frequent one are the minor ones, and each pair has one of them. A small
    bucket is one part; of a larger one each part keeps a block of the minor nodes, and a block of all passes by.
    """
    masked = members.withColumn("mask", F.explode(F.array(*map(F.lit, _tables(radius).tolist())))).withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
    each = masked.groupBy("mask", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    mixed = each.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("major"))
    blocks = lambda n, s: F.ceil(F.greatest(n / F.lit(HELD_SETS), s / F.lit(HELD_SHINGLES), F.lit(1))).cast("int")
    whole = (F.col("n") <= HELD_SETS) & (F.col("s") <= HELD_SHINGLES)
    mixed = cut(mixed.where("labels > 1").select("mask", "key", "major.label", whole.alias("whole"), blocks(F.col("n") - F.col("major.n"), F.col("s") - F.col("major.s")).alias("a"), blocks(F.col("n"), F.col("s")).alias("b")).withColumnRenamed("label", "major"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    role = lambda part, side: F.struct(part.cast("int").alias("part"), F.lit(side).alias("side"))
    kept = F.when(F.col("label") != F.col("major"), F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: role(block("a") * F.col("b") + j, KEPT))).otherwise(F.array().cast("array<struct<part:int,side:int>>"))
    passing = F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: role(i * F.col("b") + block("b"), PASSING))
    roles = F.when(F.col("whole"), F.array(role(F.lit(0), BOTH))).otherwise(F.concat(kept, passing))
    columns = ["mask", "key", "node", "fp", "size", "label"]
    return masked.join(mixed, ["mask", "key"]).select(*columns, F.explode(roles).alias("r")).select(*columns, "r.part", "r.side")


def _met(dealt: DataFrame, held: DataFrame, meet, radius: int, shape: str) -> DataFrame:
    """What meet makes of the rows of dealt, each with what held (node, shingles) has of its node, bucket part by part."""
    rows = held.join(dealt.hint("shuffle_hash"), "node").select(*BUCKET_ROW)
    order = ["mask", "key", "part"]
    return rows.repartition(partitions(held.sparkSession), *order).sortWithinPartitions(*order, "side").mapInArrow(meet, shape)


LINK_ROW = ["node_u", "node_v", "size_u", "size_v", "sketch_u", "sketch_v"]
BUCKET_ROW = ["mask", "key", "part", "side", "node", "fp", "size", "label", "shingles"]


def sketch(shingles: bytes) -> bytes:
    """A bit for each of the hashes, of at least eight for each of them, by its last bits."""
    h = np.frombuffer(shingles, np.uint64)
    bits = 8 * SKETCH
    while bits < 8 * len(h):
        bits *= 2
    out = np.zeros(bits, dtype=np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([sketch(x) for x in b.column("shingles").to_pylist()], pa.binary())], names=["node", "shingles"])


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (n, w) as those of fewer words: w / words parts laid on each other."""
    n, w = sketches.shape
    return sketches if w == words else np.bitwise_or.reduce(sketches.reshape(n, w // words, words), axis=1)


def may_be_alike(some: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int, least: float) -> np.ndarray:
    """Whether sets with these sketches can have a Jaccard similarity of least: each bit that one lacks is a shingle it lacks."""
    words = min(some.shape[1], one.shape[1])
    a, b = folded(some, words), folded(one, words)
    without = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    shared = np.minimum(sizes - without(a & ~b), size - without(b & ~a))
    return shared >= least * (sizes + size - shared) - 1e-6


def _able(least: float):
    """u, v: the links whose sketches and sizes allow a similarity of least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, PAIR_ROWS) for batch in batches for at in range(0, batch.num_rows, PAIR_ROWS)):
            ok = []
            for m, n, x, y in zip(*(b.column(c).to_pylist() for c in LINK_ROW[2:])):
                x, y = (np.frombuffer(z, np.uint64)[None] for z in (x, y))
                near = min(m, n) >= least * max(m, n) - 1e-6  # or their Jaccard similarity is less
                ok.append(near and bool(may_be_alike(x, np.array([m]), y, n, least)[0]))
            yield pa.RecordBatch.from_arrays([b.column("node_u"), b.column("node_v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


class Sketches:
    """The nodes kept of one part of a bucket, with their sketches, by the sketches' size."""

    def __init__(self):
        self.kept: dict[int, list[np.ndarray]] = {}  # words of a sketch: node, fp, label, size (4, room), sketches (room, words)
        self.n: dict[int, int] = {}

    def keep(self, node: int, fp: int, label: int, size: int, one: np.ndarray) -> None:
        words = one.shape[1]
        facts, sketches = self.kept.setdefault(words, [np.zeros((4, 8), np.int64), np.zeros((8, words), np.uint64)])
        n = self.n.get(words, 0)
        if n == len(sketches):
            facts, sketches = np.concatenate([facts, np.zeros_like(facts)], axis=1), np.concatenate([sketches, np.zeros_like(sketches)])
            self.kept[words] = [facts, sketches]
        facts[:, n], sketches[n] = (node, fp, label, size), one[0]
        self.n[words] = n + 1

    def able(self, earlier: np.ndarray, fp: int, label: int, size: int, one: np.ndarray, radius: int, least: float) -> Iterator[int]:
        """Kept nodes of other labels within the radius that may be alike this one."""
        for words, (facts, sketches) in self.kept.items():
            facts = facts[:, : self.n[words]]
            x = facts[1] ^ np.int64(fp)
            ok = (np.bitwise_count(x.view(np.uint64)) <= radius) & (facts[2] != label)
            at = np.flatnonzero(ok & (np.minimum(facts[3], size) >= least * np.maximum(facts[3], size) - 1e-6))
            at = at[unmet(x[at], earlier)]
            if len(at):
                yield from facts[0, at[may_be_alike(sketches[at], facts[3, at], one, size, least)]].tolist()


def _may_meet(radius: int, least: float):
    """mask, node: the nodes of a bucket of sketches that may have a pair there."""
    tables = _tables(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, told = None, Sketches(), set()
        for b in (batch.slice(at, PAIR_ROWS) for batch in batches for at in range(0, batch.num_rows, PAIR_ROWS)):
            found: list[int] = []
            masks: list[int] = []
            for mask, key, part, side, node, fp, size, label, held in zip(*(b.column(c).to_pylist() for c in BUCKET_ROW)):
                if (mask, key, part) != now:
                    now, bucket, told = (mask, key, part), Sketches(), set()
                    earlier = tables[: int(np.flatnonzero(tables == mask)[0])]
                one = np.frombuffer(held, np.uint64)[None]
                if side != KEPT:
                    others = set(bucket.able(earlier, fp, label, size, one, radius, least))
                    new = (others | {node} if others else others) - told
                    told |= new
                    found.extend(new)
                    masks.extend([mask] * len(new))
                if side != PASSING:
                    bucket.keep(node, fp, label, size, one)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (masks, found)], names=["mask", "node"])
        release()

    return run


class Bucket:
    """The nodes kept of one part of a bucket, and which labels links found there have joined."""

    def __init__(self):
        self.nodes, self.labels, self.sets = [], [], []
        self.fp = np.zeros(64, np.int64)
        self.up: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (above := self.up.get(label, label)) != label:
            label = above
        return label

    def keep(self, node: int, fp: int, label: int, shingles: bytes) -> None:
        n = len(self.nodes)
        if n == len(self.fp):
            self.fp = np.concatenate([self.fp, np.zeros(n, np.int64)])
        self.fp[n] = fp
        self.nodes.append(node)
        self.labels.append(label)
        self.sets.append(shingles)

    def meet(self, earlier: np.ndarray, node: int, fp: int, label: int, shingles: bytes, radius: int, least: float) -> list[int]:
        """Kept nodes that confirmed pairs join to this one. earlier: the tables before this one, where a pair may have met."""
        x = self.fp[: len(self.nodes)] ^ np.int64(fp)
        at = np.flatnonzero(np.bitwise_count(x.view(np.uint64)) <= radius)
        at = at[unmet(x[at], earlier)]
        out = []
        for k in at.tolist():
            a, b = self.root(self.labels[k]), self.root(label)
            small, large = sorted((len(self.sets[k]), len(shingles)))
            if a != b and small >= least * large and jaccard(self.sets[k], shingles) >= least:
                self.up[a] = b
                out.append(self.nodes[k])
        return out


def _meet(radius: int, least: float):
    """u, v: confirmed links of a bucket that join what all its confirmed pairs of two labels join."""
    tables = _tables(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, Bucket()
        for b in (batch.slice(at, PAIR_ROWS) for batch in batches for at in range(0, batch.num_rows, PAIR_ROWS)):
            found: tuple[list, list] = ([], [])
            for mask, key, part, side, node, fp, _, label, shingles in zip(*(b.column(c).to_pylist() for c in BUCKET_ROW)):
                if (mask, key, part) != now:
                    now, bucket = (mask, key, part), Bucket()
                    earlier = tables[: int(np.flatnonzero(tables == mask)[0])]
                if side != KEPT:
                    for other in bucket.meet(earlier, node, fp, label, shingles, radius, least):
                        found[0].append(node)
                        found[1].append(other)
                if side != PASSING:
                    bucket.keep(node, fp, label, shingles)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])
        release()

    return run


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) but for near copies of a row with a smaller id.

    Texts without words (null, empty or ASCII white space) are copies of each other. Of rows with one id those of the same
    shingles count as copies and one stays; one id with texts that are no copies is a document for each. Rows with a null id
    stay and make no others go. Very long texts count whole. An empty table gives an empty result.
    """
    known = docs.where("doc_id IS NOT NULL")
    each = cut(known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_digests, "doc_id bigint, digest binary, fp bigint, size int"))
    nodes = each.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("doc_id"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    labelled = near_components(nodes, known, radius, similarity)
    # of a group the smallest id, and of several texts that have it one
    first = labelled.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    keep = cut(first.select("first.doc_id", "first.digest"))
    repeated = cut(each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        kept = known.join(keep.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    else:
        kept = _kept_of_repeated_ids(known, keep, repeated)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def _kept_of_repeated_ids(docs: DataFrame, keep: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of docs that keep (doc_id, digest) names, one for each, where some ids have several rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    names = docs.columns
    single = docs.join(keep.join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(repeated, "doc_id", "left_semi").select(*names)
    shape = StructType([*several.schema.fields, StructField(DIGEST, BinaryType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_BYTES // 2):
            digest = pa.array(shingle_sets(b.column("text"))[0], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(schema.field(k).type) for k in range(len(names))), digest], schema=schema)

    named = several.mapInArrow(run, shape).join(keep.withColumnRenamed("digest", DIGEST), ["doc_id", DIGEST], "left_semi")
    return single.select(*names).unionByName(named.dropDuplicates(["doc_id", DIGEST]).select(*names))


#: A column of the rows of repeated ids while they are compared; a column of docs must not have this name.
DIGEST = "__shingle_digest"
