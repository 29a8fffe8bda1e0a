"""SimHash near-dedup with covering locality-sensitive hashing.

Each bit of a fingerprint is given a non-zero vector of radius + 1 bits. Table t (each such vector) keeps the bits whose
vector has an odd product with t. Any `radius` differing bits have vectors to which some t is orthogonal: in that table
none of them counts and the two fingerprints collide. So no pair within the radius is missed (15 tables for 3 bits).

Scale: texts are fingerprinted in one pass; equal fingerprints are one class from then on. Buckets of more than LIMIT
classes are dealt again by a further quarter of the bits that their table leaves out (a pair within three bits agrees in
one of the four), and again, until they are small. A large bucket yields a spanning forest of its links, the nearest
first, and not all its pairs; components are found from these by distributed large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER_BYTES, chunks, cut, partitions, runs, table, text_buffer
from .components import connected_components
from .xxh64 import xxh64

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
LIMIT, FEW = 2048, 8
#: Pairs that are compared in one vectorised step.
CELLS = 1 << 18
EVERY_BIT = (1 << BITS) - 1
NO_TABLES = np.zeros(0, np.int64)

#: byte -> its eight bits, one in each byte of a word
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def covering_masks(radius: int = RADIUS, parts: int = 1) -> tuple[int, ...]:
    """The tables' masks, such that every pair within radius bits agrees under one of them.

    The bits are dealt to `parts` parts; in one of these a pair within the radius differs in radius // parts bits or fewer, so
    each part has the tables of that smaller radius. Vectors are dealt to the bits in steps such that the smallest table
    keeps the most bits.
    """
    near = radius // parts
    top = (1 << (near + 1)) - 1

    def masks(step: int) -> list[int]:
        out = []
        for part in range(parts):
            bits = range(part, BITS, parts)
            vectors = {b: i * step % top + 1 for i, b in enumerate(bits)}
            out += [sum(1 << b for b in bits if (vectors[b] & t).bit_count() % 2) for t in range(1, top + 1)]
        return out

    best = max((s for s in range(1, min(top, 64) + 1) if gcd(s, top) == 1), key=lambda s: min(m.bit_count() for m in masks(s)))
    return tuple(masks(best))


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """mask and one of radius + 1 parts of the other bits."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = [free[k :: radius + 1] for k in range(radius + 1)]
    return [mask | sum(1 << i for i in part) for part in parts if part]


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per group (h[first[g]:first[g + 1]]) the word of the bits that over half its hashes have; 0 for no hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    steps = -(-n[some] // 255)  # a byte counts to 255
    owner = np.repeat(np.arange(len(some)), steps)
    begin = first[some][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps))
    group = np.cumsum(steps) - steps
    raw = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[raw[:, k]], begin)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
        bits = counts * 2 > n[some][:, None]
        out[some] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all shingles, n + 1 offsets): width words joined by spaces, all of fewer; a text without words has none."""
    data, offsets = text_buffer(texts)
    low = LOWER_BYTES[data]
    starts, ends = runs(~IS_SPACE[low], offsets)
    # all words, a space after each
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    plain = np.full(at[-1], 32, dtype=np.uint8)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[1:] - 1] = False
    plain[inside] = low[~IS_SPACE[low]]
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    group = np.concatenate([[0], np.cumsum(shingles)])
    word = np.arange(group[-1]) - np.repeat(group[:-1] - first[:-1], shingles)
    last = np.minimum(word + width, np.repeat(first[1:], shingles))
    return xxh64(plain, at[word], at[last] - 1, SEED), group


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    return majority(*shingle_hashes(texts, width))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text")).view(np.int64))], names=["doc_id", "fp"])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count those of the absolute value


def unmet(z: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which of these differences meet in none of the earlier tables; each pair belongs to the first table where it meets."""
    ok = np.ones(len(z), dtype=bool)
    step = max(1, CELLS // max(len(earlier), 1))
    for at in range(0, len(z) if len(earlier) else 0, step):
        ok[at : at + step] = ((earlier[:, None] & z[None, at : at + step]) != 0).all(axis=0)
    return ok


def close_pairs(x: np.ndarray, radius: int, most: int, earlier: np.ndarray = NO_TABLES) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i < j) of the pairs of x within radius bits that no earlier table has; None if they are more than `most`."""
    left, right, n = [], [], 0
    step = max(1, CELLS // max(len(x), 1))
    for at in range(0, len(x), step):
        i, j = np.nonzero(differing(x[at : at + step, None], x[None, at:]) <= radius)
        later = j > i
        i, j = i[later] + at, j[later] + at
        own = unmet(x[i] ^ x[j], earlier)
        left.append(i[own])
        right.append(j[own])
        n += len(left[-1])
        if n > most:
            return None
    return np.concatenate([np.zeros(0, int), *left]), np.concatenate([np.zeros(0, int), *right])


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A shortest spanning forest of the pairs of x (a small bucket) within radius bits."""
    return forest_and_open(x, radius, NO_TABLES)[:2]


def forest_and_open(x: np.ndarray, radius: int, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that join what all pairs of x within radius bits join, and those of x with further pairs; pairs that meet in an
    earlier table are left to it.

    Few pairs are all given; of many a shortest spanning forest.
    """
    n = len(x)
    if (few := close_pairs(x, radius, 2 * n, earlier)) is not None:
        return x[few[0]], x[few[1]], x[:0]
    done = np.zeros(n, dtype=bool)
    dist, link, near = np.full(n, BITS + 1), np.full(n, -1), np.zeros(n, dtype=np.int64)
    left, right = [], []
    for _ in range(n):
        k = int(np.argmin(np.where(done, BITS + 2, dist)))
        if dist[k] <= radius:
            left.append(k)
            right.append(link[k])
        done[k] = True
        d = differing(x, x[k])
        if len(earlier):
            at = np.flatnonzero(d <= radius)
            d[at[~unmet(x[at] ^ x[k], earlier)]] = BITS + 1  # and itself
            near[k] = (d <= radius).sum()
        else:
            near[k] = (d <= radius).sum() - 1
        closer = (d < dist) & ~done
        dist[closer], link[closer] = d[closer], k
    left, right = np.array(left, int), np.array(right, int)
    taken = np.bincount(np.concatenate([left, right]), minlength=n)
    return x[left], x[right], x[near > taken]


def bucket_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def links(begin: np.ndarray, fp: np.ndarray, radius: int, nth: np.ndarray | None = None, tables: np.ndarray = NO_TABLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within the buckets that begin at these rows, and those of fp that have pairs which are no links.

    With nth (the number of each row's table among `tables`) a pair counts in its first table only. The pairs are so dealt to
    the tables, and links that join what each table's pairs join are fewer and join what all pairs join.
    """
    size = np.diff(np.append(begin, len(fp)))
    bucket = np.repeat(np.arange(len(begin)), size)
    few = size[bucket] <= FEW
    left, right, opened = [], [], [np.zeros(0, np.int64)]
    for lag in range(1, FEW):
        i = np.flatnonzero(few[:-lag] & (bucket[:-lag] == bucket[lag:])) if len(fp) > lag else np.zeros(0, int)
        i = i[differing(fp[i], fp[i + lag]) <= radius]
        if nth is not None:
            for k in range(len(tables) - 1):
                i = i[(nth[i] <= k) | ((tables[k] & (fp[i] ^ fp[i + lag])) != 0)]
        left.append(fp[i])
        right.append(fp[i + lag])
    for k in np.flatnonzero(size > FEW):
        earlier = NO_TABLES if nth is None else tables[: nth[begin[k]]]
        a, b, c = forest_and_open(np.unique(fp[begin[k] : begin[k] + size[k]]), radius, earlier)
        left.append(a)
        right.append(b)
        opened.append(c)
    return np.concatenate(left), np.concatenate(right), np.unique(np.concatenate(opened))


def _bucket_links(radius: int, kind: str, tables: np.ndarray):
    """Rows of a partition sorted by bucket (mask, mask & fp, pair); the last bucket of a batch waits for the next one."""
    order = np.argsort(tables)

    def found(mask: np.ndarray, key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        nth = order[np.searchsorted(tables[order], mask)] if kind == "open" else None
        u, v, opened = links(bucket_starts(mask, key, pair), fp, radius, nth, tables)
        if kind == "open":
            u, v = np.concatenate([u, opened]), np.concatenate([v, opened])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            mask, pair, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pair", "fp"))
            now = [mask, mask & fp, pair, fp]
            now = now if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, now)]
            if not len(now[0]):
                continue
            end = bucket_starts(*now[:3])[-1]
            rest = [c[end:] for c in now]
            yield found(*(c[:end] for c in now))
        if rest is not None:
            yield found(*rest)

    return run


def near_links(classes: DataFrame, radius: int = RADIUS, limit: int = LIMIT, kind: str = "thin", parts: int = 1) -> DataFrame:
    """u, v: links that join the same of the distinct fingerprints (fp) as all pairs within radius bits do.

    kind "open" (for parts > 1) takes each pair in the first table where it meets, and adds a row with u = v for each fingerprint that has pairs within the radius which are not among the links.
    Buckets of more than limit classes are dealt again by finer masks (parts = 1), or in blocks
    each two of which meet (parts > 1, where finer masks would be too many).
    """
    spark = classes.sparkSession
    tables = covering_masks(radius, parts)
    masks, found = list(tables), None
    rows = classes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    key = F.col("mask").bitwiseAND(F.col("fp"))  # told by the other two, so it does not travel

    def met(rows: DataFrame) -> DataFrame:
        """rows: mask, pair, fp"""
        dealt = rows.repartition(partitions(spark), F.col("mask"), key, F.col("pair")).sortWithinPartitions(F.col("mask"), key, F.col("pair"), F.col("fp"))
        return dealt.mapInArrow(_bucket_links(radius, kind, np.array([signed(m) for m in tables])), "u bigint, v bigint")

    while True:
        keyed = rows.select("mask", key.alias("key"), "fp")
        big = cut(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        masks = [m for m in masks if m != EVERY_BIT]
        crowded = not big.isEmpty() and bool(masks)
        small = keyed.join(big, ["mask", "key"], "left_anti") if crowded else keyed
        part = met(small.select("mask", F.lit(0).alias("pair"), "fp"))
        found = part if found is None else found.unionByName(part)
        if not crowded:
            return found
        if parts > 1:
            blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int")
            own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.least(own, c) * blocks + F.greatest(own, c))
            return found.unionByName(met(keyed.join(big, ["mask", "key"]).select("mask", F.explode(pairs).alias("pair"), "fp")))
        finer = {m: finer_masks(m, radius) for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        steps = spark.createDataFrame([(signed(m), signed(x)) for m, xs in finer.items() for x in xs], "mask bigint, finer bigint")  # radius + 1 rows for each mask there is
        rows = cut(keyed.join(big, ["mask", "key"], "left_semi").join(steps, "mask").select("fp", F.col("finer").alias("mask")).distinct())


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint, the bits of the fingerprint), component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links of RADIUS differing bits or fewer lead to, its own included. Null and
    empty texts have fingerprint zero; rows with a null id are linked like others but lend no id (a group of such rows
    alone has a null component_id); repeated rows are kept; empty tables give empty results; other columns are left out.
    """
    fps = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_fingerprint_rows, "doc_id bigint, fp bigint"))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = connected_components(near_links(classes)).withColumnRenamed("node", "fp")
    labelled = classes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    resolved = cut(labelled.join(smallest, "label").select("fp", "component_id"))
    return fps.join(resolved, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
