"""Exact top-k by inner product with an impact-ordered index, score at a time.

Components become integers x = floor(256 * component). In each shard of the vectors every dimension d has its postings
in order of value, cut to segments of equal quantised impact. For a query q the contribution of d is q_d * x_d. Less the
least that it can be in the shard it is |q_d| * (x_d - min_d) or |q_d| * (max_d - x_d): never negative, and larger the
further up (or down) the dimension's order a posting stands. The segments of all dimensions are taken by descending
upper bound of that contribution, and the quantised impact is added to their vectors' scores. After each round a
vector's full score lies between its score so far and that plus, for each dimension, the larger of the bound of its first
segment not taken and the most that its quantising lost. The search ends once these bounds prove that all but a few
vectors can not be among the k best, or with the last segment; possible members (ties included) are rescored exactly.

Scale: queries are a stated set against all rows. A task holds one shard of the vectors and one group of queries (at most
about SHARD_ROWS and GROUP_ROWS rows), whatever the size of either side; each meeting gives at most k rows a query, and
these are cut to k a query before the shuffle that ranks them. Neither side is broadcast or gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE, K, EVERY = 256, 5, 50
SHARD_ROWS, GROUP_ROWS = 8192, 2048
LEVELS = 16
ROUND = 64
#: Integers up to this are exact in the float64 sums of the proof; larger products are searched in Python's integers.
EXACT = 1 << 53
#: Components whose integer is not below this would leave no room for a product.
LARGEST = 1 << 62
#: The search ends when the proof leaves at most one in ENOUGH vectors (or 4 k) to rescore.
ENOUGH = 16


class ImpactIndex:
    """Vectors of one shard (ids ascending), their components' postings in segments of equal quantised impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (x - self.low) // width
        self.order = np.argsort(level, axis=0, kind="stable")  # postings of dimension d: order[:, d]
        steps = np.arange(LEVELS + 1)
        dims = x.shape[1]
        self.bounds = np.stack([np.searchsorted(np.sort(level[:, d]), steps) for d in range(dims)]) if dims else np.zeros((0, LEVELS + 1), int)
        self.least = self.low[:, None] + steps[:-1] * width[:, None]  # smallest value in each level
        self.most = np.minimum(self.least + width[:, None] - 1, self.high[:, None])
        self.reach = max([1, *(max(abs(int(a)), abs(int(b)), int(b) - int(a)) for a, b in zip(self.low, self.high))])

    def fits(self, q: np.ndarray) -> bool:
        """Whether all sums of the search are exact."""
        return 2 * len(q) * max(abs(int(q.min(initial=0))), int(q.max(initial=0))) * self.reach < EXACT

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(exact scores, rows) of the possible members of the k best; rows with the query's own id are no candidates."""
        n, dims = self.x.shape
        alive = self.ids != own
        k = min(k, int(alive.sum()))
        if not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.fits(q):
            rows = np.flatnonzero(alive)
            return long_scores(self.x[rows], q), rows
        up, weight = (q > 0)[:, None], np.abs(q)[:, None]
        # of each segment: the least and most that its postings add above the dimension's smallest contribution
        add_low = np.where(up, self.least - self.low[:, None], self.high[:, None] - self.most) * weight
        add_high = np.where(up, self.most - self.low[:, None], self.high[:, None] - self.least) * weight
        dim, level = np.nonzero((np.diff(self.bounds, axis=1) > 0) & (weight > 0))
        order = np.argsort(-add_high[dim, level], kind="stable")
        dim, level = dim[order], level[order]
        low, bound = add_low[dim, level], add_high[dim, level]
        begin, end = self.bounds[dim, level], self.bounds[dim, level + 1]
        slack = np.zeros(dims, dtype=np.int64)  # of a dimension: how much its quantised impacts may fall short
        np.maximum.at(slack, dim, bound - low)
        score = np.zeros(n)
        members = np.flatnonzero(alive)
        for at in range(0, len(dim), ROUND):
            now = range(at, min(at + ROUND, len(dim)))
            rows = np.concatenate([self.order[begin[i] : end[i], dim[i]] for i in now])
            score += np.bincount(rows, weights=np.repeat(low[at : at + ROUND], end[at : at + ROUND] - begin[at : at + ROUND]), minlength=n)
            rest = np.zeros(dims, dtype=np.int64)  # what a dimension's postings not taken yet may add at most
            np.maximum.at(rest, dim[at + ROUND :], bound[at + ROUND :])
            least = np.partition(score[alive], -k)[-k]
            members = np.flatnonzero(alive & (score + np.maximum(rest, slack).sum() >= least))
            if len(members) <= max(4 * k, n // ENOUGH):  # proof that no other vector can enter
                break
        return self.x[members] @ q, members


def long_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in Python's integers; one that a long can not hold is an error and no wrong number."""
    scores = x.astype(object) @ q.astype(object)
    if len(scores) and max(abs(int(v)) for v in scores) >= 1 << 63:
        raise OverflowError("an inner product is beyond the range of a long")
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score descending, then id."""
    return np.lexsort((ids, -scores))[:k]


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of integers as a matrix, shorter ones padded with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        shape = {"query_id": "int64", "vec_id": "int64", "score": "int64"}
        if not len(vectors) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in shape.items()})
        vectors = vectors.sort_values("vec_id")
        width = max(*map(len, vectors["x"]), *map(len, queries["x"]))
        index = ImpactIndex(vectors["vec_id"].to_numpy(), _matrix(vectors["x"], width))
        out = []
        for own, q in zip(queries["vec_id"], _matrix(queries["x"], width)):
            scores, rows = index.search(q, k, own)
            top = best(scores, index.ids[rows], k)
            out.append((np.full(len(top), own), index.ids[rows][top], scores[top]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(shape)})

    return run


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x array<bigint>, a row for each row that takes part; repeated ids and rows are kept.

    Rows with a null id or vector, or with a component that is null, not finite or too large for an integer (LARGEST), take
    no part.
    """
    whole = lambda v: F.floor(F.lit(scale) * v.cast("double"))
    far = lambda v: F.lit(scale) * F.abs(v.cast("double")) >= F.lit(float(LARGEST))
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & ~far(v))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fit, F.lit(False)))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda v: F.when(far(v), F.lit(0)).otherwise(whole(v)).cast("bigint")).alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each id of queries (vec_id, x) its k best of the rows of vectors (vec_id, x).

    Rows with the query's own id are no candidates; all others are, repeated ones each for itself. Several queries of one id
    are ranked together. Ties go to the smaller vec_id; with fewer candidates than k all are returned. Vectors of different
    lengths are padded with zeros; a product that a long can not hold is an error. Empty tables give empty results.
    """
    shards, groups = (max(1, -(-df.count() // rows)) for df, rows in ((vectors, SHARD_ROWS), (queries, GROUP_ROWS)))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "x", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "x", deal(shards, 0).alias("shard"), every(groups).alias("group"))
    right = queries.select("vec_id", "x", deal(groups, 1).alias("group"), every(shards).alias("shard"))
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # limits each task's rows before the shuffle too
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
