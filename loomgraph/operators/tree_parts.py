"""A Barnes-Hut tree too large for one task: the same cells as `Tree` has, dealt to the tasks in blocks.

The tree is cut into blocks, the largest cells of at most BLOCK_NODES nodes (or of the greatest depth). What lies above them is
small and sent to all tasks. Each block's own tree is made by one task, which gives each other block those of its cells that
nodes there may have to look into: a cell that is far enough from the whole square of a block is accepted by all nodes in
it, so nothing below it is given. Each block's nodes then walk down what they were given, as they would walk the whole tree.

Scale: nodes are shuffled twice by block, cells once; a task holds one block and the cells given to it. The driver gathers the
numbers of nodes of cells, of FINER levels at once, only below cells of more than BLOCK_NODES nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import MAX_DEPTH, WALKERS, Tree, grid_of, square

BLOCK_NODES, FINER = 16_384, 6
FLOATS, INTS = ("mass", "x", "y", "width"), ("points", "child", "children", "one")


def codes(grid: np.ndarray) -> np.ndarray:
    """The path down the tree to each place of the finest grid, two bits for each level."""
    out = np.zeros(len(grid), dtype=np.int64)
    for k in range(MAX_DEPTH):
        out |= (((grid[:, 0] >> k) & 1) * 2 + ((grid[:, 1] >> k) & 1)) << (2 * k)
    return out


def numpy_of(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, places, masses) of a batch or table."""
    column = lambda c: b.column(c).to_numpy() if isinstance(b, pa.Table) else b.column(c).to_numpy(zero_copy_only=False)
    return column("id"), np.stack([column("x"), column("y")], axis=1), column("mass")


def _cells(low: np.ndarray, size: float, level: int, within: np.ndarray | None, step: int):
    """cell, n, mass and mass times place of the cells of a level, below those of `within`, `step` levels above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, xy, mass = numpy_of(b)
            cell = codes(grid_of(xy, low, size)) >> (2 * (MAX_DEPTH - level))
            if within is not None:
                mine = np.isin(cell >> (2 * step), within)
                cell, xy, mass = cell[mine], xy[mine], mass[mine]
            cells, at = np.unique(cell, return_inverse=True)
            sums = [np.bincount(at, weights=w, minlength=len(cells)).astype(float) for w in (np.ones(len(at)), mass, mass * xy[:, 0], mass * xy[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(cells), *map(pa.array, sums)], names=["cell", "n", "mass", "mx", "my"])

    return run


class Top:
    """The tree above the blocks, as flat arrays like those of `Tree`, and the blocks: their levels, codes and cells in it."""

    def __init__(self, placed: DataFrame, low: np.ndarray, size: float):
        self.low, self.size = low, size
        parts: list[dict[str, np.ndarray]] = []
        level, within = 0, None
        while level <= MAX_DEPTH and (within is None or len(within)):
            finest = min(level + FINER - 1, MAX_DEPTH)
            rows = placed.mapInArrow(_cells(low, size, finest, within, finest - level + 1), "cell bigint, n double, mass double, mx double, my double")
            rows = rows.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "mass", "mx", "my"))).toArrow().sort_by("cell")
            cell, sums = rows["cell"].to_numpy(), np.stack([rows[c].to_numpy() for c in ("n", "mass", "mx", "my")])
            for at in range(level, finest + 1):
                begin = np.flatnonzero(np.diff(cell >> (2 * (finest - at)), prepend=-1))
                total = np.add.reduceat(sums, begin, axis=1)
                code = cell[begin] >> (2 * (finest - at))
                block = (total[0] <= BLOCK_NODES) | (at == MAX_DEPTH)
                parts.append({"level": np.full(len(code), at), "code": code, "n": total[0], "mass": total[1], "x": total[2] / total[1], "y": total[3] / total[1], "block": block})
                inside = np.isin(cell >> (2 * (finest - at)), code[~block])
                cell, sums = cell[inside], sums[:, inside]
                if not len(cell):
                    break
            within = parts[-1]["code"][~parts[-1]["block"]]
            level = finest + 1
        get = lambda name: np.concatenate([p[name] for p in parts])
        self.mass, self.x, self.y, self.points = get("mass"), get("x"), get("y"), get("n").astype(np.int64)
        levels, code, block = get("level"), get("code"), get("block")
        self.width = size / 2.0**levels
        self.child, self.children, self.one = np.full(len(code), -1), np.zeros(len(code), np.int64), np.full(len(code), -1)
        base = 0
        for above, below in zip(parts, parts[1:]):
            owner, after = below["code"] >> 2, base + len(above["code"])
            here = slice(base, after)
            self.children[here] = np.searchsorted(owner, above["code"], "right") - np.searchsorted(owner, above["code"])
            self.child[here] = np.where(self.children[here] > 0, after + np.searchsorted(owner, above["code"]), -1)
            base = after
        # blocks, in the order of their codes
        leaf = np.flatnonzero(block)
        begin = code[leaf] << (2 * (MAX_DEPTH - levels[leaf]))
        leaf = leaf[np.argsort(begin)]
        self.leaf, self.level, self.begin = leaf, levels[leaf], np.sort(begin)
        across = size / 2.0 ** levels[leaf]
        corner = np.zeros((len(leaf), 2))
        for k in range(MAX_DEPTH):
            corner += np.stack([(self.begin >> (2 * k + 1)) & 1, (self.begin >> (2 * k)) & 1], axis=1) * size / 2.0 ** (MAX_DEPTH - k)
        self.least, self.most = low + corner - 1e-9 * size, low + corner + across[:, None] + 1e-9 * size

    def block_of(self, xy: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, codes(grid_of(xy, self.low, self.size)), side="right") - 1


def ranges(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.arange(number.sum()) + np.repeat(start - np.cumsum(number) + number, number)


def opened(tree: Tree, least: np.ndarray, most: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """(square, cell): the cells that nodes in these squares may have to look into."""
    who, cell = np.arange(len(least)), np.zeros(len(least), dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(who):
        at = np.stack([tree.x[cell], tree.y[cell]], axis=1)
        away = np.maximum(np.maximum(least[who] - at, at - most[who]), 0)
        far = tree.width[cell] ** 2 < theta * theta * (away**2).sum(axis=1) * (1 - 1e-9)
        look = ~far & (tree.children[cell] > 0)
        who, cell = who[look], cell[look]
        out.append((who, cell))
        number = tree.children[cell]
        who, cell = np.repeat(who, number), ranges(tree.child[cell], number)
    return np.concatenate([w for w, _ in out]), np.concatenate([c for _, c in out])


def pruned(tree: Tree, look: np.ndarray) -> tuple[bytes, bytes]:
    """The root and what is below the cells to look into (in order), as bytes; the others have nothing below them."""
    number = tree.children[look]
    cells = np.concatenate([[0], ranges(tree.child[look], number)])
    child, children, at = np.full(len(cells), -1), np.zeros(len(cells), np.int64), np.searchsorted(cells, look)
    child[at], children[at] = 1 + np.cumsum(number) - number, number
    ints = np.stack([tree.points[cells], child, children, tree.one[cells]]).astype(np.int64)
    return np.stack([getattr(tree, f)[cells] for f in FLOATS]).tobytes(), ints.tobytes()


def _give(shared, theta: float):
    """From the nodes of a block: to, source, floats, ints: cells of its tree for its own block and for others."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        top, mine = shared.value, key[0].as_py()
        _, xy, mass = numpy_of(rows.sort_by("id"))
        tree = Tree(xy, mass, grid_of(xy, top.low, top.size), top.size, int(top.level[mine]))
        out: tuple[list, list] = ([mine], [pruned(tree, np.flatnonzero(tree.children > 0))])
        tree.one[:] = -1  # whose nodes are no one's own elsewhere
        who, cell = opened(tree, top.least, top.most, theta)
        order = np.lexsort((cell, who))
        who, cell = who[order], cell[order]
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        for a, b in zip(begin, np.append(begin[1:], len(who))):
            if who[a] != mine:
                out[0].append(int(who[a]))
                out[1].append(pruned(tree, cell[a:b]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array([mine] * len(out[0]), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*out[1]))], names=["to", "source", "floats", "ints"])

    return run


def _walk(shared, kr: float, theta: float):
    def run(key: tuple, rows: pa.Table, given: pa.Table) -> pa.Table:
        top, mine = shared.value, key[0].as_py()
        ids, xy, mass = numpy_of(rows.sort_by("id"))
        floats, ints = [np.stack([getattr(top, f) for f in FLOATS])], [np.stack([getattr(top, i) for i in INTS])]
        base = floats[0].shape[1]
        for source, f, i in zip(*(given.column(c).to_pylist() for c in ("source", "floats", "ints"))):
            f, i = np.frombuffer(f).reshape(len(FLOATS), -1), np.frombuffer(i, np.int64).reshape(len(INTS), -1).copy()
            i[1] += np.where(i[2] > 0, base, 0)
            ints[0][1:, top.leaf[source]] = i[1:, 0]  # the block's cell takes what is below the root given
            floats.append(f)
            ints.append(i)
            base += f.shape[1]
        tree = object.__new__(Tree)
        tree.__dict__ |= dict(zip(FLOATS, np.concatenate(floats, axis=1))) | dict(zip(INTS, np.concatenate(ints, axis=1)))
        parts = [slice(at, at + WALKERS) for at in range(0, len(ids), WALKERS)]
        force = np.concatenate([np.zeros((0, 2)), *(tree.repulsion(np.arange(len(ids))[p], xy[p], mass[p], kr, theta, ids[p]) for p in parts)])
        return pa.table([pa.array(ids), pa.array(force[:, 0]), pa.array(force[:, 1])], names=["id", "fx", "fy"])

    return run


def repulsion_in_parts(placed: DataFrame, kr: float, theta: float) -> DataFrame:
    """id, fx, fy by the tree; placed: id, x, y, mass, any number of rows, at least one."""
    rows = placed.select(F.col("id").cast("bigint").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "mass")))
    box = rows.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    low, size = square(np.array(box[:2]), np.array(box[2:]))
    shared = placed.sparkSession.sparkContext.broadcast(Top(rows, low, size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = pa.array(shared.value.block_of(numpy_of(b)[1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, block], names=[*b.schema.names, "block"])

    dealt = rows.mapInArrow(deal, "id bigint, x double, y double, mass double, block bigint")
    given = dealt.groupBy("block").applyInArrow(_give(shared, theta), "to bigint, source bigint, floats binary, ints binary")
    return dealt.groupBy("block").cogroup(given.groupBy("to")).applyInArrow(_walk(shared, kr, theta), "id bigint, fx double, fy double")
