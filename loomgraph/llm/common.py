"""Shared helpers: checkpoints in the shared folder, and Arrow text columns seen as flat byte arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own pools keep what they once took; the system's gives it back, which long-lived workers need.
pa.set_memory_pool(pa.system_memory_pool())

#: What numpy's OpenBLAS may call its setter, by how it was built.
BLAS_SETTERS = [f"{a}openblas_set_num_threads{b}" for a in ("scipy_", "") for b in ("64_", "64", "_", "")]


def one_blas_thread() -> None:
    """A task has one core: matrix products of small matrices take it alone, where the library lets them be told."""
    try:
        with open("/proc/self/maps") as f:
            loaded = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in loaded:
        library = ctypes.CDLL(path)
        for name in BLAS_SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 2 << 20
SPACES = " \t\n\x0b\x0c\r"

#: byte -> byte with A-Z lower-cased
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: byte -> is one of the six ASCII white-space bytes
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only; F.lower would fold other letters too."""
    return F.translate(col, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's own folder (spark.checkpoint.dir) is used; one is set only where there is none, and on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", None)
        if not given and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files and broadcasts of results that nothing refers to any more.

    It drops them when the driver's JVM collects garbage, which many small results may not make it do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, n + 1 offsets); null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.cast(pc.fill_null(arr, ""), pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def release() -> None:
    """Gives freed memory back to the system, where the C library can; workers live on after their task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the text column of each has at most limit bytes or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, dtype=bool)
    change[0], change[n] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=change[1:n])
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    joined = np.unique(edge[mask[edge] & mask[edge - 1]])  # a run goes on across the end of a text: it ends and begins here
    bounds = np.flatnonzero(change)
    if len(joined):
        bounds = np.sort(np.concatenate([bounds, joined, joined]), kind="stable")
    return bounds[::2], bounds[1::2]


def string_views(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array (of valid UTF-8), gaps left out."""
    size = ends - starts
    off = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=off[1:])
    if len(starts):
        step = np.ones(off[-1], dtype=np.int64)
        full = size > 0
        s, o = starts[full], off[:-1][full]
        step[o[0]] = s[0]
        step[o[1:]] = s[1:] - ends[full][:-1] + 1
        data = data[np.cumsum(step)]
    else:
        data = data[:0]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))
