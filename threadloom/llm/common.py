"""Helpers shared by the operators of this subpackage: inputs, Arrow text buffers, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.stage import drop_between, stage, staged_so_far

KERNEL_BYTES = 1 << 20  # text handed to one call of a numpy kernel; one longer text is a call of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes each, or of one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries have none


def release() -> None:
    """Return what a kernel has freed to the machine, at the end of its task.

    Python workers stay for later tasks, and their allocators would keep each kernel's largest use beside the next one's.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(kernel):
    """The kernel (an iterator of batches to an iterator of batches) with ``release`` at the end of its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()
    return run


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = KERNEL_BYTES):
    """Yield (batch rows lo..hi as a RecordBatch, bytes, offsets) in kernel-sized pieces."""
    for batch in batches:
        data, off = utf8(batch.column(column))
        for lo, hi in slices(off, limit):
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), so all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def settle(df: DataFrame, name: str) -> DataFrame:
    """``stage`` a large intermediate, then let Spark remove the shuffle files behind it.

    Spark deletes a shuffle's files when the driver no longer refers to it, which it notices at a
    garbage collection only; without one they would pile up over the steps of a long operator.
    """
    out = stage(df, name)
    df.sparkSession._jvm.System.gc()
    return out


def finish(first: int, *results: DataFrame) -> list[DataFrame]:
    """Stage an operator's (small) results and delete what it staged since mark ``first``."""
    last = staged_so_far()
    out = [stage(df, "result") for df in results]
    drop_between(first, last)
    return out


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A staged ``df``, marked for broadcast when it has at most ``rows`` rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``links(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two grouped minima and two
    joins, the edge list never grows past its first size, and the number of rounds is logarithmic
    in the longest path. Every round is written to the shared folder, so lost executors cost at
    most one round. A hot node's edges are only ever aggregated (map-side minima) or joined
    (split by adaptive execution), never gathered.
    """
    edges = stage(links.where(F.col("a") != F.col("b"))
                  .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour larger than a node points at the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("low").alias("a"), "b").where("a < b").distinct())
        # small star: the smaller neighbours of a node, and the node, point at the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(least, "b")
                 .select(F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("a").alias("y")),
                                           F.struct(F.col("low").alias("x"), F.col("b").alias("y")))).alias("e"))
                 .select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a < b").distinct())
        edges = stage(small, "edges")
        # stable exactly when the edge set no longer changes: compare order-free digests
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    tops = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops)
