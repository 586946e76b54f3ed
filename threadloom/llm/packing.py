"""Operator 10: best-fit packing into bins of several permitted capacities.

Lengths are words (``[^\\x20\\x09-\\x0D]+``). Each partition is packed by itself, in groups of bounded
size, so nothing is shuffled and no key can be hot. Within a group, longest first:

* a text longer than the largest capacity is cut into full bins and a rest;
* a piece goes into the open bin with the least room that still holds it;
* if none does, the bin size that costs least per word it can expect to hold is opened: its own
  piece plus what the shorter pieces still waiting could fill;
* in the end every bin is downsized to the smallest permitted capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from threadloom.llm import words as W
from threadloom.llm.common import released, utf8

CAPACITIES = (256, 512, 1024, 2048, 4096)
GROUP_ROWS, GROUP_BYTES = 20_000, 16 << 20
SCHEMA = ("doc_id bigint, piece int, start bigint, n_units bigint, bin_id bigint, bin_capacity int, bin_offset int")


def bin_cost(capacity: int) -> float:
    """Cost of a sequence: linear work plus attention, which grows with its square."""
    return capacity * (1 + capacity / 8192)


def pack_lengths(lengths, capacities=CAPACITIES, cost=bin_cost):
    """Pack whole numbers; returns (item, piece, start, length, bin, offset) tuples and the bin capacities.

    Items of length 0 take room in no bin but belong to one. Ties go to the earlier item and bin.
    """
    sizes = sorted(capacities)
    top = sizes[-1]
    placed, used = [], []
    pieces = []  # (length, item, piece, start)
    for i, n in enumerate(lengths):
        full, rest = divmod(int(n), top)
        for p in range(full):
            placed.append((i, p, p * top, top, len(used), 0))
            used.append(top)
        if rest or not full:
            pieces.append((rest, i, full, full * top))
    pieces.sort(key=lambda x: (-x[0], x[1]))
    asc = np.sort(np.array([p[0] for p in pieces], np.int64))
    mass = np.concatenate([[0], np.cumsum(asc)])
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    left = len(pieces)
    for n, i, p, start in pieces:
        left -= 1
        k = bisect_left(open_bins, (n, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
            placed.append((i, p, start, n, b, used[b]))
        else:
            best = None
            for size in sizes:
                if size < n:
                    continue
                # pieces still waiting that would fit beside this one; they are the `left` shortest
                fits = min(int(np.searchsorted(asc, size - n, "right")), left)
                rate = cost(size) / max(n + min(size - n, int(mass[fits])), 1)
                if best is None or rate < best[0]:
                    best = (rate, size)
            room, b = best[1], len(used)
            used.append(0)
            placed.append((i, p, start, n, b, 0))
        used[b] += n
        insort(open_bins, (room - n, b))
    return placed, [sizes[bisect_left(sizes, u)] for u in used]


def _packer(capacities, with_text: bool):
    def emit(ids, data, off, first_bin, group):
        begin, end, at = W.word_spans(data, off)
        placed, caps = pack_lengths(np.diff(at), capacities)
        if not placed:
            return None, 0
        cols = list(zip(*placed))
        item = np.array(cols[0], np.int64)
        b = np.array(cols[4], np.int64)
        arrays = [pa.array(ids).take(pa.array(item)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                  pa.array(cols[3], pa.int64()), pa.array(first_bin + b, pa.int64()),
                  pa.array(np.array(caps, np.int32)[b]), pa.array(cols[5], pa.int32())]
        if with_text:
            # a piece's text runs from its first word (or the text's start) to the next piece's first word
            start, n = np.array(cols[2], np.int64), np.array(cols[3], np.int64)
            total = np.diff(at)[item]
            lo = np.where(start == 0, off[:-1][item], _at(begin, at[:-1][item] + start, len(data)))
            hi = np.where(start + n >= total, off[1:][item], _at(begin, at[:-1][item] + start + n, len(data)))
            arrays.append(pa.array([bytes(data[a:z]).decode("utf-8", "replace") for a, z in zip(lo.tolist(), hi.tolist())], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")] + ["text"] * with_text), len(caps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        next_bin = (task.partitionId() if task else 0) << 40
        held, rows, size = [], 0, 0

        def flush():
            nonlocal next_bin, held, rows, size
            if not rows:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, off = utf8(whole.column("text"))
            out, n = emit(whole.column("doc_id"), data, off, next_bin, rows)
            next_bin += n
            held, rows, size = [], 0, 0
            if out is not None:
                for lo in range(0, out.num_rows, 4096):
                    yield out.slice(lo, 4096)

        for batch in batches:
            _, off = utf8(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(off, off[lo] + GROUP_BYTES - size, "right")) - 1
                hi = min(max(hi, lo + (rows == 0)), lo + GROUP_ROWS - rows, batch.num_rows)
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    rows, size = rows + hi - lo, size + int(off[hi] - off[lo])
                    lo = hi
                if lo < batch.num_rows or rows >= GROUP_ROWS:
                    yield from flush()
        yield from flush()
    return run


def _at(begin: np.ndarray, index: np.ndarray, end: int) -> np.ndarray:
    return np.append(begin, end)[np.minimum(index, len(begin))]


def pack_documents(docs: DataFrame, capacities=CAPACITIES, with_text: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts (in words), its bin, and its place in the bin.

    Every row of ``docs`` is packed, repeated ones included. A null or empty text is one piece of no
    words. ``bin_id`` is unique over the result. With ``with_text`` the piece's text comes along; the
    pieces of a document, joined in order, are its text.
    """
    picked = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return picked.mapInArrow(released(_packer(tuple(capacities), with_text)), SCHEMA + (", text string" if with_text else ""))
