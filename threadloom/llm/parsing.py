"""Operator 3: document fingerprints by locally consistent parsing.

A text is a sequence of code points. Each level first names maximal runs of one symbol, so no two
neighbours are equal, then tosses deterministic coins: a symbol's label is the position and value of
the lowest bit in which it differs from its left neighbour. Four rounds bring 64-bit names to six
labels, three more steps to three, and the local maxima of those begin phrases of two to four
symbols. A phrase's name is a hash of its symbols and is a symbol of the next level. Where a phrase
begins depends on a few neighbours only, so equal substrings have equal phrases inside, wherever
they lie. The fingerprint is the bottom-k sketch of the phrase names of levels 2 and up, together
with the name of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import KERNEL_BYTES, mix, shuffle_parts

SKETCH = 64
FIRST_LEVEL = 2
KERNEL_POINTS = 1 << 16  # code points of one kernel call, so that its arrays stay in cache
STEP = np.uint64(0xD6E8FEB86659FD93)


def _toss_table(bits: int) -> np.ndarray:
    """Label of (own, left) for labels of ``bits`` bits, flattened."""
    own, left = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = own ^ left
    low = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ == 0, own & 1, 2 * low + ((own >> low) & 1)).astype(np.uint8).ravel()


TOSS = {7: _toss_table(7), 4: _toss_table(4), 3: _toss_table(3)}


def _three_colours(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """From labels 0..5 with unequal neighbours to labels 0..2 with unequal neighbours."""
    last = np.append(first[1:], True)
    for label in (5, 4, 3):
        at = np.flatnonzero(c == label)
        left = np.where(first[at], 9, c[at - 1])
        right = np.where(last[at], 9, c[np.minimum(at + 1, len(c) - 1)])
        c[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return c


def _level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of one level and which of them begin a text."""
    # name maximal runs
    begin = first.copy()
    begin[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(begin)
    if len(at) < len(x):
        run = np.diff(at, append=len(x)).astype(np.uint64)
        x, first = x[at], first[at]
        x = np.where(run > 1, mix(x + run * STEP), x)
    # deterministic coin tossing
    v = x.copy()
    v[1:] ^= x[:-1]
    v[first] = 1
    low = np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1))
    bit = ((x >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    c = ((low << 1) | bit).astype(np.uint8)
    for bits in (7, 4, 3):
        pair = c.astype(np.int16 if bits == 7 else np.uint8)
        left = np.empty_like(pair)
        left[1:] = pair[:-1]
        left[0] = 0
        tossed = TOSS[bits][(pair << bits) | left]
        tossed[first] = c[first] & 1
        # a text's first symbol has no left neighbour; keep its label unequal to its right neighbour's
        head = np.flatnonzero(first)
        head = head[(head + 1 < len(c))]
        head = head[~first[head + 1]]
        clash = tossed[head] == tossed[head + 1]
        tossed[head[clash]] = tossed[head[clash]] ^ 1
        c = tossed
    c = _three_colours(c, first)
    # local maxima begin phrases; the first symbol of a text always does, the second never
    start = first.copy()
    inner = np.flatnonzero((c[1:-1] > c[:-2]) & (c[1:-1] > c[2:])) + 1 if len(c) > 2 else np.zeros(0, np.int64)
    last = np.append(first[1:], True)
    inner = inner[~first[inner] & ~first[inner - 1] & ~last[inner]]
    start[inner] = True
    at = np.flatnonzero(start)
    place = np.arange(len(x), dtype=np.uint64) - np.repeat(at, np.diff(at, append=len(x))).astype(np.uint64)
    names = np.add.reduceat(mix(x + place * STEP), at)
    return mix(names), first[at]


def phrase_names(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 32-bit name) of all phrases that a fingerprint is drawn from, unsorted."""
    filled = np.flatnonzero(np.diff(off) > 0)
    who_all, name_all = [], []
    if not len(filled):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = mix(points.astype(np.uint64) + np.uint64(1))
    first = np.zeros(len(x), bool)
    first[off[filled]] = True
    who, level = filled, 0
    while len(x):
        x, first = _level(x, first)
        level += 1
        at = np.flatnonzero(first)
        n = np.diff(at, append=len(x))
        single = n == 1
        text = np.repeat(who, n)
        take = np.ones(len(x), bool) if level >= FIRST_LEVEL else np.repeat(single, n)
        who_all.append(text[take])
        name_all.append(mix(x[take] + (np.array([level], np.uint64) * STEP)) >> np.uint64(32))
        if single.any():  # the whole text is one phrase: done
            rest = np.repeat(~single, n)
            x, first, who = x[rest], first[rest], who[~single]
    return np.concatenate(who_all), np.concatenate(name_all)


def sketches(points: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The SKETCH smallest distinct phrase names of each text, ascending; none for an empty text."""
    who, name = phrase_names(points, off)
    key = np.sort((who.astype(np.uint64) << np.uint64(32)) | name)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    who = (key >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(who, np.arange(len(off)))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a:min(a + SKETCH, z)] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]


def fingerprint_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the phrase sets, estimated from two sketches (exact for small sets)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = np.append(both[1:] == both[:-1], False)
    union = both[~np.append(False, same[:-1])]  # first of each value
    low = union[:SKETCH]
    return float(np.isin(low, both[same]).sum()) / len(low)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), off


def text_sketches(texts: list[str]) -> list[np.ndarray]:
    """Sketches of any texts; kernel calls take a bounded number of code points or one longer text."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= KERNEL_POINTS):
            size += len(texts[hi])
            hi += 1
        out += sketches(*_points(texts[lo:hi]))
        lo = hi
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row of ``docs``; null texts are empty, no shuffle.

    Equal texts have equal fingerprints; the empty text has the empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([fingerprint_text(s) for s in text_sketches(texts)], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars bigint, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (slice, doc_id, text) of the row whose successor is still to come
    pairs, size = [], 0

    def flush():
        texts = [t for _, t, _ in pairs]
        edited = [edited_text(t, nxt) for _, t, nxt in pairs]
        own, changed = text_sketches(texts), text_sketches(edited)
        after = own[1:] + [text_sketches([pairs[-1][2]])[0]]
        for i in range(len(pairs) - 1):
            if pairs[i][2] is not texts[i + 1]:
                after[i] = text_sketches([pairs[i][2]])[0]
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([fingerprint_text(s) for s in own], pa.string()),
            pa.array([fingerprint_text(s) for s in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_slice", "_guest", "doc_id", "text"))):
            text = text or ""
            if held is not None and held[0] == part:
                pairs.append((held[1], held[2], text))
                size += len(held[2]) + len(text)
            held = None if guest else (part, doc_id, text)
            if size > KERNEL_BYTES:
                yield flush()
                pairs, size = [], 0
    if pairs:
        yield flush()


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document by (doc_id, text).

    Null ids come first; a null text is empty; equal ids are ordered by text; after the last document
    comes the first; a single document is its own neighbour. Ids are cut into slices by approximate
    quantiles. The first row of each slice is also sent, as a guest, to the slice before it, so every
    document meets its successor inside one slice; texts are shuffled once.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_key"))
    cuts = rows.select("_key").approxQuantile("_key", [k / n for k in range(1, n)], 0.2 / n)
    cuts = sorted({int(c) for c in cuts})
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("_key"))) if cuts else F.lit(0)
    rows = rows.withColumn("_slice", part.cast("int"))
    firsts = {r["_slice"]: r["low"] for r in rows.groupBy("_slice").agg(F.min("_key").alias("low")).collect()}  # one row a slice
    if not firsts:
        firsts = {0: 0}
    order = sorted(firsts)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    top = max(order) + 1
    low = F.array(*[F.lit(firsts.get(s)).cast("bigint") for s in range(top)])
    prior = F.array(*[F.lit(before.get(s, 0)) for s in range(top)])
    own = F.struct(F.col("_slice").alias("s"), F.lit(0).alias("g"))
    guest = F.struct(F.get(prior, F.col("_slice")).cast("int").alias("s"), F.lit(1).alias("g"))
    homes = F.when(F.get(low, F.col("_slice")) == F.col("_key"), F.array(own, guest)).otherwise(F.array(own))
    sent = (rows.withColumn("_home", F.explode(homes))
            .select("doc_id", "text", "_key", F.col("_home.s").alias("_slice"), F.col("_home.g").alias("_guest")))
    # within a slice: own rows by (id, text), then the guests, of which the first is the successor
    sent = (sent.repartition(shuffle_parts(spark), "_slice")
            .sortWithinPartitions("_slice", "_guest", "_key", F.coalesce("text", F.lit(""))))
    return sent.mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")
