"""Operator 1: removal of repeated byte strings with column-wise suffix construction.

A byte goes when it lies in a 400-byte string that starts at another place too, in any document.

1. Copies of a whole text are one text with a count; a counted text of 400 bytes or more goes whole.
   Equal passages inside one text are found there, and one of them goes on.
2. Every window of 400 bytes names an anchor: the place of its least 32-byte hash, leftmost on ties. Equal
   windows have equal anchors at equal distance, so only windows of one anchor hash need comparing. An
   anchor hash that occurs once is no repeat; that ends the work for most of the text.
3. The passages around repeated anchors (each with exactly the bytes of the windows that name it) are dealt
   by anchor hash into collections. For each collection the suffixes of all passages are built column by
   column from the right, one symbol of every passage a round: the round reads the column's symbols in
   suffix order (the collection's Burrows-Wheeler segment), a stable sort by symbol gives the next
   order, and the common prefix of neighbours is one more than the least of the old values between
   them. Where two neighbours share 400 symbols, both windows repeat. A round's order, symbols and
   common prefixes are read and written once, front to back.
4. An anchor with over GROUP passages is split by what its windows share: into cells of neighbouring windows
   (all, then 92, 23, 1), keyed by the bytes common to the whole cell. Equal passages of a cell are counted
   before they are shuffled, and one stands for all. So no collection is unbounded, whatever part of the
   rows holds one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.common import finish, mix, released, settle, slices, stage, staged_so_far, text_slices, utf8

WINDOW, GRAM = 400, 32
GROUP = 2000  # passages of one anchor that make one collection
BATCH_PASSAGES = 8192  # passages whose columns are held at once; collections are joined up to it
SEGMENT = 4 << 20  # window starts of a long text that are looked at together
ANCHOR = "struct<h:bigint,p:int,i0:int,i1:int>"
END = 256  # symbol beyond a passage's ends; no byte equals it
PLACE = np.uint64((1 << 31) - 1)


def spread(window: int) -> int:
    """Places that an anchor may take in a window."""
    return window - GRAM + 1


def cell_widths(window: int) -> tuple[int, ...]:
    """Widths, in windows, that larger groups are split to."""
    return spread(window), spread(window) // 4, spread(window) // 16, 1


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256; a null text is empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first window, last window) of every anchor; windows never cross texts."""
    n, reach = len(data) - window + 1, spread(window)
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none, none
    at = np.arange(len(data) - GRAM + 1)
    h = W.span_hash(data, at, at + GRAM)
    key = (h & ~PLACE) | at.astype(np.uint64)
    # least key of every ``reach`` places: running minima from both ends of blocks of as many
    rows = -(-len(key) // reach)
    block = np.full(rows * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[:len(key)] = key
    block = block.reshape(rows, reach)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[reach - 1:reach - 1 + n]) & PLACE).astype(np.int64)
    # a text's last window - 1 places begin no window
    valid = np.zeros(n + 1, np.int64)
    own = np.flatnonzero(np.diff(off) >= window)
    valid[off[own]] += 1
    np.subtract.at(valid, off[own + 1] - window + 1, 1)
    valid = np.cumsum(valid[:-1]) > 0
    place[~valid] = -1
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    p = place[first]
    text = np.searchsorted(off, first, "right") - 1
    return text, h[p], p - off[text], first - off[text], last - off[text]


def _text_anchors(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``anchors`` with a long text taken in segments of window starts."""
    if len(off) > 2 or len(data) <= SEGMENT + window:
        return anchors(data, off, window)
    parts = []
    for lo in range(0, len(data) - window + 1, SEGMENT):
        piece = data[lo:lo + SEGMENT + window - 1]
        text, h, p, i0, i1 = anchors(piece, np.array([0, len(piece)]), window)
        parts.append((text, h, p + lo, i0 + lo, i1 + lo))
    return tuple(np.concatenate(x) for x in zip(*parts))


def own_repeats(data: np.ndarray, off: np.ndarray, found: tuple[np.ndarray, ...], window: int = WINDOW):
    """Split ``anchors`` into those that go on and runs (text, lo, hi) of windows that repeat inside their text.

    Equal passages at equal distance from anchors of one hash hold equal windows; the first goes on for all.
    """
    text, h, p, i0, i1 = found
    none = np.zeros(0, np.int64)
    _, back, count = np.unique(mix(h ^ mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[back] > 1)
    if not len(some):
        return found, (none, none, none)
    t, a, z = text[some], i0[some], i1[some]
    shape = (p[some] - a).astype(np.uint64) * W.GOLDEN + (z - a).astype(np.uint64)
    whole = mix(W.span_hash(data, off[t] + a, off[t] + z + window) ^ mix(shape) ^ mix(t.astype(np.uint64) * W.GOLDEN))
    _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    stay = np.ones(len(text), bool)
    stay[some[twice]] = False
    stay[some[first]] = True
    t, a, z = t[twice], a[twice], z[twice]
    by = np.lexsort((a, t))
    t, a, z = t[by], a[by], z[by]
    begin = np.append(True, (t[1:] != t[:-1]) | (a[1:] > z[:-1] + 1)) if len(t) else np.zeros(0, bool)
    lo = np.flatnonzero(begin)
    runs = (t[lo], a[lo], z[np.append(lo[1:], len(t)) - 1]) if len(t) else (none, none, none)
    return tuple(x[stay] for x in found), runs


def _anchor_lists(text: np.ndarray, columns: dict[str, np.ndarray], n: int) -> pa.Array:
    count = np.bincount(text, minlength=n)
    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)


def _features(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_slices(batches, "text", 1 << 19):
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:z]).digest()[:16] for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
            (text, h, p, i0, i1), (own, lo, hi) = own_repeats(data, off, _text_anchors(data, off, window), window)
            runs = _anchor_lists(own, {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}, len(sha))
            lists = _anchor_lists(text, {"h": h.view(np.int64), "p": p.astype(np.int32), "i0": i0.astype(np.int32), "i1": i1.astype(np.int32)}, len(sha))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sha, pa.binary()), pa.array(np.diff(off).astype(np.int64)), lists, runs],
                                             names=["doc_id", "k", "n_bytes", "anchors", "own"])
    return run


# ---------------------------------------------------------------- passages and cells


def _list_column(batch: pa.RecordBatch, name: str):
    """Parent row and fields of a list-of-struct column; null lists are empty."""
    col = batch.column(name)
    off = col.offsets.to_numpy()
    length = np.diff(off)
    if col.null_count:
        length = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, length)
    rows = np.repeat(np.arange(len(col)), length)
    values = col.flatten()
    return rows, {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


def _cut(name: str, group: str, window: int):
    """Passages of the anchors in list column ``name``: (g, k, p, i0, i1, passage bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            rows, a = _list_column(batch, name)
            keys = batch.column("k")
            raw = memoryview(data)
            base = off[rows]
            lo, hi = (base + a["i0"]).tolist(), (base + a["i1"] + window).tolist()
            for s in range(0, len(rows), 8192):
                part = slice(s, s + 8192)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[group][part]), keys.take(pa.array(rows[part])), pa.array(a["p"][part], pa.int32()), pa.array(a["i0"][part], pa.int32()),
                     pa.array(a["i1"][part], pa.int32()), pa.array([bytes(raw[x:z]) for x, z in zip(lo[part], hi[part])], pa.binary())],
                    names=["g", "k", "p", "i0", "i1", "passage"])
    return run


PASSAGE = "g bigint, k binary, p int, i0 int, i1 int, passage binary"
CELL = "g bigint, same bigint, k binary, h bigint, p int, i0 int, i1 int"


def _cells(width: int, window: int):
    """Cells of the anchors in list column ``hot``: key of the bytes all its windows share, and of all its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            rows, a = _list_column(batch, "hot")
            for lo, hi in slices(off, 4 << 20):
                mine = slice(*np.searchsorted(rows, [lo, hi]))
                row = rows[mine]
                if not len(row):
                    continue
                bytes_ = data[off[lo]:off[hi]]
                p, i0, i1, h = (a[c][mine].astype(np.int64) for c in ("p", "i0", "i1", "h"))
                first, last = (p - i1) // width, (p - i0) // width
                n = last - first + 1
                which = np.repeat(np.arange(len(row)), n)
                cell = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                low = np.maximum(i0[which], p[which] - cell * width - width + 1)
                high = np.minimum(i1[which], p[which] - cell * width)
                base = off[row[which]] - off[lo]
                core = W.span_hash(bytes_, base + p[which] - cell * width, base + p[which] - cell * width - width + 1 + window)
                whole = W.span_hash(bytes_, base + low, base + high + window)
                g = mix(core ^ mix(h[which].view(np.uint64) + cell.astype(np.uint64) * W.GOLDEN))
                same = mix(whole ^ mix((p[which] - low).astype(np.uint64)))
                for s in range(0, len(which), 16384):
                    part = slice(s, s + 16384)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[part].view(np.int64)), pa.array(same[part].view(np.int64)), batch.column("k").take(pa.array(row[which][part])),
                         pa.array(h[which][part])] + [pa.array(x[part].astype(np.int32)) for x in (p[which], low, high)],
                        names=["g", "same", "k", "h", "p", "i0", "i1"])
    return run


# ---------------------------------------------------------------- the columns of a collection


def repeated_windows(group: np.ndarray, p: np.ndarray, i0: np.ndarray, i1: np.ndarray, passages: list[bytes], window: int = WINDOW):
    """(passage, first window, last window) of all runs of repeated windows among passages of equal group.

    The passages are aligned at their anchors. Rounds go from the last column to the first. Passages of several
    groups may be built together: equal windows have equal anchors, so only one group's can match.
    """
    m = len(passages)
    lead, size = (p - i0).astype(np.int64), (i1 - i0 + window).astype(np.int64)
    left = int(lead.max())
    width = left + int((size - lead).max())
    aligned = np.full((m, width), END, np.uint16)
    for row, begin, passage in zip(aligned, (left - lead).tolist(), passages):
        row[begin:begin + len(passage)] = np.frombuffer(passage, np.uint8)
    columns = np.ascontiguousarray(aligned.T)
    del aligned
    # before the first round: empty suffixes, by group; ``common`` is of a suffix and the one before it
    order = np.argsort(group, kind="stable")
    common = np.zeros(m + 1, np.int32)
    common[0] = common[m] = -(1 << 20)
    jmin, jmax = (p - i1).astype(np.int64), lead
    hits_p, hits_j = [], []
    for c in range(width - 1, -1, -1):
        j = left - c  # the column's suffixes begin j places before the anchor
        symbol = columns[c][order]
        after = np.argsort(symbol, kind="stable")
        # common prefix with the next suffix of the same symbol: the least value between them
        least = np.minimum.reduceat(common, np.minimum(after + 1, len(order)))
        sorted_symbol = symbol[after]
        new = np.zeros(len(order) + 1, np.int32)  # different symbols: nothing in common
        new[0] = new[-1] = -(1 << 20)
        equal = sorted_symbol[1:] == sorted_symbol[:-1]
        new[1:-1][equal] = least[:-1][equal] + 1
        order, common = order[after], new
        if j < 0:
            continue
        match = common >= window
        hit = match[:-1] | match[1:]
        if hit.any():
            own = order[hit]
            own = own[(jmin[own] <= j) & (j <= jmax[own])]
            hits_p.append(own)
            hits_j.append(np.full(len(own), j))
        if j % 8 == 0:  # passages that can no longer share a window leave
            near = np.maximum(common[:-1], common[1:])
            stay = (near + (jmax[order] - j) >= window) & (near >= j) & (jmax[order] > j)
            if not stay.all():
                kept = np.flatnonzero(stay)
                if len(kept) < 2:
                    break
                inner = np.minimum.reduceat(common, np.append(kept[:-1] + 1, kept[-1] + 1))
                common = np.concatenate([[-(1 << 20)], inner[:-1], [-(1 << 20)]]).astype(np.int32)
                order = order[kept]
    if not hits_p:
        return [np.zeros(0, np.int64)] * 3
    own, j = np.concatenate(hits_p), np.concatenate(hits_j)
    start = p[own] - j
    by = np.lexsort((start, own))
    own, start = own[by], start[by]
    begin = np.append(True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(own)) - 1
    return own[first], start[first], start[last]


def _collect(window: int):
    """Passages sorted by g in, runs (k, lo, hi) of repeated window starts out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collected(batches, window)
    return run


def _collected(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def build(table: pa.Table):
        group = table.column("g").to_numpy()
        # groups of one passage have nothing to share
        alone = np.append(True, group[1:] != group[:-1]) & np.append(group[1:] != group[:-1], True)
        table = table.filter(pa.array(~alone))
        if not table.num_rows:
            return None
        p, i0, i1 = (table.column(c).to_numpy().astype(np.int64) for c in ("p", "i0", "i1"))
        own, lo, hi = repeated_windows(table.column("g").to_numpy(), p, i0, i1, table.column("passage").to_pylist(), window)
        if not len(own):
            return None
        keys = table.column("k").combine_chunks().take(pa.array(own))
        return pa.RecordBatch.from_arrays([keys, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["k", "lo", "hi"])

    def ready(final: bool):
        """Cut off as many whole groups as make a batch."""
        nonlocal held
        table = pa.Table.from_batches(held)
        while table.num_rows and (final or table.num_rows >= BATCH_PASSAGES):
            group = table.column("g").to_numpy()
            edges = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group) if final else [])
            if not len(edges):
                break
            k = max(int(np.searchsorted(edges, BATCH_PASSAGES, "right")) - 1, 0)
            cut = int(edges[k])
            if (out := build(table.slice(0, cut))) is not None:
                yield out
            table = table.slice(cut)
        held = table.to_batches() if table.num_rows else []

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_PASSAGES:
                yield from ready(False)
    if held:
        yield from ready(True)


# ---------------------------------------------------------------- the operator


def _split_hot(texts: DataFrame, window: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Split the anchors in ``hot`` (those of large groups) of ``texts``; returns resolved runs and passages to compare.

    Only texts that have such anchors are read again; the first round needs no join, as they carry their lists.
    """
    runs, passages = [], []
    held = settle(texts.where("size(hot) > 0").select("k", "text", "hot"), "repeat-hot-texts")
    asked = held
    for width in cell_widths(window):
        if asked.isEmpty():
            break
        cells = stage(asked.mapInArrow(released(_cells(width, window)), CELL), "repeat-cells")
        kinds = stage(cells.groupBy("g", "same").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "p", "i0", "i1")).alias("one")), "repeat-kinds")
        equal = kinds.where("n > 1").select("g", "same")
        runs.append(cells.join(equal, ["g", "same"]).select("k", F.col("i0").alias("lo"), F.col("i1").alias("hi")))
        groups = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
        several = stage(kinds.join(groups, "g").select("g", "kinds", "one.*"), "repeat-several")
        ship = several.where(f"kinds <= {GROUP}").groupBy("k").agg(F.collect_list(F.struct("g", "p", "i0", "i1")).alias("cells"))
        passages.append(held.select("k", "text").join(ship, "k").mapInArrow(released(_cut("cells", "g", window)), PASSAGE))
        listed = stage(several.where(f"kinds > {GROUP}").groupBy("k").agg(F.collect_list(F.struct("h", "p", "i0", "i1")).alias("hot")), "repeat-hot")
        asked = held.select("k", "text").join(listed, "k")
    return runs, passages


def find_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(runs, copied): lists of runs (lo, hi) of window starts that occur elsewhere, by text key; and keys of
    the texts of a window or more that several rows hold. Both are staged; steps are deleted."""
    first_step = staged_so_far()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    features = stage(docs.mapInArrow(_features(window), f"doc_id bigint, k binary, n_bytes bigint, anchors array<{ANCHOR}>, own array<struct<lo:int,hi:int>>"), "repeat-features")
    distinct = settle(features.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"),
                                                F.first("own").alias("own")), "repeat-texts")
    exploded = distinct.select("k", "rep", F.explode("anchors").alias("a")).select("k", "rep", "a.*")
    counted = settle(exploded.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "repeat-anchors")
    asked = (exploded.join(counted, "h").groupBy("k", "rep")
             .agg(F.collect_list(F.when(F.col("c") <= GROUP, F.struct("h", "p", "i0", "i1"))).alias("few"),
                  F.collect_list(F.when(F.col("c") > GROUP, F.struct("h", "p", "i0", "i1"))).alias("hot")))
    held = docs.withColumn("k", text_key(F.col("text")))
    # texts whose only repeats are inside them are cut later, so they are kept as well
    inner = distinct.where("size(own) > 0").select("k", F.col("rep").alias("_rep"), "own")
    asked = asked.join(inner, "k", "full_outer").select(F.col("k").alias("_k"), F.coalesce("rep", "_rep").alias("_one"), "few", "hot", "own")
    # texts are joined alike at every size: both sides shuffled, neither sent whole to the other
    texts = settle(held.join(asked.hint("merge"), (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_one")))
                   .select("k", "text", "few", "hot", "own"), "repeat-passages")
    few = texts.where("size(few) > 0").select("k", "text", "few").mapInArrow(released(_cut("few", "h", window)), PASSAGE)
    runs, passages = _split_hot(texts, window)
    for extra in passages:
        few = few.unionByName(extra)
    found = few.repartition("g").sortWithinPartitions("g", "k", "p", "i0").mapInArrow(released(_collect(window)), "k binary, lo int, hi int")
    for extra in [texts.select("k", F.explode("own").alias("r")).select("k", "r.*"), *runs]:
        found = found.unionByName(extra)
    spans = settle(found.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "repeat-runs")
    copied = distinct.where(f"copies > 1 and n_bytes >= {window}").select(F.col("k").alias("_k"), F.lit(True).alias("_copied"))
    spans, copied = finish(first_step, spans.select(F.col("k").alias("_k"), "runs"), copied)
    return spans, copied


def removed_spans(lo: np.ndarray, hi: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte ranges from runs of repeated window starts."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(lo, kind="stable")
    lo, end = lo[by].astype(np.int64), hi[by].astype(np.int64) + window
    reach = np.maximum.accumulate(end)
    begin = np.append(True, lo[1:] > reach[:-1])
    first = np.flatnonzero(begin)
    return lo[first], reach[np.append(first[1:], len(lo)) - 1]


def _kept(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(data) + 1, np.int64)
    mark[start] += 1
    mark[end] -= 1
    return data[np.cumsum(mark[:-1]) == 0]


def _whole_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without the bytes of code points that they hold in part only."""
    tail = np.append((data & 0xC0) == 0x80, False)  # bytes inside a code point
    while tail[start].any():
        start = start + tail[start]
    while tail[end].any():
        end = end - tail[end]
    return start, end


def _spans(batch: pa.RecordBatch, text: pa.Array, window: int):
    """(bytes, starts, ends of the removed ranges) of each row's text, from its ``runs`` and ``_copied``."""
    data, off = utf8(text)
    owner, run = _list_column(batch, "runs")
    first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for i, whole in enumerate(batch.column("_copied").to_pylist()):
        part = data[off[i]:off[i + 1]]
        if whole:
            yield part, np.array([0]), np.array([len(part)])
        else:
            yield part, *removed_spans(run["lo"][first[i]:first[i + 1]], run["hi"][first[i]:first[i + 1]], window)


def _with_runs(docs: DataFrame, columns: list[str], window: int) -> DataFrame:
    """``_row`` (a struct of ``columns``, whatever they are called), ``runs`` and ``_copied`` of every row of ``docs``."""
    spans, copied = find_repeats(docs, window)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).withColumn("_k", text_key(F.col("_row.text")))
    return (keyed.join(spans.hint("merge"), "_k", "left")
            .join(copied.hint("merge"), "_k", "left").select("_row", "runs", "_copied"))


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_kept bigint, text string"


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            out = []
            for data, start, end in _spans(batch, row.field("text"), window):
                rest = _kept(data, start, end).tobytes()
                text = _kept(data, *_whole_points(data, start, end)).tobytes().decode() if len(start) else rest.decode()
                out.append((len(data), len(data) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), len(rest), text))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([row.field("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text"])
    return run


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, text`` for every row of ``docs``.

    ``n_kept`` counts the bytes that are left, which ``kept_sha256`` digests; ``text`` is what is left as text, where a code
    point goes only when all its bytes do. Null texts are empty. Repeated rows are other places, so a text of ``window`` bytes
    or more that occurs in two rows goes whole in both; shorter texts hold no such string and stay. An empty table gives an
    empty result. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_runs(docs, ["doc_id", "text"], window).mapInArrow(released(_digests(window)), DIGEST)


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``_row`` with its text less the repeated bytes; a code point goes only when all its bytes do."""
        for batch in batches:
            row = batch.column("_row")
            at = row.type.get_field_index("text")
            text = row.field(at)
            out = []
            for i, (data, start, end) in enumerate(_spans(batch, text, window)):
                out.append(_kept(data, *_whole_points(data, start, end)).tobytes().decode() if len(start) else text[i].as_py())
            fields = [pa.array(out, f.type) if k == at else row.field(k) for k, f in enumerate(row.type)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["_row"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every byte string of ``window`` bytes that occurs again cut out of ``text``; rows and other columns stay.

    Null and empty texts stay as they are. Of repeated rows of ``window`` bytes or more nothing is left. An empty table gives an empty one.
    """
    met = _with_runs(docs, docs.columns, window)
    return met.mapInArrow(released(_strip(window)), met.select("_row").schema).select("_row.*")
