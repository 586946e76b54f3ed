"""Operator 8: byte-level BPE encoding and decoding on length-bucketed matrices.

A text is split by the public pattern into pieces; the distinct new pieces of a batch are put into
buckets of similar length, one padded matrix of token ids a bucket. Each round looks up the rank of
every neighbouring pair in a hash table, and every row merges its leftmost pair of least rank and
closes the gap; rows with no pair left leave the matrix. A piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from threadloom.llm.tokens import PieceCodes, ragged_take

NONE = np.int32(0x7FFFFFFF)
MATRIX_CELLS = 1 << 18  # cells of one matrix
LONG = 512  # bytes from which a piece is merged alone, with a heap over the same pair ranks
BATCH_CHARS = 1 << 20


class Ranks:
    """A rank file: token bytes, single-byte ids, and a hash table from id pairs to the merged id."""

    def __init__(self, path: str):
        fs, path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with fs.open_input_file(path) as f:
            lines = f.read().splitlines()
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        size = max(self.rank.values()) + 1
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.length = np.array([len(t) for t in token], np.int64)
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        keys, merged = [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        self._build(np.array(keys, np.uint64), np.array(merged, np.int32))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing, all keys placed together, round by round."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = np.uint64((1 << bits) - 1)
        self._key = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self._value = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self._probes = 0
        while len(todo):
            self._probes += 1
            free = self._key[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            now = todo[free]
            self._key[slot[now]] = keys[now]  # of keys for one slot, the last stays
            self._value[slot[now]] = merged[now]
            won = self._key[slot[now]] == keys[now]
            todo = np.concatenate([todo[~free], now[~won]])
            slot[todo] = (slot[todo] + np.uint64(1)) & self._mask

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair of ids, or NONE; padding (-1) has none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        slot = self._slot(key)
        out = np.where(self._key[slot] == key, self._value[slot], NONE)
        open_ = np.flatnonzero((self._key[slot] != key) & (self._key[slot] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self._probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + np.uint64(1)) & self._mask
            found = self._key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._value[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def _merge_matrix(ranks: Ranks, ids: np.ndarray, length: np.ndarray) -> None:
    """Merge every row of ``ids`` (padded with -1) in place until no pair has a rank."""
    width = ids.shape[1]
    live = np.flatnonzero(length > 1)
    work, n = ids[live], length[live]
    pair = np.full((len(live), width), NONE, np.int32)
    pair[:, :-1] = ranks.pair(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(len(live), width - 1)
    columns = np.arange(width)
    while len(live):
        best = pair.argmin(1)  # argmin takes the leftmost of equal ranks
        rows = np.arange(len(live))
        rank = pair[rows, best]
        done = rank == NONE
        if done.any():
            ids[live[done]] = work[done]
            length[live[done]] = n[done]
            keep = ~done
            live, work, pair, n, best, rank = live[keep], work[keep], pair[keep], n[keep], best[keep], rank[keep]
            if not len(live):
                return
            rows = np.arange(len(live))
        work[rows, best] = rank
        # close the gap behind the merged symbol
        source = np.minimum(columns + (columns > best[:, None]), width - 1)
        work = np.take_along_axis(work, source, 1)
        pair = np.take_along_axis(pair, source, 1)
        n = n - 1
        work[rows, n] = -1
        pair[rows, n] = NONE
        pair[rows, n - 1] = NONE
        right = best < n - 1
        r = rows[right]
        pair[r, best[right]] = ranks.pair(work[r, best[right]], work[r, best[right] + 1])
        left = best > 0
        r = rows[left]
        pair[r, best[left] - 1] = ranks.pair(work[r, best[left] - 1], work[r, best[left]])
        # compaction: drop columns that no row needs any more
        widest = int(n.max())
        if widest < width - 8 and widest < 3 * width // 4:
            ids[live, widest:] = -1
            ids[live, :widest] = work[:, :widest]
            _narrow(ranks, ids, length, live, n, widest)
            return


def _narrow(ranks: Ranks, ids, length, live, n, width: int) -> None:
    """Go on with the live rows in a narrower matrix."""
    part, part_n = ids[live, :width + 1].copy(), n.copy()
    _merge_matrix(ranks, part, part_n)
    ids[live, :width + 1] = part
    length[live] = part_n


def _merge_long(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    n = len(ids)
    tok, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    first = ranks.pair(ids[:-1], ids[1:]).tolist()
    heap = [(r, i, tok[i], tok[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def rank(a, b):
        if (a, b) not in known:
            known[a, b] = int(ranks.pair(np.array([a]), np.array([b]))[0])
        return known[a, b]

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if tok[i] != a or j >= n or tok[j] != b:
            continue
        tok[i], tok[j] = r, -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (s := rank(r, tok[nxt[i]])) != NONE:
                heapq.heappush(heap, (s, i, r, tok[nxt[i]]))
        if prv[i] >= 0 and (s := rank(tok[prv[i]], r)) != NONE:
            heapq.heappush(heap, (s, prv[i], tok[prv[i]], r))
    return np.array([t for t in tok if t >= 0], np.int32)


def encode_pieces(ranks: Ranks, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all pieces, in order, and the number of ids of each."""
    raw = [p.encode() for p in pieces]
    out: list = [None] * len(raw)
    todo = []
    for i, b in enumerate(raw):
        whole = ranks.rank.get(b)
        if whole is not None:
            out[i] = (whole,)
        elif not b:
            out[i] = ()
        else:
            todo.append(i)
    todo.sort(key=lambda i: len(raw[i]))
    lo = 0
    while lo < len(todo):
        size = len(raw[todo[lo]])
        if size >= LONG:
            for i in todo[lo:]:
                out[i] = _merge_long(ranks, ranks.single[np.frombuffer(raw[i], np.uint8)])
            break
        hi, widest = lo, size + max(1, size // 4)  # a bucket: lengths from size to a quarter more
        while hi < len(todo) and len(raw[todo[hi]]) <= widest and (hi - lo) * (widest + 1) < MATRIX_CELLS:
            hi += 1
        rows = todo[lo:hi]
        length = np.array([len(raw[i]) for i in rows], np.int64)
        ids = np.full((len(rows), int(length.max()) + 1), -1, np.int32)
        ids[np.arange(ids.shape[1]) < length[:, None]] = ranks.single[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
        _merge_matrix(ranks, ids, length)
        for k, i in enumerate(rows):
            out[i] = ids[k, :length[k]]
        lo = hi
    lengths = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate([np.asarray(x, np.uint32) for x in out]) if out else np.zeros(0, np.uint32), lengths


def decode(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """The bytes of a sequence of ids."""
    return ragged_take(ranks.bytes, ranks.start[ids], ranks.length[ids])


def _batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        lo = size = 0
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for k, t in enumerate(texts):
            size += len(t)
            if size >= BATCH_CHARS or k == len(texts) - 1:
                yield batch.column("doc_id").slice(lo, k + 1 - lo), texts[lo:k + 1]
                lo, size = k + 1, 0


@lru_cache(maxsize=4)  # a worker keeps the pieces it knows for its next tasks
def splitter(rank_file: str, pattern: str):
    """The function that splits a text by ``pattern``, and the codes of the pieces."""
    import regex

    ranks = load_ranks(rank_file)
    return regex.compile(pattern).findall, PieceCodes(lambda pieces: encode_pieces(ranks, pieces))


def _run(rank_file: str, pattern: str, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(rank_file)
        split, codes = splitter(rank_file, pattern)
        for ids, texts in _batches(batches):
            flat, lengths = codes.ids([split(t) for t in texts])
            yield emit(ranks, ids, flat, lengths)
    return run


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row; a null or empty text has no ids. No shuffle.

    Each row stands for itself: null and repeated doc_ids keep all their rows, an empty table gives none."""
    def emit(ranks, doc_id, flat, lengths):
        off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(_run(rank_file, pattern, emit), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_documents(tokens: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id, bytes`` of every row of ``doc_id, ids``; null ids decode to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(rank_file)
        for batch in batches:
            data = [decode(ranks, np.array(x or [], np.int64)).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, encoded and decoded in one pass."""
    def emit(ranks, doc_id, flat, lengths):
        data = decode(ranks, flat.astype(np.int64)).tobytes()
        packed = flat.astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        size = np.concatenate([[0], np.cumsum(ranks.length[flat.astype(np.int64)])])
        cut = size[at].tolist()
        return pa.RecordBatch.from_arrays([
            doc_id, pa.array(lengths, pa.int64()),
            pa.array([hashlib.sha256(packed[4 * a:4 * z]).hexdigest() for a, z in zip(at, at[1:])], pa.string()),
            pa.array([hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(cut, cut[1:])], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(
        _run(rank_file, pattern, emit), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
