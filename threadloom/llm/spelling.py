"""Operator 13: spelling variants by FM-index search schemes over the delimited vocabulary.

Two words are near when they differ by one inserted, deleted or replaced code point. One edit leaves the left or the
right half of a word as it is, so a search matches one half exactly and extends across the other with one error.

1. Words are counted in the tasks that read the texts, then over all documents.
2. A near word of a word shares its left half as a prefix or its right half as a suffix. The vocabulary
   is dealt by those halves: every word under the halves that words of its own, one less and one more length have. Halves with
   more than SHARD_WORDS words are cut into a grid of cells (a slice of the words by a slice of the queries), so a
   cell is bounded whatever share of the vocabulary has one half.
3. A task joins whole cells to shards and builds the FM-index of ``#word#word#...#`` in both directions: suffix
   ranks by prefix doubling, the last column, and one sorted array that gives the rank of a symbol before a place.
   Intervals of the reversed text grow to the right, those of the text to the left. The searches of all queries of a
   shard advance together, as arrays of intervals.
4. What the left search finds begins with the word's left half; the right search leaves those out, so every
   near word is found once, and counts and best forms are plain aggregates.
5. Roots follow forms by pointer doubling: n at least doubles with every form, so a few rounds are enough.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import finish, if_small, settle, stage, staged_so_far

MIN_LENGTH, MIN_COUNT = 5, 3
SHARD_WORDS = 16_384  # words under one half that make one cell
SHARD_SYMBOLS = 1 << 17  # symbols of the cells that are indexed together
QUERIES = 4096  # queries that advance together
FLUSH_WORDS, FLUSH_BYTES = 200_000, 16 << 20
LONG_TEXT = 1 << 20
SMALL_SIDE = 100_000
END, MARK = 0, 1  # codes of the text's end and of the delimiter; letters follow


# ---------------------------------------------------------------- words


def _pattern(least: int) -> re.Pattern:
    """Runs of a-z and U+00C0 to U+00FF in UTF-8 whose A-Z are already lower-cased."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def _length(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def drop_one_letter(every: int) -> Callable[[bytes], Callable[[bytes], bytes]]:
    """Damage for tests of the grouping: a document's runs whose crc32 ``every`` divides lose one code point.

    The crc32 h is of ``<doc_id>:<run>``; the code point is the one at h modulo the run's length.
    """
    def of_document(doc_id: bytes):
        start = zlib.crc32(doc_id + b":")

        def edit(run: bytes) -> bytes:
            h = zlib.crc32(run, start)
            if h % every:
                return run
            letters = run.decode()
            at = h % len(letters)
            return (letters[:at] + letters[at + 1:]).encode()
        return edit
    return of_document


def _count(least: int, damage):
    runs = _pattern(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                raw = (text.as_py() or "").encode().lower()
                # a long text is read match by match, so only its distinct words are held
                own = Counter(runs.findall(raw) if len(raw) < LONG_TEXT else (m.group() for m in runs.finditer(raw)))
                edit = damage(b"" if not doc_id.is_valid else b"%d" % doc_id.as_py()) if damage else None
                for word, n in own.items():
                    if edit is not None and _length(word := edit(word)) < least:
                        continue
                    if word not in total:
                        size += len(word) + 64
                    total[word] += n
                if len(total) >= FLUSH_WORDS or size >= FLUSH_BYTES:
                    yield flush()
                    total, size = Counter(), 0
        if total:
            yield flush()
    return run


def vocabulary(docs: DataFrame, least_length: int = MIN_LENGTH, least_count: int = MIN_COUNT, damage=None) -> DataFrame:
    """``word, n`` of all runs ``[A-Za-z\\u00C0-\\u00FF]+`` (A-Z lower-cased) of ``docs(doc_id, text)`` that are long and frequent enough."""
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count(least_length, damage), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the index


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; the last symbol is the least and occurs once."""
    rank = text.astype(np.int64)
    n, step = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Index:
    """FM-index of a text that ends with END: intervals of suffix ranks grow to the left."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_order(text)
        self.last = text[self.order - 1].astype(np.int64)  # the symbol before each suffix
        self.n, self.symbols = len(text), symbols
        by = np.argsort(self.last, kind="stable")
        self.places = self.last[by] * (self.n + 1) + by

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern: symbols below it and its occurrences before a rank, in one search."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) of all letters that occur before the suffixes of each interval."""
        size = hi - lo
        wide = size > 2 * self.symbols
        narrow = np.flatnonzero(~wide)
        length = size[narrow]
        own = np.repeat(narrow, length)
        at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length) + lo[own]
        key = np.unique(own * self.symbols + self.last[at])
        every = np.flatnonzero(wide)
        key = np.concatenate([key, (every[:, None] * self.symbols + np.arange(self.symbols)).ravel()])
        state, letter = key // self.symbols, key % self.symbols
        keep = letter > MARK
        return state[keep], letter[keep]


def near_in_index(index: Index, flat: np.ndarray, off: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, rank) of delimited words at one edit from a query, the edit beyond its first ``half`` symbols.

    Queries are ``flat[off[q]:off[q + 1]]`` in the order in which the index extends; a symbol below zero does not occur in it.
    """
    length = np.diff(off)
    q = np.arange(len(length))
    zero = np.zeros(len(q), np.int64)
    lo, hi = index.extend(zero, zero + index.n, zero + MARK)

    def step(q, t, lo, hi):
        symbol = flat[off[q] + t]
        lo, hi = index.extend(lo, hi, np.maximum(symbol, 0))
        return np.flatnonzero((hi > lo) & (symbol >= 0)), lo, hi

    # the exact half
    for t in range(int(half.max(initial=0))):
        active = half[q] > t
        ok, lo2, hi2 = step(q[active], t, lo[active], hi[active])
        at = np.flatnonzero(active)[ok]
        lo[at], hi[at] = lo2[ok], hi2[ok]
        keep = ~active
        keep[at] = True
        q, lo, hi = q[keep], lo[keep], hi[keep]
    t = half[q]
    found_q, found_rank = [], []
    eq, et, elo, ehi = (np.zeros(0, np.int64) for _ in range(4))  # searches that have used their error
    while len(q) or len(eq):
        if len(q):
            more = t < length[q]
            own = np.full(len(q), -1)
            own[more] = flat[off[q[more]] + t[more]]
            state, letter = index.letters(lo, hi)
            a, b = index.extend(lo[state], hi[state], letter)
            some = (b > a) & (letter != own[state])
            state, a, b = state[some], a[some], b[some]
            put = more[state]
            following = np.full(len(q), -2)
            next_more = t + 1 < length[q]
            following[next_more] = flat[off[q[next_more]] + t[next_more] + 1]
            gone = np.flatnonzero(more & (following != own))  # of equal symbols the last is deleted
            eq = np.concatenate([eq, q[state], q[state[put]], q[gone]])  # inserted, replaced, deleted
            et = np.concatenate([et, t[state], t[state[put]] + 1, t[gone] + 1])
            elo = np.concatenate([elo, a, a[put], lo[gone]])
            ehi = np.concatenate([ehi, b, b[put], hi[gone]])
            q, t, lo, hi = q[more], t[more], lo[more], hi[more]
            ok, lo, hi = step(q, t, lo, hi)
            q, t, lo, hi = q[ok], t[ok] + 1, lo[ok], hi[ok]
        done = et == length[eq]
        a, b = index.extend(elo[done], ehi[done], np.full(int(done.sum()), MARK))
        hit = b > a
        found_q.append(eq[done][hit])
        found_rank.append(a[hit])
        eq, et, elo, ehi = eq[~done], et[~done], elo[~done], ehi[~done]
        ok, elo, ehi = step(eq, et, elo, ehi)
        eq, et, elo, ehi = eq[ok], et[ok] + 1, elo[ok], ehi[ok]
    return np.concatenate(found_q or [q]), np.concatenate(found_rank or [q])


class Shard:
    """Distinct words with the FM-indexes of their delimited text in both directions."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        size = np.array([len(w) for w in words])
        text = np.full(len(points) + len(words) + 1, MARK, np.int64)
        inside = np.arange(len(points)) + np.repeat(np.arange(len(words)), size) + 1
        text[inside] = np.searchsorted(self.alphabet, points) + 2
        self.text = text
        self.marks = np.cumsum(text == MARK) - 1  # of a delimiter: how many are before it
        self.indexes: dict[bool, Index] = {}

    def index(self, to_right: bool) -> Index:
        if to_right not in self.indexes:
            text = self.text[::-1] if to_right else self.text
            self.indexes[to_right] = Index(np.append(text, END), len(self.alphabet) + 2)
        return self.indexes[to_right]

    def near(self, queries: list[str], left_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of near words; the left half stays as it is, or the right half and what follows the left does not."""
        index = self.index(left_half)
        out_q, out_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(queries), QUERIES):
            part = queries[s:s + QUERIES]
            size = np.array([len(w) for w in part])
            points = np.frombuffer("".join(part if left_half else [w[::-1] for w in part]).encode("utf-32-le"), np.uint32)
            at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            flat = np.where(self.alphabet[at] == points, at + 2, -1)
            half = size // 2 if left_half else size - size // 2
            q, rank = near_in_index(index, flat, np.concatenate([[0], np.cumsum(size)]), half)
            place = index.order[rank]
            word = self.marks[len(self.text) - 1 - place] - 1 if left_half else self.marks[place]
            out_q.append(q + s)
            out_w.append(word)
        return np.concatenate(out_q), np.concatenate(out_w)


# ---------------------------------------------------------------- the search on Spark


def _search(limit: int):
    """Rows (side, half, x, y, word, n, held, asks) sorted by cell in; pairs (word, near, near_n) out; shards of ``limit`` symbols."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, limit)
    return run


def _searched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    symbols = 0

    def build():
        held = {w: n for _, w, n, h, _ in rows if h}
        if not held:
            return
        shard = Shard(sorted(held))
        for left in (True, False):
            asked = sorted({w for side, w, _, _, a in rows if a and side == left})
            if not asked:
                continue
            q, w = shard.near(asked, left)
            pairs = [(asked[i], shard.words[j]) for i, j in zip(q.tolist(), w.tolist())]
            if not left:
                pairs = [(a, b) for a, b in pairs if not b.startswith(a[:len(a) // 2])]
            for s in range(0, len(pairs), 65536):
                part = pairs[s:s + 65536]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in part], pa.string()), pa.array([b for _, b in part], pa.string()),
                                                  pa.array([held[b] for _, b in part], pa.int64())], names=["word", "near", "near_n"])

    cell, own = None, []

    def close():
        """The cell's rows join the shard, unless it is one word alone; a cell of a grid is a shard of its own."""
        nonlocal rows, symbols
        if len({r[1] for r in own}) < 2:
            return
        size = sum(len(r[1]) + 1 for r in own)
        if rows and (cell[2] >= 0 or symbols + size > limit):
            yield from build()
            rows, symbols = [], 0
        rows, symbols = rows + own, symbols + size
        if cell[2] >= 0:
            yield from build()
            rows, symbols = [], 0

    for batch in batches:
        for side, half, x, y, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (side, half, x, y) != cell:
                yield from close()
                cell, own = (side, half, x, y), []
            own.append((side, *rest))
    yield from close()
    yield from build()


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, near, near_n``: every near word of every word of ``vocab(word, n)``, once, with its n.

    ``vocab`` has one row a word (staged by the caller); words of any length from one code point on.
    """
    def half(side: str, by: int) -> str:
        return f"int((length(word) + {by}) div 2)" if side == "left" else f"int(length(word) + {by} - (length(word) + {by}) div 2)"

    def entries(side: str) -> str:
        cut = "left(word, k)" if side == "left" else "right(word, k)"
        sizes = ", ".join(half(side, by) for by in (-1, 0, 1))
        return (f"transform(array_distinct(array({sizes})), k -> struct({str(side == 'left').lower()} as side, {cut} as half, "
                f"k = {half(side, 0)} as asks))")

    dealt = vocab.select("word", "n", F.explode(F.expr(f"concat({entries('left')}, {entries('right')})")).alias("e")).select("word", "n", "e.*")
    large = stage(dealt.groupBy("side", "half").agg(F.count("*").alias("c")).where(f"c > {SHARD_WORDS}")
                  .select("side", "half", F.ceil(F.col("c") / SHARD_WORDS).cast("int").alias("m")), "spelling-large")
    if large.isEmpty():
        cells = dealt.select("side", "half", F.lit(-1).alias("x"), F.lit(-1).alias("y"), "word", "n", F.lit(True).alias("held"), "asks")
    else:
        met = dealt.join(if_small(large, SMALL_SIDE), ["side", "half"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
        met = met.withColumn("own", F.pmod(F.xxhash64("word"), F.col("m")).cast("int"))
        cell = F.expr("if(m = 1, array(struct(-1 as x, -1 as y, true as held, asks as asks)), concat("
                      "transform(sequence(0, m - 1), j -> struct(own as x, j as y, true as held, false as asks)), "
                      "if(asks, transform(sequence(0, m - 1), i -> struct(i as x, own as y, false as held, true as asks)), array())))")
        cells = met.select("side", "half", "word", "n", F.explode(cell).alias("k")).select("side", "half", "k.x", "k.y", "word", "n", "k.held", "k.asks")
    keys = ["side", "half", "x", "y"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(SHARD_SYMBOLS), "word string, near string, near_n bigint")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``links(word, form)``, forms having no cycles, by pointer doubling."""
    roots = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                      "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def variant_groups(docs: DataFrame, least_length: int = MIN_LENGTH, least_count: int = MIN_COUNT, damage=None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs(doc_id, text)``; other columns are ignored.

    ``form`` is the near word of largest n (ties: smallest in code-point order) when that n is at least twice the
    word's own, else null; ``root`` follows forms to the last. Null and empty texts have no words, a null id
    counts as an empty one for ``damage``, rows of one id are counted row by row, and an empty table gives an empty result.
    """
    first_step = staged_so_far()
    vocab = settle(vocabulary(docs, least_length, least_count, damage), "spelling-words")
    pairs = near_words(vocab)
    best = (pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")))
    forms = settle(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                   F.expr("if(-best.less >= 2 * n, best.form, null)").alias("form"), F.expr("if(-best.less >= 2 * n, -best.less, null)").alias("form_n")), "spelling-forms")
    roots = _roots(forms.where("form is not null"))
    out = forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return finish(first_step, out)[0]
