"""Operator 6: quality rules as a short-circuit cascade ordered by rejection per cost.

A ``Rule`` is a named rejecting predicate over statistics of a text; the statistics come in groups, each
with a kernel of its own. ``plan_cascade`` times every rule with the kernels it needs, and counts what it
rejects, on a bounded sample, and orders the rules by rejections per second. ``filter_documents`` runs
the order as a cascade: a rule's statistics are computed only for texts that no earlier rule rejected.
``judge`` reports all statistics of every text and the verdict as one nested CASE. The order changes
cost only, never a verdict: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.common import text_slices

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_alpha_words bigint, n_shouted_words bigint"
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 65_536  # texts, and their greatest length, that costs and selectivities are estimated on
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the statistics, read by Spark and by pandas; ``about`` says what it looks for."""
    name: str
    rejects: str
    about: str = ""


BASE_RULES = (
    Rule("too_short", "n_words < 20", "fewer than 20 words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "over 30 % of words in repeated 8-word windows"),
)
RULES = BASE_RULES + (
    Rule("symbols", "5 * n_symbols > n_words", "over one markup symbol for five words"),
    Rule("dup_lines", "n_lines > 3 and 2 * n_dup_lines > n_lines", "over half of the lines repeat earlier ones"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", "mean word length outside 2 to 20"),
    Rule("no_letters", "2 * n_alpha_words < n_words", "under half of the words hold a letter"),
    Rule("shouting", "2 * n_shouted_words > n_words", "over half of the words end in !!"),
)


def _line_counts(data: np.ndarray, off: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word for each text, and those equal to an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    # every text ends a line: boundaries of all lines, tagged with the text they lie in
    begin = np.concatenate([off[:-1], breaks + 1])
    begin.sort(kind="stable")
    text = np.searchsorted(off, begin, "right") - 1
    # a break that is the last byte of a text begins an empty line which searchsorted gives to a later text
    stop = np.concatenate([begin[1:], [len(data)]])
    stop = np.minimum(stop, len(data))
    last_of_line = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(data) else stop
    words = np.searchsorted(start, last_of_line) - np.searchsorted(start, begin)
    keep = (words > 0) & (text < len(off) - 1)
    begin, last_of_line, text = begin[keep], last_of_line[keep], text[keep]
    lines = np.bincount(text, minlength=len(off) - 1)
    if not len(begin):
        return lines, np.zeros(len(off) - 1, np.int64)
    h = W.span_hash(data, begin, last_of_line)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return lines, np.bincount(text[order][1:][same], minlength=len(off) - 1)


class Texts:
    """Concatenated texts with the groups of statistics computed on demand, each once."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.start, self.end, self.at = W.word_spans(data, off)
        self.known: dict[str, np.ndarray] = {"n_words": np.diff(self.at)}

    def _chars(self):
        data = self.data
        solid = ~W.SPACE[data] & ((data & 0xC0) != 0x80)
        return {"word_chars": W.counts_per(self.off, solid), "n_symbols": W.counts_per(self.off, SYMBOL[data])}

    def _lines(self):
        lines, dup = _line_counts(self.data, self.off, self.start, self.at)
        return {"n_lines": lines, "n_dup_lines": dup}

    def _repeats(self):
        return {"n_repeat_words": W.repeated_words(W.span_hash(self.data, self.start, self.end), self.at)}

    def _kinds(self):
        data, start, end = self.data, self.start, self.end
        if len(start):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(LETTER[data], out=total[1:])
            alpha = total[end] > total[start]
            shout = (end - start > 2) & (data[end - 1] == 33) & (data[np.maximum(end - 2, 0)] == 33)
        else:
            alpha = shout = np.zeros(0, bool)
        return {"n_alpha_words": W.counts_per(self.at, alpha), "n_shouted_words": W.counts_per(self.at, shout)}

    GROUPS = {"word_chars": _chars, "n_symbols": _chars, "n_lines": _lines, "n_dup_lines": _lines, "n_repeat_words": _repeats,
              "n_alpha_words": _kinds, "n_shouted_words": _kinds}

    def stat(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known.update(self.GROUPS[name](self))
        return self.known[name]

    def rejected(self, rule: Rule) -> np.ndarray:
        """Which texts the rule rejects; computes only the statistics it names."""
        columns = {n: self.stat(n) for n in STAT_NAMES if re.search(rf"\b{n}\b", rule.rejects)}
        return pd.DataFrame(columns).eval(rule.rejects).to_numpy(bool)

    def only(self, keep: np.ndarray) -> Texts:
        """The texts of ``keep`` alone."""
        return Texts(self.data[np.repeat(keep, np.diff(self.off))], np.concatenate([[0], np.cumsum(np.diff(self.off)[keep])]))


def text_stats(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for each text."""
    texts = Texts(data, off)
    return [texts.stat(n) for n in STAT_NAMES]


def _measure(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_slices(batches, "text"):
            stats = [pa.array(x, pa.int64()) for x in text_stats(data, off)]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in columns] + stats, names=columns + STAT_NAMES)
    return run


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """The statistics of every whole text, with ``carry`` columns (``doc_id`` if none is named).

    Null and empty texts have zeros throughout. Rows stay as they are, repeated ones included;
    no shuffle.
    """
    columns = list(carry) or ["doc_id"]
    picked = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join([f"`{c}` {dict(picked.dtypes)[c]}" for c in columns] + [STATS])
    return picked.mapInArrow(_measure(columns), schema)


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by estimated rejection per cost, best first, from a bounded sample of ``docs``.

    The sample is the first ``sample_rows`` texts of at most SAMPLE_CHARS characters, read from as few
    partitions as hold them. A rule's cost is the time of the kernels it needs and of its condition. On
    an empty table the given order stays.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS).limit(sample_rows).collect()
    if not rows:
        return list(rules)
    raw = [r["text"].encode() for r in rows]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    scored = []
    for rule in rules:
        texts = Texts(data, off)  # words are cut for every rule, so that is no rule's own cost
        began = time.perf_counter()
        n = int(texts.rejected(rule).sum())
        scored.append((n / max(time.perf_counter() - began, 1e-6), rule))
    return [r for _, r in sorted(scored, key=lambda x: -x[0])]


def verdict(order: list[Rule]) -> Column:
    """False at the first rule of ``order`` that rejects, else true; later rules are not evaluated."""
    case = None
    for rule in order:
        test = F.coalesce(F.expr(rule.rejects), F.lit(False))
        case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every document.

    Null and empty texts have no words, so ``too_short`` rejects them. An empty table gives an
    empty result. Extra columns are ignored; duplicate rows are judged alike.
    """
    order = plan_cascade(docs, rules, sample_rows)
    failed = " or ".join(f"({r.rejects})" for r in BASE_RULES)
    return measure(docs).withColumn("base_failed", F.expr(failed)).withColumn("kept", verdict(order))


def _cascade(order: list[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_slices(batches, "text"):
            alive = np.arange(rows.num_rows)
            texts = Texts(data, off)
            for rule in order:
                out = texts.rejected(rule)
                if out.any():
                    alive = alive[~out]
                    texts = texts.only(~out)
                if not len(alive):
                    break
            if len(alive):
                yield rows.take(pa.array(alive)).select(["_row"])
    return run


def filter_documents(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with their columns, by the short-circuit cascade.

    Whole rows travel as one struct, whatever their columns are called. No shuffle.
    """
    order = plan_cascade(docs, rules, sample_rows)
    packed = row_struct(docs)
    return packed.mapInArrow(_cascade(order), packed.select("_row").schema).select("_row.*")


def row_struct(docs: DataFrame) -> DataFrame:
    """``docs`` as (``_row``: all its columns as a struct, ``text``)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
