"""Operator 5: quality classifier as a sparse rule ensemble.

Shallow boosted trees over text statistics give candidate rules (every root-to-node path is a
conjunction of thresholds); an L1-penalised logistic regression keeps a sparse weighted set of
them; the set is compiled into one Spark column expression, so scoring is JVM-side and the model
that travels is a short text. Labels, language, source and ids are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stage
from threadloom.llm.quality_rules import measure, row_struct

MAX_LABELLED = 6_000  # labelled rows that are gathered to fit the model, chosen by hash of doc_id
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 4e-3, 400
CUT = 0.3

# Statistics the rules read; SQL over the columns of ``quality_rules.measure``.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "double(word_chars) / greatest(n_words, 1)",
    "symbols": "double(n_symbols) / greatest(n_words, 1)",
    "symbol_chars": "double(n_symbols) / greatest(word_chars, 1)",
    "dup_lines": "double(n_dup_lines) / greatest(n_lines, 1)",
    "repeats": "double(n_repeat_words) / greatest(n_words, 1)",
    "line_words": "double(n_words) / greatest(n_lines, 1)",
    "letter_words": "double(n_alpha_words) / greatest(n_words, 1)",
    "shouted": "double(n_shouted_words) / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class RuleModel:
    """intercept + sum of weight over the rules that hold; a rule is ((feature, is_above, cut), ...)."""
    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self) -> Column:
        """The probability of label 1 as one expression over ``quality_rules.measure`` columns."""
        terms = [F.lit(float(self.intercept))]
        for weight, tests in self.rules:
            cond = None
            for name, above, cut in tests:
                x = F.expr(FEATURES[name])
                test = x > F.lit(float(cut)) if above else x <= F.lit(float(cut))
                cond = test if cond is None else cond & test
            terms.append(F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # pairwise, so that the expression is as shallow as it can be
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _tree_paths(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path, out, gain, step) -> None:
    """Grow one tree on binned features; append every path to ``out`` and leaf steps to ``step``."""
    best = None
    if depth and len(rows) >= 20:
        g, h = grad[rows], hess[rows]
        parent = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(codes.shape[1]):
            gs = np.cumsum(np.bincount(codes[rows, j], g, BINS + 1))
            hs = np.cumsum(np.bincount(codes[rows, j], h, BINS + 1))
            value = gs ** 2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - parent
            k = int(np.argmax(value[:-1]))
            if best is None or value[k] > best[0]:
                best = (value[k], j, k)
    if best is None or best[0] <= gain:
        step[rows] = -grad[rows].sum() / (hess[rows].sum() + 1.0)
        return
    _, j, k = best
    right = codes[rows, j] > k
    for above in (False, True):
        part = rows[right == above]
        if len(part):
            longer = path + ((j, above, k),)
            out.append(longer)
            _tree_paths(codes, grad, hess, part, depth - 1, longer, out, gain, step)


def _holds(codes: np.ndarray, path) -> np.ndarray:
    mask = np.ones(len(codes), bool)
    for j, above, k in path:
        mask &= (codes[:, j] > k) == above
    return mask


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleModel:
    """Fit the ensemble to features ``x`` and 0/1 labels ``y``; with one class or no rows, a constant."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return RuleModel(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, paths = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(20, len(y) // 2), replace=False)) if len(y) > 40 else np.arange(len(y))
        step, found = np.zeros(len(y)), []
        _tree_paths(codes, p - y, p * (1 - p), rows, DEPTH, (), found, 1e-3, step)
        paths += found
        margin += RATE * step
    paths = list(dict.fromkeys(tuple(sorted(set(p))) for p in paths if all(k < len(cuts[j]) for j, _, k in p)))
    if not paths:
        return RuleModel(base, ())
    masks: dict[bytes, tuple] = {}  # rules that hold on the same rows count once
    for path in paths:
        masks.setdefault(np.packbits(_holds(codes, path)).tobytes(), path)
    paths = list(masks.values())
    zs = np.stack([np.unpackbits(np.frombuffer(m, np.uint8), count=len(y)) for m in masks], 1).astype(np.float64)
    scale = np.maximum(zs.std(0), 1e-6)
    zs /= scale
    w, b, mom, t = np.zeros(zs.shape[1]), base, np.zeros(zs.shape[1]), 1.0
    # largest curvature of the smooth part, by power iteration: the step of the proximal method
    v = np.ones(zs.shape[1])
    for _ in range(20):
        v = zs.T @ (zs @ v)
        v /= np.linalg.norm(v)
    rate = 1.0 / (0.25 * float(v @ (zs.T @ (zs @ v))) / len(y) + 0.25 + 1e-9)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(zs @ mom + b)))
        new = mom - rate * (zs.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        b -= rate * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mom, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    rules = tuple((float(w[i] / scale[i]), tuple((names[j], bool(a), float(cuts[j][k])) for j, a, k in paths[i]))
                  for i in np.flatnonzero(np.abs(w) > 1e-6))
    return RuleModel(float(b), rules)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def train(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> RuleModel:
    """Fit on labelled rows that are not held out, at most ``max_rows`` of them, chosen by id hash.

    Several labels of one document count as their majority; null labels and ids are ignored. Of several rows of one
    doc_id the one with the least statistics is taken, in the order of ``FEATURES``. The labelled ids, at most
    ``max_rows``, are broadcast, so only their rows are grouped.
    """
    known = (labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    names = list(FEATURES)
    found = F.struct(*[F.expr(FEATURES[n]).alias(n) for n in names])
    rows = (stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min(found).alias("_x"))
            .select("doc_id", "_label", "_x.*").toPandas().sort_values("doc_id"))
    return fit(rows[names].to_numpy(np.float64), rows["_label"].to_numpy(np.float64), names)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Texts are read once for their statistics. Null and empty texts have all-zero statistics and are
    scored by them. A null doc_id is not held out. Without usable labels every score is 0.5.
    """
    stats = stage(measure(docs), "quality-stats")
    score = train(stats, labels, max_rows).score()
    return (stats.withColumn("score", score)
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= CUT).cast("int").alias("predicted")))


def filter_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` predicted to be of good quality, with their columns; no text is shuffled."""
    stats = stage(measure(docs), "quality-stats")
    score = train(stats, labels, max_rows).score()
    return measure(row_struct(docs), "_row").where(score >= CUT).select("_row.*")
