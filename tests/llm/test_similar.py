"""The Jaccard join against all pairs on small fixtures, and its parts."""

import random

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, frame, prose, shingle_set
from threadloom.llm import jaccard
from threadloom.llm import words as W
from threadloom.llm.common import components


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(text, r, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(10**6))
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    passage = prose(99, 40)
    texts = list(AWKWARD)
    for k in range(40):
        base = prose(seed * 1000 + k, r.randint(3, 300))
        texts.append(base)
        if k % 3 == 0:
            texts += [edited(base, r, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]
        if k % 4 == 0:
            texts += [base, base.upper()]
        if k % 2:
            texts.append(prose(seed * 1000 + 500 + k, r.randint(5, 60)) + " " + passage)
    chain = prose(seed + 7, 200).split()  # a drifting chain: neighbours link, ends do not
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + prose(seed * 77 + k, 4).split()
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed)
    got = sorted(tuple(r) for r in jaccard.similar_groups(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_blocks_of_a_hot_group(spark, monkeypatch):
    """Groups over BLOCK rows are dealt into blocks without losing a link."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    r = random.Random(3)
    base = prose(5, 120)
    texts = [edited(base, r, 0.012) for _ in range(40)] + corpus(4)
    got = sorted(tuple(x) for x in jaccard.similar_groups(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_without_leaders_or_frequent_list(spark, monkeypatch):
    """First components and the frequent list only save work."""
    monkeypatch.setattr(jaccard, "LEADERS", 0)
    monkeypatch.setattr(jaccard, "FREQUENT_AT", 10**6)
    texts = corpus(5)
    got = sorted(tuple(x) for x in jaccard.similar_groups(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_ids_nulls_and_empty(spark):
    a, b = prose(1, 30), prose(2, 30)
    rows = [(None, a), (None, None), (4, a), (4, b), (9, b), (9, b), (2, None), (2, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in jaccard.similar_groups(df).collect()}
    assert got == {(None, 26, None), (None, 0, None), (4, 26, 2), (9, 26, 2), (2, 0, 2), (2, 26, 2)}
    assert jaccard.similar_groups(df.where("false")).collect() == []
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in jaccard.keep_one_of_each(df).collect() if r["doc_id"] is not None)
    assert kept == [(False, 2)]


def test_keep_one_of_each_keeps_columns(spark):
    texts = corpus(6)
    kept = jaccard.keep_one_of_each(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(texts)})


def test_tree_never_prunes_a_link():
    r = random.Random(8)
    texts = [t for t in corpus(8) if t and t.split()]
    data = "\x00".join(texts).encode()
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raw])
    sets = W.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, 5)
    del data, r
    wide = [jaccard.signature(s) for s in sets]
    bits = np.stack([jaccard.fold(w, jaccard.BITS) for w in wide])
    n = np.array([len(s) for s in sets])
    i, j = jaccard.tree_pairs(bits, n, np.arange(len(n)), np.zeros(len(n), int))
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    pairs = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                pairs += 1
                assert (a, b) in found
                assert jaccard.reachable([w.tobytes() for w in (wide[a], wide[b])], n[[a, b]], np.array([0]), np.array([1])).all()
    assert pairs > 50 and len(found) < 0.2 * len(sets) ** 2 / 2


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
