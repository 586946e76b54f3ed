"""Removal of repeated 400-byte strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, frame, prose
from threadloom.llm import repeats

W = repeats.WINDOW


def brute(texts, W=W):
    """(bytes, removed mask) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + W] for b in raw for i in range(len(b) - W + 1))
    out = []
    for b in raw:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - W + 1):
            if seen[b[i:i + W]] > 1:
                mask[i:i + W] = True
        out.append((b, mask))
    return out


def left_text(b, mask):
    """What is left as text: a code point goes only when all its bytes do."""
    at, kept = 0, []
    for c in b.decode():
        size = len(c.encode())
        if not mask[at:at + size].all():
            kept.append(c)
        at += size
    return "".join(kept)


def expected(texts, window=W):
    rows = []
    for i, (b, mask) in enumerate(brute(texts, window)):
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int(np.diff(np.concatenate([[0], mask.astype(int)])).clip(0).sum())
        rows.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), len(kept), left_text(b, mask)))
    return rows


def corpus(seed, n=50):
    r = random.Random(seed)
    passages = [prose(seed * 100 + k, 200).encode()[:size].decode("utf-8", "ignore") for k, size in enumerate((398, 400, 401, 403, 700, 1500))]
    texts = list(AWKWARD) + ["a" * 1000, "a" * 399, "ab" * 700, "x" + "\0" * 450, "line of text\n" * 60, "line of text\n" * 35]
    for k in range(n):
        t = ""
        for _ in range(r.randint(0, 3)):
            t += prose(r.randrange(10**6), r.randint(0, 80)) + r.choice(passages)
        texts.append(t + prose(r.randrange(10**6), r.randint(0, 60)))
    texts += [texts[-1], texts[-1], texts[-2]]
    return texts


@pytest.mark.parametrize("seed,window", [(1, W), (2, W), (3, 200)])
def test_repeats_equal_brute_force(spark, seed, window):
    texts = corpus(seed)
    assert sorted(tuple(r) for r in repeats.repeat_digests(frame(spark, texts), window).collect()) == expected(texts, window)


def test_large_groups_are_split(spark, monkeypatch):
    """Anchors with over GROUP passages go through cells and single windows without losing a byte."""
    monkeypatch.setattr(repeats, "GROUP", 3)
    monkeypatch.setattr(repeats, "BATCH_PASSAGES", 16)
    texts = corpus(3)
    base, r = prose(55, 260), random.Random(9)
    for _ in range(25):  # near copies: every anchor is shared, every passage differs
        w = base.split()
        for _ in range(6):
            w[r.randrange(len(w))] = str(r.randrange(1000))
        texts.append(" ".join(w))
    assert sorted(tuple(x) for x in repeats.repeat_digests(frame(spark, texts)).collect()) == expected(texts)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    texts = [prose(1, 2000), prose(2, 300) + prose(1, 2000)[3000:9000], "z" * 30000, prose(3, 500)]
    assert sorted(tuple(x) for x in repeats.repeat_digests(frame(spark, texts)).collect()) == expected(texts)


def test_ids_nulls_and_empty(spark):
    long = prose(4, 200)
    rows = [(None, long), (None, None), (5, long), (5, long), (6, prose(5, 200)), (6, prose(6, 20)), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in repeats.repeat_digests(df).collect()))
    n, a, b = len(long.encode()), len(prose(5, 200).encode()), len(prose(6, 20).encode())
    assert got == sorted([(False, 0, n, n), (False, 0, 0, 0), (True, 5, n, n), (True, 5, n, n), (True, 6, a, 0), (True, 6, b, 0), (True, 7, 0, 0)])
    assert repeats.repeat_digests(df.where("false")).collect() == []


@pytest.mark.parametrize("window", [W, 200])
def test_remove_repeats_cuts_whole_code_points(spark, window):
    texts = corpus(4)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, texts), window).collect()}
    assert len(got) == len(texts)
    for i, (b, mask) in enumerate(brute(texts, window)):
        assert got[i]["text"] == (None if texts[i] is None else left_text(b, mask))
        assert got[i]["_slice"] == -5


def test_every_window_has_one_anchor():
    raw = [t.encode() for t in corpus(5) if t is not None]
    off = np.cumsum([0] + [len(x) for x in raw])
    text, h, p, i0, i1 = repeats.anchors(np.frombuffer(b"".join(raw), np.uint8), off)
    assert int((i1 - i0 + 1).sum()) == sum(max(0, len(x) - W + 1) for x in raw)
    assert (i0 <= p).all() and (i1 <= p).all() and (p - i0 < repeats.spread(W)).all()
    named = {}
    for t, g, q, a, b in zip(text, h, p, i0, i1):
        for i in range(a, b + 1):
            named.setdefault(raw[t][i:i + W], set()).add((int(g), int(q - i)))
    assert all(len(v) == 1 for v in named.values())
