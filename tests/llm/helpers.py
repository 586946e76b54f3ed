"""Fixtures of the operator tests: awkward rows, invented prose, brute-force word helpers."""

import random
import re

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _slice int, words string, n_words int, _k string, _kept int, bits int, runs int, t int"
SYLLABLES = ["ka", "mo", "ri", "ten", "sul", "pra", "vé", "dor", "ini", "ö", "lu", "st"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, texts):
    """documents with clashing extra columns; ids are positions."""
    rows = [(i, t, "en", "s", None if t is None else len(t), -5, "x", -1, "k", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


AWKWARD = [None, "", " ", "\n", "a", "a a", "é", "x\ny\n", "\t\x0b\x0c\r", "word " * 3000, "q" * 20000, "😀😀 ok", "a b c",
           "line\nline\nline\nother", "!! ?? ##", "\\e\\l<[</s>", "Same text here", "Same text here", "ab" * 900, "́é"]


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
