"""Every stage of the corpus pipeline against a brute-force version on the smallest tables."""

import os

import pytest

import corpus_pipeline as P
from tests.llm.helpers import words
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_similar import brute_components
from tests.llm.test_text_operators import brute_rules
from threadloom.llm import queries as Q
from threadloom.llm import quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages_one_by_one(spark, tmp_path):
    docs = Q.table(spark, SF, "documents")
    columns = docs.columns
    results = [docs]
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, results[-1], SF).write.parquet(str(tmp_path / f"{k}-{name}"))
        results.append(spark.read.parquet(str(tmp_path / f"{k}-{name}")))
    rows = [{r["doc_id"]: r for r in x.collect()} for x in results[:5]]
    for x in results[:5]:
        assert x.columns == columns
    good = {r["doc_id"] for r in Q.QUERIES["op5_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert set(rows[1]) == good and 0 < len(good) < len(rows[0])
    labels = {r["doc_id"]: r["quality"] for r in Q.table(spark, SF, "labels").collect()}
    clean = [d for d, q in labels.items() if q == 1 and d in rows[0]]
    assert len(good & set(clean)) >= 0.98 * len(clean)
    kept = set()
    for d, r in rows[1].items():
        n, chars, symbols, dup, rep = brute_rules(r["text"])
        lines = sum(bool(words(x)) for x in (r["text"] or "").split("\n"))
        alpha = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words(r["text"]))
        shout = sum(len(w.encode()) > 2 and w.endswith("!!") for w in words(r["text"]))
        if not (n < 20 or 100 * rep > 30 * n or 5 * symbols > n or (lines > 3 and 2 * dup > lines) or chars < 2 * n
                or chars > 20 * n or 2 * alpha < n or 2 * shout > n):
            kept.add(d)
    assert set(rows[2]) == kept
    ids = sorted(rows[2])
    assert set(rows[3]) == {ids[c] for _, _, c in brute_components([rows[2][d]["text"] for d in ids])}
    ids = sorted(rows[3])
    assert set(rows[4]) == set(ids)
    for d, (raw, mask) in zip(ids, brute_repeats([rows[3][d]["text"] for d in ids], P.REPEAT_BYTES)):
        at, rest = 0, []
        for c in raw.decode():
            size = len(c.encode())
            if not mask[at:at + size].all():
                rest.append(c)
            at += size
        assert rows[4][d]["text"] == "".join(rest) and rows[4][d]["n_chars"] == len(rest)
    pieces = {}
    for r in results[5].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {d: "".join(r["text"] for r in sorted(x, key=lambda r: r["piece"])) for d, x in pieces.items()} == \
        {d: r["text"] for d, r in rows[4].items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_run_equals_the_stages(spark):
    docs = Q.table(spark, SF, "documents")
    for _, f in P.STAGES[:4]:
        docs = f(spark, docs, SF)
    want = {(r["doc_id"], len(words(r["text"]))) for r in docs.collect()}
    got = {(r["doc_id"], r["n"]) for r in P.run(spark, SF).groupBy("doc_id").agg({"n_units": "sum"}).withColumnRenamed("sum(n_units)", "n").collect()}
    assert got == want


def test_rules_are_the_published_ones():
    assert [r.name for r in quality_rules.RULES[:2]] == ["too_short", "repeats"]
