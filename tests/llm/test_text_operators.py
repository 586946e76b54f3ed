"""License scan, fingerprints, quality, tokens, chat and packing against brute force and libraries."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, frame, prose, words
from threadloom.llm import byte_bpe, chat, licenses, packing, parsing, quality_model, quality_rules, token_files
from threadloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def by_id(df):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = r
    return out


# ---------------------------------------------------------------- 2


def fold(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_licenses_equal_brute_containment(spark):
    r = random.Random(4)
    texts = list(AWKWARD)
    for k in range(60):
        parts = [prose(100 + k, r.randint(0, 90))]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(licenses.TEMPLATES)[1], prose(300 + k, r.randint(0, 60))]
        texts.append(" ".join(parts))
    expected = set()
    for i, t in enumerate(texts):
        w = fold(t or "")
        inside = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        for name, template in licenses.TEMPLATES:
            v = fold(template)
            own = {tuple(v[j:j + 5]) for j in range(len(v) - 4)}
            if len(own & inside) >= 0.8 * len(own):
                expected.add((i, name))
    got = {(x["doc_id"], x["license"]) for x in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got == expected and len(expected) > 20


@have_tables
def test_licenses_on_documents(spark):
    docs = Q.table(spark, SF, "documents")
    seen = {(r["doc_id"], r["license"]) for r in Q.QUERIES["op2_license_scan"](spark, SF).collect()}
    for name, text in licenses.TEMPLATES[:4]:
        for r in docs.where(F.col("text").contains(text)).select("doc_id").collect():
            assert (r["doc_id"], name) in seen


def test_licenses_null_and_repeated_ids_and_empty_table(spark):
    name, text = licenses.TEMPLATES[0]
    rows = [(None, text), (None, text), (None, None), (4, text), (4, text), (4, "clean words only here today"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert got == [(4, name), (4, name), (None, name), (None, name)]  # a row for each document row
    assert licenses.scan_licenses(docs.where("false")).collect() == []


# ---------------------------------------------------------------- 3


def test_fingerprint_neighbours(spark):
    texts = AWKWARD + [prose(k, 80 + 13 * k) for k in range(30)]
    got = by_id(parsing.compare_neighbours(frame(spark, texts)))
    plain = by_id(parsing.fingerprint(frame(spark, texts)))
    assert len(got) == len(texts)
    sketches = parsing.text_sketches([t or "" for t in texts])
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        row = got[i]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == plain[i]["fingerprint"] == parsing.fingerprint_text(sketches[i])
        assert row["edited_fingerprint"] == parsing.fingerprint_text(parsing.text_sketches([edited])[0])
        assert row["near_next"] == parsing.likeness(sketches[i], parsing.text_sketches([following])[0])
        assert 0 <= row["near_edited"] <= 1
    assert got[16]["fingerprint"] == got[17]["fingerprint"] and got[16]["near_next"] == 1.0


def test_fingerprint_is_local():
    base, other = prose(1, 900), prose(2, 900)
    one = lambda t: parsing.text_sketches([t])[0]
    assert parsing.likeness(one(base), one("zz " + base)) > 0.85
    assert parsing.likeness(one(base), one(base[:4000] + "QQ" + base[4000:])) > 0.85
    assert parsing.likeness(one(base), one(other)) < 0.3
    assert parsing.likeness(one("a" * 5000), one("a" * 5001)) < 1.0


def test_fingerprint_ties_nulls_and_empty(spark):
    rows = [(None, "n1", 0), (3, "b", 0), (3, "a", 0), (3, "a", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _key int")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["edited_sha256"]) for r in parsing.compare_neighbours(df).collect())
    order = ["n1", "a", "a", "b", ""]
    want = [hashlib.sha256(parsing.edited_text(t, order[(i + 1) % 5]).encode()).hexdigest() for i, t in enumerate(order)]
    assert got == sorted(zip([-1, 3, 3, 3, 5], want))
    assert parsing.compare_neighbours(df.where("false")).collect() == []


# ---------------------------------------------------------------- 5


@have_tables
def test_classifier_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = Q.QUERIES["op5_quality_classifier"](spark, sf).join(Q.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifier_edges(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality_model.score_documents(docs, none).collect()} == {0.5}
    assert quality_model.score_documents(docs.where("false"), none).collect() == []
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1), (3, 0)], "doc_id bigint, quality int")
    assert len(quality_model.score_documents(docs, odd).collect()) == len(AWKWARD)


def test_classifier_takes_one_row_of_a_repeated_id(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    good, bad = prose(3, 60), "# * $ " * 12
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    # ids whose rows differ, copies of a row, and an id that holds a third of all rows
    rows = [(i, good if i % 2 else bad) for i in ids] + [(i, good) for i in ids[::7]] + [(ids[0], prose(n, 9)) for n in range(100)]
    models = []
    for k in (0, 1):
        random.Random(k).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3 + 4 * k)
        models.append(quality_model.train(quality_rules.measure(docs), labels))
    assert models[0] == models[1] and models[0].rules


def test_filters_keep_rows_and_columns(spark):
    """Stages of a pipeline return the columns of their input, also ones named like their own."""
    docs = frame(spark, AWKWARD + [prose(k, 60) for k in range(10)])
    labels = spark.createDataFrame([(i, int(i >= len(AWKWARD))) for i in range(len(AWKWARD) + 10)], "doc_id bigint, quality int")
    for kept in (quality_model.filter_documents(docs, labels), quality_rules.filter_documents(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert {r["n_words"] for r in rows} == {-1}
        assert {r["doc_id"] for r in rows} >= set(range(len(AWKWARD), len(AWKWARD) + 10))
    assert quality_rules.filter_documents(docs.where("false")).collect() == []


def test_compiled_rules_equal_the_model():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    model = quality_model.fit(x, y, ["words", "symbols", "repeats"])
    total = np.full(800, model.intercept)
    for w, tests in model.rules:
        hold = np.ones(800, bool)
        for name, above, cut in tests:
            v = x[:, ["words", "symbols", "repeats"].index(name)]
            hold &= (v > cut) if above else (v <= cut)
        total += w * hold
    assert ((total > 0) == (y > 0.5)).mean() > 0.97
    assert 0 < len(model.rules) < 150


# ---------------------------------------------------------------- 6


def brute_rules(text):
    text = text or ""
    w = words(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    marked = {p for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_rule_statistics(spark):
    r = random.Random(1)
    bits = ["a", "b", "a a a a b b b b ", "\n", "é ", " ", "#", "\t", "x\n", "line one\n", "!!", "😀"]
    texts = AWKWARD + ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = by_id(quality_rules.judge(frame(spark, texts)))
    for i, t in enumerate(texts):
        want = brute_rules(t)
        row = got[i]
        assert [row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]] == want, repr(t)
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_cascade_order_never_changes_verdicts(spark):
    docs = frame(spark, AWKWARD + [prose(k, 30) for k in range(10)])
    stats = quality_rules.measure(docs).cache()
    a = stats.select("doc_id", quality_rules.verdict(list(quality_rules.RULES)).alias("k")).collect()
    b = stats.select("doc_id", quality_rules.verdict(list(reversed(quality_rules.RULES))).alias("k")).collect()
    assert sorted(a) == sorted(b) and {r["k"] for r in a} == {True, False}
    assert set(quality_rules.plan_cascade(docs)) == set(quality_rules.RULES)
    assert quality_rules.plan_cascade(docs.where("false")) == list(quality_rules.RULES)
    want = {r["doc_id"] for r in a if r["k"]}
    assert {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()} == want
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        packed = quality_rules.row_struct(docs)
        rows = packed.mapInArrow(quality_rules._cascade(list(order)), packed.select("_row").schema).select("_row.*")
        assert {r["doc_id"] for r in rows.collect()} == want


def test_cascade_orders_by_rejection_per_cost(spark):
    """A cheap rule that rejects much comes before a costly one that rejects nothing, and reads no other statistics."""
    docs = frame(spark, ["a b c"] * 50 + [prose(k, 400) for k in range(50)])
    cheap, dear = quality_rules.Rule("cheap", "n_words < 20"), quality_rules.Rule("dear", "n_repeat_words > 10 * n_words")
    assert [r.name for r in quality_rules.plan_cascade(docs, (dear, cheap))] == ["cheap", "dear"]
    texts = quality_rules.Texts(np.frombuffer(b"a b cd e", np.uint8), np.array([0, 3, 8]))
    assert texts.rejected(cheap).all() and set(texts.known) == {"n_words"}


@have_tables
def test_clean_documents_are_kept(spark):
    sf = SF.replace("0.001", "0.01")
    rows = Q.QUERIES["op6_quality_rules"](spark, sf).join(Q.table(spark, sf, "labels"), "doc_id").where("quality = 1 and not base_failed").collect()
    assert sum(not r["kept"] for r in rows) <= 0.005 * len(rows)


# ---------------------------------------------------------------- 7


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer
    path = Q.tokenizer("word_bpe_49k.json")
    texts = AWKWARD + ["<|endoftext|> A<|ENDOFTEXT|>b", "İ ΣΑΣ Å H̱ x,y. Z., q."] + [prose(k, 50) for k in range(30)]
    manifest = token_files.write_token_files(frame(spark, texts), path, str(tmp_path / "out")).cache()
    want = [e.ids + [2] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = by_id(token_files.read_digests(manifest))
    start = 0
    for i, ids in enumerate(want):
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)), i
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = {r["doc_id"]: r["ids"] for r in token_files.read_documents(manifest, [3, 21, 21, 40, 999]).collect()}
    assert some == {k: want[k] for k in (3, 21, 40)}
    # the files are plain zstandard to any reader: skippable frames are passed over
    import zstandard
    for f in sorted(r["path"] for r in manifest.collect())[:2]:
        reader = token_files.Reader(f)
        own = [int(d) for d in reader.docs[:, 0]]
        with open(f, "rb") as raw:
            flat = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert np.frombuffer(flat, "<u4").tolist() == [i for d in own for i in want[d]]


def test_token_files_edges(spark, tmp_path):
    path = Q.tokenizer("word_bpe_49k.json")
    rows = [(None, "a b"), (7, "c"), (7, "c"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(token_files.read_digests(token_files.write_token_files(df, path, str(tmp_path / "x"))).collect())
    assert [r["n_tokens"] for r in got] == [3, 2, 2, 1] and [r["start"] for r in got] == [0, 3, 5, 7]
    assert token_files.read_digests(token_files.write_token_files(df.where("false"), path, str(tmp_path / "y"))).collect() == []


def test_damaged_frame_is_noticed(tmp_path):
    f = str(tmp_path / "one.zst")
    w = token_files.Writer(f)
    w.add(1, np.arange(500, dtype=np.uint32))
    w.add(2, np.arange(3, dtype=np.uint32))
    w.close()
    r = token_files.Reader(f)
    assert r.ids(1).tolist() == [0, 1, 2] and r.find(2) == [1] and r.find(5) == []
    r.frames[0, 2] ^= 1
    with pytest.raises(ValueError):
        r.ids(0)


# ---------------------------------------------------------------- 8


def test_byte_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken
    path = Q.tokenizer("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = AWKWARD + ["don't we'll  x", "".join(chr(r.randint(1, 0x2FFF)) for _ in range(3000)), "".join(r.choice("abcdefgh") for _ in range(1500))]
    texts += [prose(k, 60) for k in range(20)]
    df = frame(spark, texts)
    got = by_id(byte_bpe.round_trip_digests(df, path, public_tokenizers.PATTERN))
    ids = by_id(byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN))
    back = by_id(byte_bpe.decode_documents(byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN), path))
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i]["ids"] == want
        assert bytes(back[i]["bytes"]) == (t or "").encode()
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe_long_pieces_equal_matrix(spark):
    ranks = byte_bpe.load_ranks(Q.tokenizer("byte_bpe_50k.tiktoken"))
    r = random.Random(6)
    for n in (5, 60, 300):
        piece = "".join(r.choice("theandriosn") for _ in range(n))
        flat, _ = byte_bpe.encode_pieces(ranks, [piece])
        assert flat.tolist() == byte_bpe._merge_long(ranks, ranks.single[np.frombuffer(piece.encode(), np.uint8)]).tolist()


def test_byte_bpe_null_and_repeated_ids_and_empty_table(spark):
    import public_tokenizers
    path = Q.tokenizer("byte_bpe_50k.tiktoken")
    rows = [(None, "one text"), (None, None), (3, "one text"), (3, "one text"), (3, "another")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = byte_bpe.round_trip_digests(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in out) == sorted(
        (str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    empty = docs.where("false")
    assert byte_bpe.round_trip_digests(empty, path, public_tokenizers.PATTERN).collect() == []
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN), path).collect() == []


# ---------------------------------------------------------------- 9


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\l\\\\e<\\", "a\n<|next|>", "\\", "\\n", "ü😀 [x]"]
    rows, r = [], random.Random(2)
    for c in range(40):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|"]), r.choice(nasty), "extra"))
    rows += [(None, 0, "user", "x", ""), (50, None, "assistant", "first", ""), (50, 1, "assistant", "second", ""), (50, 1, "assistant", "second", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    back = {x["conv_id"]: x for x in chat.read_chat(chat.format_chat(df)).collect()}
    assert len(back) == 42
    for c in {x[0] for x in rows}:
        own = sorted([(-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c])
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(a, b) for _, a, b in own]
        assert back[c]["loss_text"] == "".join(b for _, a, b in own if a == "assistant")
        assert back[c]["formatted"].count("<|turn|>") == 1 + sum(own[i][1] != own[i - 1][1] for i in range(1, len(own)))
        for bad in ("</s>", "[INST]"):
            assert bad not in back[c]["formatted"]
    assert chat.format_chat(df.where("false")).collect() == []


# ---------------------------------------------------------------- 10


def test_packing_keeps_everything(spark):
    texts = AWKWARD + [prose(k, 5 + 37 * k % 900) for k in range(120)] + [prose(7, 9000)]
    out = packing.pack_documents(frame(spark, texts).repartition(3), with_text=True).collect()
    bins = collections.defaultdict(list)
    docs = collections.defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for rows in bins.values():
        assert len({r["bin_capacity"] for r in rows}) == 1
        used = 0
        for r in sorted(rows, key=lambda r: (r["bin_offset"], r["n_units"])):
            assert r["bin_offset"] == used
            used += r["n_units"]
        sizes = [c for c in packing.CAPACITIES if c >= used]
        assert rows[0]["bin_capacity"] == min(sizes)  # downsized to its contents
    assert set(docs) == set(range(len(texts)))
    for i, t in enumerate(texts):
        rows = sorted(docs[i], key=lambda r: r["piece"])
        assert "".join(r["text"] for r in rows) == (t or "")
        assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_units"] for r in rows])[:-1])
        assert sum(r["n_units"] for r in rows) == len(words(t))
    waste = 1 - sum(len(words(t)) for t in texts) / sum(r[0]["bin_capacity"] for r in bins.values())
    assert waste < 0.1
    assert packing.pack_documents(frame(spark, texts).where("false")).collect() == []


def test_packing_is_best_fit():
    placed, caps = packing.pack_lengths([60, 50, 40, 30], (100,))
    assert caps == [100, 100]
    assert {(i, b) for i, _, _, _, b, _ in placed} == {(0, 0), (1, 1), (2, 0), (3, 1)}
    placed, caps = packing.pack_lengths([30], (32, 64, 128))
    assert caps == [32]
