"""Conversation repair, URL filter and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, DOC_SCHEMA, frame, prose
from threadloom.llm import queries, repair, spelling, urls

# ---------------------------------------------------------------- repair

LEGAL_END = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired) by trying every list of edits of a few rows, two insertions at each place at most."""
    best = None
    gaps = [""] + ["u", "a", "ua", "au"]
    options = []
    for role, text, gone, cut in rows:
        mine = [("D", None, 2)]
        if not gone:
            mine += [("K", role, 5 * cut)] + [("R", r, 1 + 5 * cut) for r in ("user", "assistant")]
        options.append(mine)
    names = {"u": "user", "a": "assistant"}
    for gap in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, gap)) > 2:
            continue
        for pick in itertools.product(*options):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                cost += 5 * len(gap[i])
                audit += "I" * len(gap[i])
                out += [(names[x], "") for x in gap[i]]
                if i < len(rows):
                    edit, role, c = pick[i]
                    cost, audit = cost + c, audit + edit
                    if edit != "D":
                        out.append((role, rows[i][1]))
            if LEGAL_END.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def dynamic(rows, start, ends):
    """Least (cost, audit) by a plain table over (row, state); rows are (initial, must go, truncated)."""
    nodes = {start: (0, "")}

    def closure(nodes):
        for _ in range(4):
            for q, (cost, audit) in list(nodes.items()):
                to = repair.NEEDED[q][1]
                nodes[to] = min(nodes.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return nodes

    for letter, gone, cut in rows:
        nodes, old = {}, closure(nodes)
        for q, (cost, audit) in old.items():
            moves = [(q, 2, "D")]
            if not gone:
                if q in repair.FOLLOWS.get(letter, {}):
                    moves.append((repair.FOLLOWS[letter][q], 5 * cut, "K"))
                moves.append((repair.NEEDED[q][1], 1 + 5 * cut, "R"))
            for to, add, edit in moves:
                nodes[to] = min(nodes.get(to, (10**9, "")), (cost + add, audit + edit))
    nodes = closure(nodes)
    return min((nodes[q] for q in ends if q in nodes), default=None)


def random_rows(r, n):
    return [(r.choice("uasx"), r.random() < 0.15, r.random() < 0.15) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_a_table(seed):
    r = random.Random(seed)
    for _ in range(150):
        rows = random_rows(r, r.randint(0, 14))
        assert repair.search(rows, repair.START, repair.WHOLE)[:2] == dynamic(rows, repair.START, repair.WHOLE)
    rows = random_rows(r, 300)
    assert repair.search(rows, repair.START, repair.WHOLE)[:2] == dynamic(rows, repair.START, repair.WHOLE)
    for start in range(4):
        for goal in range(4):
            found = repair.search(rows[:40], start, (goal,))
            assert found[:2] == dynamic(rows[:40], start, [goal]) if found else dynamic(rows[:40], start, [goal]) is None


def test_bounds_never_exceed_the_cost():
    r = random.Random(9)
    for _ in range(200):
        rows = random_rows(r, r.randint(0, 9))
        bound = repair.lower_bounds(rows, repair.WHOLE)
        for i in range(len(rows) + 1):
            for q in range(4):
                assert bound[i][q] <= dynamic(rows[i:], q, repair.WHOLE)[0]


def brute_repair(turns, conversations):
    out = []
    for conv in {c for c, *_ in conversations}:
        rows = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in turns if c == conv]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
        known, faults, counts = set(), [], Counter()
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in known else "truncated" if solid[-1] not in ".!?" else ""
            known.add((role, text))
            counts[fault] += 1
            faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        at = [t for t, *_ in rows if t is not None]
        letters = [r[:1] or "?" for _, r, _ in rows]
        cost, audit, fixed = cheapest(faults)
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string, c string, k int, block int, lo int, audit string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2, 3, "q") for r in rows], TURNS)


@pytest.mark.parametrize("block", [256, 2])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    """Also with blocks of two rows, joined two at a time."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", 2)
    r = random.Random(4)
    texts = [None, "", " \n", "Yes.", "no", "Fine!\n", "long " * 50 + "?", "é.", "a:b\nuser:c."]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(r.randint(1, 5)):
            turn = r.choice([None, 0, 1, 2, 3, 7])
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), r.choice(texts)))
    lost = [(99, 0, "user", "x"), (99, 0, "user", "x")]
    got = sorted(map(tuple, repair.repair_digests(turn_frame(spark, rows), turn_frame(spark, rows + lost)).collect()), key=str)
    assert got == brute_repair(rows, rows + lost)


def test_repaired_turns_follow_the_pattern(spark):
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "system"]), f"t{t % 7}." if t % 5 else "cut") for c in (1, 2) for t in range(700)]
    rows += [(3, 0, "user", "same.")] * 1000
    plans = repair.repair_plans(turn_frame(spark, rows)).cache()
    turns = repair.repaired_turns(turn_frame(spark, rows), plans).collect()
    for conv in "12":
        mine = sorted((x for x in turns if x["c"] == conv), key=lambda x: x["at"])
        assert [x["at"] for x in mine] == list(range(len(mine)))
        assert LEGAL_END.fullmatch("".join(x["role"][0] for x in mine))
    plan = {p["c"]: p for p in plans.collect()}
    seen, flags = set(), []
    for _, _, role, text in [x for x in rows if x[0] == 1]:
        flags.append((role[0], (role, text) in seen, text == "cut" and (role, text) not in seen))
        seen.add((role, text))
    assert (plan["1"]["cost"], plan["1"]["audit"]) == dynamic(flags, repair.START, repair.WHOLE)
    assert (plan["3"]["n"], plan["3"]["duplicate"], plan["3"]["cost"]) == (1000, 999, 2000)
    plans.unpersist()


def test_repair_of_nothing(spark):
    assert repair.repair_digests(turn_frame(spark, []), turn_frame(spark, [])).collect() == []


def test_damage_is_by_crc(spark):
    rows = [(c, t, "assistant", f"Hi! {c}.{t}?") for c in (0, 5, None) for t in [*range(30), None]]
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            want += [(c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    got = [tuple(x)[:4] for x in queries.damaged(turn_frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- URLs

URLS = [None, "", "no scheme", "http://", "://", "http://A.Com", "http://a.com/", "HTTP://x.A.COM/en/?q=://b", "https://www.example.com/en/a#f", "ftp://b.example.com:80/en/",
        "https://é.example.net/es/ü", "http://net/es/", "http://.net/es/", "http://a..net/fr/x", "x://a.net?/es/", "x://a.net/es", "http://xnet/es/", "http://a.com/\n/en/",
        "http://" + "a." * 300 + "com/" + "p/" * 2000, "http://a.com/日本/x", "http://a.com/日", "http://ÀB.com/", "http://a.com//"]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    n, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def random_rules(seed):
    r = random.Random(seed)
    hosts = ["com", "a.com", "net", "", "example.net", "é.example.net", "..net", "x"]
    return sorted({(r.choice(hosts) + r.choice(["", "/", "/es/", "/en", "/日", "/p/p/", "//", "/" + "p/" * 500]), ) for _ in range(40)})


@pytest.mark.parametrize("seed,list_bytes", [(1, 1 << 20), (2, 0), (3, 0)])
def test_urls_equal_brute_force(spark, monkeypatch, seed, list_bytes):
    """Also with a list that is joined by a shuffle, its most frequent keys apart."""
    monkeypatch.setattr(urls, "LIST_BYTES", list_bytes)
    monkeypatch.setattr(urls, "HOT_ROWS", 2)
    monkeypatch.setattr(urls, "HOT_KEYS", 3)
    rules = [(rule, random.Random(rule).choice(["allow", "block"])) for (rule,) in random_rules(seed)]
    pages = [(i if i % 5 else None, u, "h", 1, "x", "y") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string, _row int, rule string, hits string")
    listed = spark.createDataFrame([*rules, *rules[:3], (None, "block")], "rule string, verdict string")
    got = sorted((tuple(x) for x in urls.judge_urls(df, listed).collect()), key=str)
    assert got == sorted(((p, *brute_url(u, rules)) for p, u, *_ in pages), key=str)


def test_rules_of_the_query(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    assert sorted(map(tuple, urls.judge_urls(df, rules).collect())) == sorted((i, *brute_url(u, queries.URL_RULES)) for i, u in enumerate(URLS))
    assert urls.judge_urls(df.where("false"), rules).collect() == []
    none = urls.judge_urls(df, rules.where("false"), default="block").collect()
    assert {(x["rule"], x["verdict"]) for x in none} == {(None, "block")} and len(none) == len(URLS)
    both = spark.createDataFrame([("com/", "allow"), ("com/", "block")], "rule string, verdict string")
    assert {x["verdict"] for x in urls.judge_urls(df.where("url = 'http://a.com/'"), both).collect()} == {"block"}


def test_filter_holds_all_keys_and_few_others(spark):
    keys = urls.listed_keys(spark.range(3000).selectExpr("concat('h', id % 700, '.org/p', id) as rule", "'block' as verdict"))
    filled = urls.blocked_filter(keys, 3000)
    from threadloom.llm import words as W

    def hashes(names):
        raw = [n.encode() for n in names]
        off = np.cumsum([0] + [len(x) for x in raw])
        return W.span_hash(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])

    rows = keys.collect()
    assert urls.may_hold(filled, urls.url_key(hashes([r["host"] for r in rows]), hashes([r["path"] for r in rows]))).all()
    assert urls.may_hold(filled, urls.host_key(hashes([f"q{i}" for i in range(20000)]))).mean() < 0.01


# ---------------------------------------------------------------- spelling


def edits_of_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(docs, damage=True, least_length=5, least_count=3):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if edits_of_one(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def letters_corpus(seed, n=60):
    """Words over few letters, so that most have many near words of very different counts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abéÿ") for _ in range(r.randint(4, 9))) for _ in range(120)] + ["a" * k for k in range(4, 12)]
    docs = [" ".join(r.choice(words[:r.choice([5, 20, 128])]) for _ in range(r.randint(0, 150))) for _ in range(n)]
    return [(i, d if i % 7 else d.upper()) for i, d in enumerate(docs)] + [(None, "aaaaa×÷ĀA aaaaa ÉÉÉÉÉ-aaaaa"), (None, None), (3, ""), (3, "abab" * 5000 + " ") , (4, ("x" + "ab" * 700 + " ") * 4)]


def doc_frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "w", 3, "k", 4, 5, 6, 7) for i, t in docs], DOC_SCHEMA)


@pytest.mark.parametrize("seed,cell,symbols", [(1, 16384, 1 << 17), (2, 3, 1 << 17), (3, 16384, 40)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, cell, symbols):
    """Also with halves that are cut into grids of cells, and with many small shards."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", cell)
    monkeypatch.setattr(spelling, "SHARD_SYMBOLS", symbols)
    docs = letters_corpus(seed)
    got = spelling.variant_groups(doc_frame(spark, docs), damage=spelling.drop_one_letter(97)).collect()
    assert sorted(map(tuple, got)) == brute_groups(docs)


def test_variants_of_short_words(spark):
    docs = [(i, "a b ab ba aab abab b a é ée e") for i in range(3)]
    got = spelling.variant_groups(doc_frame(spark, docs), least_length=1, least_count=1).collect()
    assert sorted(map(tuple, got)) == brute_groups(docs, False, 1, 1)


def test_variants_of_awkward_texts(spark):
    texts = AWKWARD + [prose(1, 400)] * 3
    got = spelling.variant_groups(frame(spark, texts), damage=spelling.drop_one_letter(97)).collect()
    assert sorted(map(tuple, got)) == brute_groups(list(enumerate(texts)))
    assert spelling.variant_groups(frame(spark, texts).where("false")).collect() == []


def test_suffix_order():
    r = random.Random(2)
    for n in (1, 2, 30, 300):
        text = np.array([r.randint(1, 3) for _ in range(n)] + [0])
        assert spelling.suffix_order(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
