"""One store for three feeds, incremental windows, and expiry on disk."""

import datetime as dt
import json
import os
import random

from threadloom.plans.stage import scratch_path
from threadloom.operators import thread_index
from threadloom.sources import envelopes, feeds, history
from threadloom.streaming import ingest, purge

T0 = dt.datetime(2026, 8, 1)
SEC = dt.timedelta(seconds=1)


def live(spark, *rows):
    """rows: (event id, channel, ts, text, seconds after T0, thread_ts)."""
    data = [(json.dumps({"type": "events_api", "envelope_id": e, "payload": {
        "type": "event_callback", "team_id": "T", "event_id": e,
        "event": {"type": "message", "channel": c, "ts": ts, "text": x} | ({"thread_ts": th} if th else {})}}), T0 + s * SEC, i)
        for i, (e, c, ts, x, s, th) in enumerate(rows)]
    return envelopes.envelope_payloads(spark.createDataFrame(data, envelopes.LANDED))


def pages(spark, *rows):
    """rows: (page id, channel, root, messages or None for an error, seconds after T0)."""
    data = [(p, "T", c, root, 1, json.dumps({"ok": True, "messages": m} if m is not None else {"ok": False, "error": "nope"}), 200, T0 + s * SEC)
            for p, c, root, m, s in rows]
    return spark.createDataFrame(data, history.PAGE_SCHEMA)


def stored(spark, root):
    return [(r.event_sequence, r.event_id, r.text) for r in ingest.read_messages(spark, root).orderBy("event_sequence").collect()]


def test_feeds_share_identity_and_sequence(spark):
    root = scratch_path(spark, "test", "store")
    write = ingest._write_batch(root)
    newest_first = [{"ts": "10.5", "text": "b", "reply_count": 2}, {"ts": "9.5", "text": "a"}, {"ts": "9.5", "text": "again"},
                    {"type": "join", "ts": "8.5"}, {"ts": 7}, "text", {"ts": "11.5", "thread_ts": "10.5", "text": "reply in history"}]
    write(feeds.all_rows(live(spark, ("e1", "C1", "50.0", "live first", 0, None), ("e2", "C1", "51.0", "later", 90, None)),
                         pages(spark, ("p1", "C1", None, newest_first, 60), ("p0", "C1", None, None, 61))), 0)
    # the event of a message that a page brought, the page of a message that an event brought, a page seen before
    write(feeds.all_rows(live(spark, ("e3", "C1", "9.5", "event too late", 100, None)),
                         pages(spark, ("p2", "C1", None, [{"ts": "50.0", "text": "page too late"}, {"ts": "12.5", "text": "c"}], 99),
                               ("p1", "C1", None, newest_first, 98)),
                         pages(spark, ("r1", "C1", "10.5", [{"ts": "10.5", "text": "b"}, {"ts": "13.5", "thread_ts": "10.5", "text": "d"},
                                                            {"ts": "14.5", "thread_ts": "1.5", "text": "other thread"}], 97))), 1)
    assert [(n, x) for n, _, x in stored(spark, root)] == [
        (1, "live first"), (2, "a"), (3, "b"), (4, "reply in history"), (5, "later"), (6, "d"), (7, "c")]
    assert [(r.page_id, r.error) for r in ingest.read_page_errors(spark, root).collect()] == [("p0", "nope")]
    index = {r.root_ts: (r.observed_reply_count, r.fetched_reply_count) for r in ingest.read_thread_index(spark, root).collect()}
    # the fetch came before the page was seen again, and covers the two replies seen first
    assert index == {"9.5": (0, 0), "10.5": (2, 2), "50.0": (0, 0), "12.5": (0, 0)}
    before = stored(spark, root)
    write(feeds.all_rows(live(spark, ("e3", "C1", "9.5", "event too late", 100, None))), 2)
    assert stored(spark, root) == before


def brute_windows(rows, gap):
    out = []
    for c in sorted({c for c, _ in rows}):
        run = []
        for s in sorted(s for d, s in rows if d == c):
            if run and s - run[-1] > gap:
                out.append((c, run[0], len(run), run[-1]))
                run = []
            run.append(s)
        out.append((c, run[0], len(run), run[-1]))
    return sorted(out)


def test_windows_merge_over_batches_and_days(spark):
    rnd = random.Random(3)
    day = 86400
    rows = [(f"C{rnd.randrange(2)}", day * 20000 + rnd.randrange(3 * day)) for _ in range(120)]
    rows += [("C0", day * 20001 - 1800 * k) for k in range(-4, 5)] + [("C1", day * 20000), ("C1", day * 20000)]
    rnd.shuffle(rows)
    root = scratch_path(spark, "test", "windows")
    write = ingest._write_windows(root, 1800)
    for k in range(3):
        part = [("T", c, f"{s}.5") for c, s in rows[k::3]]
        batch = spark.createDataFrame(part, "workspace_id string, channel_id string, message_ts string")
        write(batch, k)
        if k == 1:
            write(batch, k)  # delivered again
    got = sorted((r.channel_id, r.first_secs, r.n_messages, r.last_secs) for r in ingest.read_windows(spark, root).collect())
    assert got == brute_windows(rows, 1800)
    # a batch meets the windows of its channel and dates only
    one = spark.createDataFrame([("T", "C1", day * 20002 + 40000, day * 20002 + 40000, 1)], ingest.SPANS)
    near = ingest.near_windows(spark, root, one, 1800, 9).collect()
    assert {r.channel_id for r in near} == {"C1"}
    assert all(r.last_secs // day >= 20002 and r.first_secs // day <= 20002 for r in near)
    assert len(near) == sum(c == "C1" and a // day <= 20002 <= b // day for c, a, _, b in got)


LOG = "is_fetch int, workspace_id string, channel_id string, root_ts string, reply_count bigint, latest_reply_ts string, at timestamp"


def walk_index(log):
    """The index by a walk over the log in order of time, an observation before a fetch at one instant."""
    out = {}
    first = lambda v: (v is not None, v)  # noqa: E731  missing values come first
    for is_fetch, w, c, root, n, latest, at in sorted(set(log), key=lambda r: (first(r[6]), r[0], first(r[4]), first(r[5]))):
        seen = out.get((w, c, root))
        if not is_fetch:
            out[w, c, root] = (n, latest, at, *(seen[3:] if seen else (0, None)))
        elif seen:
            out[w, c, root] = (*seen[:3], seen[0], at)
    return out


def as_index(rows):
    return {(r.workspace_id, r.channel_id, r.root_ts): (r.observed_reply_count, r.latest_reply_ts, r.indexed_at, r.fetched_reply_count, r.fetched_at)
            for r in rows.collect()}


def index_of(log):
    return thread_index.thread_index(log.where("is_fetch = 0").withColumnRenamed("at", "indexed_at"),
                                     log.where("is_fetch = 1").withColumnRenamed("at", "fetched_at"))


def random_log(seed, n, roots):
    rnd = random.Random(seed)
    log = []
    for _ in range(n):
        fetch, root = int(rnd.random() < 0.35), rnd.choice(roots + roots[:1] * len(roots))  # the first root is hot
        at = None if rnd.random() < 0.05 else T0 + rnd.randrange(40) * SEC
        log.append((fetch, rnd.choice(["T", None]) if root == roots[-1] else "T", "C", root, None if fetch else rnd.randrange(4),
                    None if fetch or rnd.random() < 0.5 else str(rnd.randrange(3)), at))
    return log + log[: n // 5]


def test_open_rows_give_the_index_after_any_split(spark):
    for seed in range(3):
        log = random_log(seed, 150, ["1.5", "2.5", "3.5", "4.5", "never"])
        random.Random(seed).shuffle(log)
        state = spark.createDataFrame([], LOG)
        for k in range(3):
            state = thread_index.open_log(state.unionByName(spark.createDataFrame(log[k::3], LOG)))
            state = spark.createDataFrame(state.collect(), LOG)
        want = walk_index(log)
        assert as_index(index_of(state)) == want and as_index(index_of(spark.createDataFrame(log, LOG))) == want
        # rows before the last covered observation are gone: a fetch, what it covers, what came after it
        assert sorted(map(repr, state.collect())) == sorted(map(repr, thread_index.open_log(spark.createDataFrame(log, LOG)).collect()))
        hot = [r for r in state.collect() if r.root_ts == "1.5"]
        until = [r.at for r in hot if r.is_fetch]
        assert len(until) == 1 and sum(not r.is_fetch and (r.at is None or r.at <= until[0]) for r in hot) <= 1
    assert thread_index.open_log(spark.createDataFrame([], LOG)).collect() == []


def test_thread_state_reads_and_writes_the_dates_of_its_batch(spark):
    root = scratch_path(spark, "test", "threads")
    write = ingest._write_batch(root)
    day = [1785500000 + 86400 * k for k in range(3)]
    page = lambda p, k, n, s: (p, "C1", None, [{"ts": f"{day[k]}.5", "text": "r", "reply_count": n}], s)
    write(feeds.all_rows(history_pages=pages(spark, page("a", 0, 1, 10), page("b", 1, 2, 10), page("c", 2, 3, 10))), 0)
    write(feeds.all_rows(history_pages=pages(spark, page("d", 1, 5, 30)), reply_pages=pages(
        spark, ("r", "C1", f"{day[1]}.5", [{"ts": f"{day[1]}.5", "text": "r"}], 20))), 1)
    before = files(f"{root}/thread_state")
    # a page that was fetched before the thread was, and comes later: the fetch covers its count
    write(feeds.all_rows(history_pages=pages(spark, page("e", 1, 4, 15))), 2)
    write(feeds.all_rows(history_pages=pages(spark, page("e", 1, 4, 15))), 2)  # delivered again
    got = {r.root_ts: (r.observed_reply_count, r.fetched_reply_count) for r in ingest.read_thread_index(spark, root).collect()}
    assert got == {f"{day[0]}.5": (1, 0), f"{day[1]}.5": (5, 4), f"{day[2]}.5": (3, 0)}
    assert {r.root_ts for r in thread_index.stale_threads(ingest.read_thread_index(spark, root)).collect()} == set(got)
    new = [f for f in files(f"{root}/thread_state") if f not in before]
    assert all(f in files(f"{root}/thread_state") for f in before) and new and all("/batch=2/" in f and "root_date=" in f for f, _ in new)
    assert len({f.split("root_date=")[1][:10] for f, _ in new}) == 1
    touched = {f.split("root_date=")[1][:10] for f, _ in files(f"{root}/thread_state") if "/batch=1/" in f}
    assert len(touched) == 1


def files(path):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_purge_deletes_expired_folders_and_keeps_roots(spark, monkeypatch):
    root = scratch_path(spark, "test", "purge")
    day = 86400
    now = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    old, lone, recent = f"{now - 40 * day}.0", f"{now - 50 * day}.0", f"{now - day}.0"
    ingest._write_batch(root)(feeds.all_rows(
        live(spark, ("a", "C1", old, "root", -9 * day, None), ("b", "C1", lone, "alone", 0, None), ("c", "C1", recent, "reply", 0, old),
             ("d", "C1", "never", "no time", 0, None), ("e", "C1", f"{now - 40 * day + 1}.0", "near the root", 0, None)),
        pages(spark, ("p", "C1", None, [{"ts": old, "text": "root"}, {"ts": lone, "text": "alone"}], 5))), 0)
    acks = spark.createDataFrame([("x", e, T0) for e in "abcz"] + [("x", "a", T0 + SEC)], "consumer_id string, event_id string, acknowledged_at timestamp")
    purge.append_acks(spark, root, acks, 0)
    purge.append_acks(spark, root, acks, 1)
    assert sorted((r.event_id, r.acknowledged_at) for r in purge.read_acks(spark, root).collect()) == [("a", T0), ("b", T0), ("c", T0)]
    # interrupted once the plan is written down: the next purge finishes it
    with monkeypatch.context() as m:
        whole = purge._finish
        m.setattr(purge, "_finish", lambda s, r, n: None if ingest._exists(s, f"{r}/purging/{n}/folders/_SUCCESS") else whole(s, r, n))
        purge.purge_store(spark, root, T0)
    purge.purge_store(spark, root, T0)
    assert {r.event_id for r in ingest.read_messages(spark, root).collect()} == {"a", "c", "d"}
    assert {r.event_id for r in purge.read_acks(spark, root).collect()} == {"a", "c"}
    assert {r.root_ts for r in ingest.read_thread_index(spark, root).collect()} == {old}
    assert "a" not in {r.event_id for r in ingest._table(spark, root, "raw").collect()}
    gone = dt.datetime.fromtimestamp(now - 50 * day, tz=dt.timezone.utc).date()
    assert str(gone) not in ingest.stored_dates(spark, root, "messages")
    assert not os.path.exists(f"{root}/purging/messages")
    before = files(root)
    purge.purge_store(spark, root, T0)
    assert files(root) == before
