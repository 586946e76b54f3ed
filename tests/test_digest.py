"""Digest behaviour on small scenarios: grouping, budgets, order, costs."""

import json

from pyspark.sql import functions as F

from tests.conftest import make_messages
from threadloom.operators import digest, inbox


def run_batch(spark, rows, budget, payload_col=None):
    msgs = inbox.digest_ready(make_messages(spark, rows))
    sel = msgs.select(F.lit("c").alias("consumer_id"), *inbox.NARROW).withColumn("eligible", F.lit(True))
    grouped = digest.group_messages(sel, ["consumer_id"])
    return digest.make_batch(grouped, msgs, budget)


def said(n, at, text, thread=None):
    return n, f"{at}.{n:06d}", text, thread


def cost_of(spark, *rows):
    return sum(r.cost for r in inbox.digest_ready(make_messages(spark, list(rows))).collect())


def test_interleaved_threads_and_windows(spark):
    """Two threads whose replies alternate, with standalone messages close together and far apart."""
    a, b = said(31, 52000, "deploy blocked?"), said(32, 52003, "who has the cable")
    rows = [a, b, said(33, 52010, "coffee"), said(34, 52011, "rolled back", a[1]), said(35, 52020, "desk four", b[1]), said(36, 52030, "tea"),
            said(37, 52400, "thanks", a[1]), said(38, 54000, "bye")]
    batch = run_batch(spark, rows, 5000)
    groups = {g.group_id: g for g in batch.groups.collect()}
    ids = {}
    for r in batch.messages.orderBy("position").collect():
        ids.setdefault(groups[r.group_id].group_position, []).append((groups[r.group_id].kind, r.event_id))
    assert [ids[k] for k in sorted(ids)] == [[("thread", "Ev31"), ("thread", "Ev34"), ("thread", "Ev37")], [("thread", "Ev32"), ("thread", "Ev35")],
                                             [("channel_window", "Ev33"), ("channel_window", "Ev36")], [("channel_window", "Ev38")]]


def test_prefix_of_an_oversized_thread(spark):
    """Budgets from the costs: exactly the root and one reply fit; a byte less leaves the root alone."""
    rows = [said(5, 700, "agenda"), said(6, 701, "point one " * 9, "700.000005"), said(7, 702, "point two " * 30, "700.000005")]
    two = cost_of(spark, *rows[:2])
    for budget, want in ((two, ["Ev5", "Ev6"]), (two - 1, ["Ev5"])):
        batch = run_batch(spark, rows, budget)
        group = batch.groups.first()
        assert (group.kind, group.thread_continues, group.n_messages) == ("thread", True, 3)
        assert [r.event_id for r in batch.messages.orderBy("position").collect()] == want
        assert batch.summary.first().has_more


def test_payload_is_neither_delivered_nor_counted(spark):
    rows = [said(k, 900 + k, f"note {k}") for k in range(1, 4)]
    small = make_messages(spark, rows)
    big = small.withColumn("event_payload", F.to_json(F.struct(F.repeat(F.col("text"), 20_000).alias("files"))))
    costs = []
    for frame in (small, big):
        m = inbox.digest_ready(frame)
        sel = m.select(F.lit("c").alias("consumer_id"), *inbox.NARROW).withColumn("eligible", F.lit(True))
        batch = digest.make_batch(digest.group_messages(sel, ["consumer_id"]), m, 1000)
        assert "event_payload" not in batch.messages.columns
        costs.append(batch.summary.first().estimated_tokens)
    assert costs[0] == costs[1] == cost_of(spark, *rows)


def test_long_first_text_is_cut_to_the_budget(spark):
    text = "päivää " * 700
    for budget in (150, 333, 2500):
        batch = run_batch(spark, [said(3, 10, text), said(4, 20, "after")], budget)
        m = batch.messages.collect()
        assert len(m) == 1 and m[0].text == text[:m[0].text_continues] and m[0].cost <= budget
        # a longer cut would not fit: the next code point has at most two bytes, its offset at most one more digit
        assert m[0].cost > budget - 3
        assert batch.summary.first().estimated_tokens == m[0].cost


def test_order_is_by_clock_then_arrival(spark):
    rows = [said(90, 333, "c"), said(80, 334, "d"), said(70, 332, "b"), (60, "332.999999", "a", None), (95, "soon", "first", None)]
    batch = run_batch(spark, rows, 5000)
    assert [(r.group_id, r.event_id) for r in batch.messages.orderBy("event_sequence").collect()]
    by_group = {g.group_id: g.group_position for g in batch.groups.collect()}
    got = [r.event_id for r in sorted(batch.messages.collect(), key=lambda r: (by_group[r.group_id], r.position))]
    # an unreadable time is second 0; equal seconds keep the order of arrival, whatever the fraction
    assert got == ["Ev95", "Ev60", "Ev70", "Ev90", "Ev80"]


def test_cost_matches_json_bytes(spark):
    text = 'quote " backslash \\ newline \n tab \t ctrl \x01 accent é emoji 😀 sep  '
    m = inbox.digest_ready(make_messages(spark, [(1, "1000.1", text, None)])).first()
    obj = {"eventId": "Ev1", "messageTs": "1000.1", "userId": "U1", "subtype": None, "text": text}
    expected = max(24, len(json.dumps(obj, ensure_ascii=False, separators=(",", ":")).encode("utf-8")))
    assert m.cost == expected


def test_window_gap_boundary(spark):
    # gaps of exactly 300 s stay together; 301 s splits (strictly greater breaks)
    rows = [(1, "1000.0", "a", None), (2, "1300.0", "b", None), (3, "1601.0", "c", None)]
    msgs = inbox.digest_ready(make_messages(spark, rows))
    sel = msgs.select(F.lit("c").alias("consumer_id"), *inbox.NARROW)
    g = digest.group_messages(sel, ["consumer_id"], 300).groups.orderBy("first_secs").collect()
    assert [x.n_messages for x in g] == [2, 1]


THREAD = [(1, "1000.0", "opening", None), (2, "1010.0", "one", "1000.0"), (3, "1020.0", "two", "1000.0"), (4, "1030.0", "three", "1000.0")]
KEYS = "workspace_id string, channel_id string, thread_ts string"


def read_thread(spark, **options):
    import datetime as dt
    msgs = inbox.digest_ready(make_messages(spark, THREAD))
    keys = spark.createDataFrame([("T1", "C1", "1000.0")], KEYS)
    _, b = digest.thread_digest(msgs, keys, dt.datetime(2026, 8, 12), 4000, **options)
    return b.groups.first(), [r.event_id for r in b.messages.orderBy("position").collect()]


def test_thread_digest_after_a_marker_repeats_the_root(spark):
    marker = spark.createDataFrame([("T1", "C1", "1000.0", "1010.0")], KEYS + ", after_ts string")
    group, ids = read_thread(spark, markers=marker)
    assert ids == ["Ev1", "Ev3", "Ev4"] and group.kind == "thread"


def test_thread_read_summary(spark):
    """Upper sequence and a row for every thread asked for, in one call."""
    import datetime as dt
    msgs = inbox.digest_ready(make_messages(spark, THREAD + [(9, "1500.0", "elsewhere", None)]))
    keys = spark.createDataFrame([("T1", "C1", "1000.0"), ("T1", "C1", "7.7"), ("T1", "C1", "7.7"), (None, "C1", "1.0")], KEYS)
    _, b = digest.thread_digest(msgs, keys, dt.datetime(2026, 8, 12), 4000)
    rows = {r.key_ts: (r.n_groups, r.n_delivered, r.has_more, r.upper_sequence) for r in b.summary.collect()}
    assert rows == {"1000.0": (1, 1, False, 9), "7.7": (0, 0, False, 9), "1.0": (0, 0, False, 9)}


def test_thread_digest_without_root(spark):
    group, ids = read_thread(spark, include_root=False)
    assert ids == ["Ev2", "Ev3", "Ev4"] and group.thread_ts == "1000.0"


def test_thread_read_left_with_its_root_is_a_window(spark):
    marker = spark.createDataFrame([("T1", "C1", "1000.0", "1030.0")], KEYS + ", after_ts string")
    group, ids = read_thread(spark, markers=marker)
    assert ids == ["Ev1"] and group.kind == "channel_window"


def test_empty_inbox_has_a_summary_row(spark):
    import datetime as dt
    msgs = inbox.digest_ready(make_messages(spark, THREAD))
    acks = msgs.select(F.lit("done").alias("consumer_id"), "event_id", F.col("observed_at").alias("acknowledged_at"))
    _, b = digest.inbox_digest(msgs, acks, ["done", "new"], dt.datetime(2026, 8, 12), 4000)
    rows = {r.consumer_id: r for r in b.summary.collect()}
    assert (rows["done"].n_groups, rows["done"].has_more, rows["done"].upper_sequence) == (0, False, 4)
    assert rows["new"].n_delivered == 1


def test_json_digest_has_names_and_no_payload(spark, tmp_path):
    b = run_batch(spark, THREAD, 4000)
    ws = spark.createDataFrame([("T1", "Team One")], "workspace_id string, workspace_name string")
    ch = spark.createDataFrame([("T1", "C9", "other")], "workspace_id string, channel_id string, channel_name string")
    digest.write_digest(b, ws, ch, str(tmp_path / "out"))
    docs = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert len(docs) == 1
    group = docs[0]["group"]
    assert group["workspaceName"] == "Team One" and "channelName" not in group
    assert [m["eventId"] for m in group["messages"]] == ["Ev1", "Ev2", "Ev3", "Ev4"]
    assert all(set(m) <= {"eventId", "messageTs", "userId", "subtype", "text", "textContinues"} for m in group["messages"])
