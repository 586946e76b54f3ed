"""Jobs, thread index, retention, times, sessions, backlog: small cases with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_messages
from threadloom.functions import canonical_ts
from threadloom.operators import backfill, backlog, dedupe, digest, inbox, retention, state, thread_index
from threadloom.sources import envelopes, history, metadata

T0 = dt.datetime(2026, 8, 1)
SEC = dt.timedelta(seconds=1)
LOG = "task_id bigint, at timestamp, seq int, kind string, cursor string, error string, not_before timestamp"


def jobs_case(spark, log, cancels=()):
    """Tasks 1..n of job 1; log rows (task, second, kind, cursor)."""
    n = max([t for t, *_ in log], default=0)
    tasks = spark.createDataFrame([(t, 1, "T1", f"C{t}", "history") for t in range(1, n + 1)],
                                  "task_id bigint, job_id bigint, workspace_id string, channel_id string, phase string")
    rows = [(t, T0 + s * SEC, i, k, c, "boom" if k == "error" else None, None) for i, (t, s, k, c) in enumerate(log)]
    states = backfill.task_state(spark.createDataFrame(rows, LOG))
    jobs = spark.createDataFrame([(1, "manual", T0 - 9 * SEC, T0, T0)], backfill.JOBS + ", created_at timestamp")
    cut = spark.createDataFrame([(1, T0 + s * SEC) for s in cancels], "job_id bigint, at timestamp")
    return jobs, tasks, states, cut


DONE = [(1, 0, "created", None), (1, 1, "claimed", None), (1, 2, "page", None)]
RUNNING = [(1, 0, "created", None), (1, 1, "claimed", None)]


@pytest.mark.parametrize("log,cancels,want", [
    ([], (), "completed"), (DONE, (), "completed"), (DONE, (5,), "completed"), (RUNNING, (), "running"), (RUNNING, (5,), "canceled"),
    (RUNNING + [(1, 5, "cancel", None), (1, 9, "page", None)], (5,), "completed"),
    ([(1, 0, "created", None)], (), "queued"), ([(1, 0, "created", None), (1, 5, "cancel", None)], (5,), "canceled"),
    (DONE + [(2, 0, "created", None), (2, 5, "cancel", None)], (5,), "canceled"),
    (DONE + [(2, 0, "created", None), (2, 1, "claimed", None), (2, 3, "page", "more"), (2, 5, "cancel", None)], (5,), "canceled"),
])
def test_job_state(spark, log, cancels, want):
    assert [r.state for r in backfill.job_state(*jobs_case(spark, log, cancels)).collect()] == [want]


def test_job_report_fields(spark):
    r = backfill.job_report(*jobs_case(spark, DONE[:2] + [(1, 2, "error", None)])).first()
    assert (r.kind, r.state, r.last_error, r.total_tasks, r.completed_tasks, r.completed_at) == ("manual", "running", "boom", 1, 0, None)
    assert (r.start_at, r.end_at, r.created_at) == (T0 - 9 * SEC, T0, T0)
    many = spark.createDataFrame([(k, "manual", T0, T0 + SEC, T0) for k in range(30)], backfill.JOBS + ", created_at timestamp")
    _, tasks, states, _ = jobs_case(spark, DONE)
    got = backfill.job_report(many, tasks, states).collect()
    assert [x.job_id for x in got] == list(range(29, 9, -1)) and {x.total_tasks for x in got} == {0}


def test_plan_history_keeps_microseconds_and_zone(spark):
    targets = spark.createDataFrame([("T1", "C1", True), ("T1", "C2", False)], "workspace_id string, channel_id string, enabled boolean")
    end = dt.datetime(2026, 8, 2, 2, 0, 0, 900001, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    rows = backfill.plan_history(targets, [(1, "manual", T0, end), (2, "manual", end, T0)], 30).collect()
    assert [(r.job_id, r.channel_id, r.kind) for r in rows] == [(1, "C1", "manual")]
    assert rows[0].latest == dt.datetime(2026, 8, 2, 0, 0, 0, 900001) and rows[0].latest - rows[0].oldest == dt.timedelta(days=30)
    assert rows[0].start_at == T0
    assert backfill.plan_history(targets, [], 30).count() == 0


def test_thread_index_does_not_depend_on_partitions(spark):
    obs_schema = "job_id bigint, workspace_id string, channel_id string, root_ts string, reply_count bigint, latest_reply_ts string, indexed_at timestamp"
    r = random.Random(1)
    obs = [(r.randint(1, 2), "T", "C", f"{r.randint(1, 6)}.0", r.randint(0, 5), "9.0", T0 + r.randint(0, 4) * SEC) for _ in range(60)]
    fetches = [("T", "C", f"{r.randint(1, 7)}.0", T0 + r.randint(0, 4) * SEC) for _ in range(15)]
    tasks = spark.createDataFrame([(1, "T", "C", T0, T0 + SEC)], "job_id bigint, workspace_id string, channel_id string, oldest timestamp, latest timestamp")
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(obs)
        o = spark.createDataFrame(obs, obs_schema).repartition(seed + 1)
        f = spark.createDataFrame(fetches, "workspace_id string, channel_id string, root_ts string, fetched_at timestamp")
        index = sorted(map(tuple, thread_index.thread_index(o, f).collect()), key=str)
        plan = sorted(map(tuple, thread_index.plan_replies(o, f, tasks).collect()), key=str)
        results.add((str(index), str(plan)))
        assert {x[2] for x in index} == {x[3] for x in obs}
        # the walk of one root, step by step
        for row in index:
            log = sorted([(x[6], 0, x[4]) for x in obs if x[3] == row[2]] + [(x[3], 1, 0) for x in fetches if x[2] == row[2]])
            seen, fetched = None, 0
            for _, is_fetch, n in log:
                if is_fetch:
                    fetched = fetched if seen is None else seen
                else:
                    seen = n
            assert (row[3], row[6]) == (seen, fetched)
    assert len(results) == 1


def test_unreadable_times_are_never_expired(spark):
    msgs = make_messages(spark, [(1, "1000.0", "old", None), (2, "not a time", "odd", None), (3, "9000000.0", "new", None)])
    kept = retention.retain_messages(msgs, dt.datetime(1970, 4, 15), days=1)
    assert {r.event_id for r in kept.collect()} == {"Ev2", "Ev3"}


def test_http_status_counts(spark):
    pages = spark.createDataFrame([("a", '{"ok":true,"messages":[]}', 200), ("b", '{"ok":true,"messages":[]}', 500), ("c", '{"ok":false}', 429),
                                   ("d", "no json", 200)], "page_id string, body string, status int")
    parsed = history.parse_pages(pages)
    assert {r.page_id for r in parsed.where("ok").collect()} == {"a"}
    assert {r.page_id: r.error for r in history.page_errors(parsed).collect()} == {"b": "HTTP 500", "c": "HTTP 429", "d": "HTTP 200"}
    look = spark.createDataFrame([("T1", "C1", "team", '{"ok":true,"team":{"name":""}}', 200, T0), ("T1", "C1", "channel", '{"ok":true,"channel":{}}', 200, T0),
                                  ("T1", "C1", "team", '{"ok":true,"team":{"name":"x"}}', 502, T0)],
                                 "workspace_id string, channel_id string, kind string, body string, status int, at timestamp")
    got = [(r.ok, r.name, r.error) for r in metadata.read_metadata(look).collect()]
    assert got == [(False, None, "no team name"), (True, "C1", None), (False, None, "lookup failed: HTTP 502")]


def test_event_that_is_no_object_reads_as_empty(spark):
    body = '{"envelope_id":"e","type":"events_api","payload":{"event_id":"a","team_id":"T","type":"event_callback","event":"text"}}'
    rows = envelopes.envelope_payloads(spark.createDataFrame([(body,)], "body string"))
    assert rows.count() == 1 and rows.first().event_type is None
    assert envelopes.normalise(rows.withColumn("received_at", F.lit(T0).cast("timestamp"))).count() == 0


def test_envelope_is_parsed_once(spark):
    lines = spark.createDataFrame([("{}", T0)], "body string, received_at timestamp")
    good, _ = envelopes.validate(envelopes.envelope_payloads(lines))
    plan = envelopes.normalise(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_canonical_ts(spark):
    bodies = ['{"ts":1203004.25}', '{"ts":"1203004.25"}', '{"ts":77}', '{"ts":null}', '{"ts":[1]}', "{}"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = {r.i: r.t for r in df.select("i", canonical_ts(F.try_variant_get(F.try_parse_json("b"), "$.ts", "variant")).alias("t")).collect()}
    assert got == {0: "1203004.25", 1: "1203004.25", 2: "77", 3: None, 4: None, 5: None}


def test_state_ties_are_stable(spark):
    reg = spark.createDataFrame([("T", "C", T0)], "workspace_id string, channel_id string, at timestamp")
    tog = [("T", "C", True, T0 + SEC), ("T", "C", False, T0 + SEC)]
    seen = {state.targets_state(reg, spark.createDataFrame(t, "workspace_id string, channel_id string, enabled boolean, at timestamp").coalesce(1)).first().enabled
            for t in (tog, tog[::-1])}
    assert seen == {True}


def test_dedupe_against_stored_rows(spark):
    schema = "event_id string, workspace_id string, channel_id string, message_ts string, arrival bigint"
    feed = spark.createDataFrame([("a", "T", "C", "1.0", 2), ("b", "T", "C", "2.0", 1), ("b", "T", "C", "3.0", 3)], schema)
    stored = spark.createDataFrame([("a", "T", "C", "1.0", 0)], schema)
    assert [(r.event_id, r.message_ts) for r in dedupe.dedupe_events(feed, stored).collect()] == [("b", "2.0")]
    assert {r.message_ts for r in dedupe.dedupe_messages(feed, stored, ["arrival"]).collect()} == {"2.0", "3.0"}


def test_backlog_plan_equals_a_walk(spark):
    r = random.Random(4)
    for budget, n in ((128, 60), (300, 90), (5000, 40)):
        costs = {s: [r.choice([24, 30, 60, 127, 128, 129, 400, 5001]) for _ in range(n)] for s in ("a", "b")}
        rows = [(s, f"{s}{i}", i, 0, i, str(i), 0, c) for s, cs in costs.items() for i, c in enumerate(cs)]
        groups = spark.createDataFrame(rows, "consumer_id string, group_id string, first_secs bigint, kind_rank int, ins_secs bigint, ins_tie string, "
                                             "window_no bigint, cost bigint")
        got = {x.group_id: x.batch_no for x in backlog.plan_batches(digest.Grouped(None, groups, ["consumer_id"]), budget).collect()}
        for s, cs in costs.items():
            batch, used = 1, 0
            for i, c in enumerate(cs):
                if i and used + c > budget:
                    batch, used = batch + 1, 0
                used += c
                assert got[f"{s}{i}"] == batch, (budget, s, i)


def test_digest_reads_text_once_before_delivery(spark):
    """The plan of the selection scans narrow staged columns; texts meet delivered rows without a shuffle of the messages."""
    msgs = inbox.digest_ready(make_messages(spark, [(i, f"{1000 + i}.0", "t" * i, None) for i in range(1, 30)]))
    acks = spark.createDataFrame([], "consumer_id string, event_id string, acknowledged_at timestamp")
    grouped, batch = digest.inbox_digest(msgs, acks, ["c", "none"], dt.datetime(2026, 8, 12), 2000)
    for df in (grouped.members, grouped.groups, batch.messages):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "to_json" not in plan and "LocalTableScan" not in plan
    ids = spark.createDataFrame([("Ev1", 1)], "event_id string, position int")
    plan = digest._with_text(ids, msgs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_digest_large_delivery_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(digest, "BROADCAST_IDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        msgs = make_messages(spark, [(1, "1.0", "x", None)])
        ids = spark.createDataFrame([("Ev1", 1)], "event_id string, position int")
        assert "Broadcast" not in digest._with_text(ids, msgs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_required_off_local(monkeypatch):
    from threadloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_explicit_settings_win(spark):
    from threadloom.session import configure
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert configure(spark).conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
