"""Streams: results do not depend on how rows fall into batches, and nothing is lost."""

import datetime as dt
import os

import pytest

from threadloom.plans import registry as R
from threadloom.plans.stage import scratch_path
from threadloom.streaming import ingest

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 8, 1)


@pytest.mark.parametrize("files,per_trigger", [(4, 2), (4, 1), (8, 1)])
def test_windows_do_not_depend_on_batches(spark, files, per_trigger):
    got = sorted(tuple(r) for r in R._windowed(spark, SF, files, per_trigger).collect())
    want = sorted(tuple(r) for r in R._windowed(spark, SF, 1, 1).collect())
    assert got == want
    assert sum(r[3] for r in got) == spark.read.parquet(f"{SF}/events.parquet").count()


def envelope(eid, ts, channel="C1", text="x", team="T1", kind="message"):
    import json
    body = {"envelope_id": "env-" + str(eid), "type": "events_api",
            "payload": {"type": "event_callback", "team_id": team, "event": {"type": kind, "channel": channel, "ts": ts, "text": text}}}
    if eid is not None:
        body["payload"]["event_id"] = eid
    return json.dumps(body)


def run(spark, batches):
    """Feed lists of (body, seconds, arrival), one file a batch."""
    root = scratch_path(spark, "test", "ingest")
    for rows in batches:
        data = [(b, T0 + dt.timedelta(seconds=s), a) for b, s, a in rows]
        spark.createDataFrame(data, "body string, received_at timestamp, arrival bigint").coalesce(1).write.mode("append").parquet(f"{root}/in")
    ingest.start_ingest(spark, ingest.envelope_stream(spark, f"{root}/in", 1, "parquet"), f"{root}/t", f"{root}/c").awaitTermination()
    return f"{root}/t"


def test_first_arrival_wins_and_numbers_are_dense(spark):
    root = run(spark, [
        [(envelope("b", "100.000001", text="second"), 0, 2), (envelope("a", "100.000001", text="first"), 0, 1), (envelope("c", "90.0"), 0, 3)],
        [(envelope("z", "90.0", text="again"), 5, 4), (envelope("c", "91.0"), 6, 5), (envelope("d", "10.0"), 7, 6)]])
    rows = {r.event_id: r for r in ingest.read_messages(spark, root).collect()}
    assert {k: r.event_sequence for k, r in rows.items()} == {"a": 1, "c": 2, "d": 3}
    assert rows["a"].text == "first" and rows["c"].message_ts == "90.0"


def test_rejects_are_kept_and_late_rows_accepted(spark):
    root = run(spark, [[(envelope("a", "5000000000.0"), 0, 1), (envelope(None, "7.0"), 0, 2), (envelope("e", "8.0", team=""), 0, 3)],
                       [(envelope("old", "1.0"), -30 * 86400, 4)]])
    assert {r.reject_reason for r in ingest.read_quarantine(spark, root).collect()} == {"missing event_id", "missing team_id"}
    assert {r.event_id for r in ingest.read_messages(spark, root).collect()} == {"a", "old"}


def test_batch_delivered_again_changes_nothing(spark):
    root = run(spark, [[(envelope("a", "1.0"), 0, 1), (envelope("b", "2.0"), 1, 2)]])
    before = sorted(map(tuple, ingest.read_messages(spark, root).collect()))
    again = spark.createDataFrame([(envelope("a", "1.0"), T0, 1), (envelope("b", "2.0"), T0 + dt.timedelta(seconds=1), 2)],
                                  "body string, received_at timestamp, arrival bigint")
    from threadloom.sources import envelopes
    ingest._write_batch(root)(envelopes.envelope_payloads(again), 0)
    assert sorted(map(tuple, ingest.read_messages(spark, root).collect())) == before


def test_changed_reads_only_after_and_settled(spark):
    root = run(spark, [[(envelope(f"m{i}", f"{i}.0"), i, i)] for i in range(1, 5)])
    got = ingest.read_changed(spark, root, 1, T0 + dt.timedelta(seconds=93), 90)
    assert sorted(r.event_sequence for r in got.collect()) == [2, 3]
    assert ingest.read_changed(spark, root, 9, T0 + dt.timedelta(days=1), 90).count() == 0


def test_targets_keep_first_and_last_time(spark):
    root = run(spark, [[(envelope("a", "1.0"), 10, 1)], [(envelope("b", "2.0"), 50, 2), (envelope("c", "3.0", channel="C2"), 60, 3)]])
    from threadloom.operators import state
    rows = {r.channel_id: (r.created_at, r.updated_at) for r in state.targets_state(ingest.read_targets(spark, root)).collect()}
    s = dt.timedelta(seconds=1)
    assert rows == {"C1": (T0 + 10 * s, T0 + 50 * s), "C2": (T0 + 60 * s, T0 + 60 * s)}


def test_text_landing_is_read(spark, tmp_path):
    (tmp_path / "one.txt").write_text(envelope("a", "1.0") + "\nnot json\n" + envelope("b", "2.0") + "\n")
    from threadloom.sources import envelopes
    rows = envelopes.read_envelopes(spark, str(tmp_path)).collect()
    assert {r.event_id for r in rows} == {"a", "b"} and all(r.received_at is not None for r in rows)


def test_gaps_across_batches(spark):
    from threadloom.operators import lifecycle
    root = scratch_path(spark, "test", "gaps")
    log = [(1, T0, "event", 1), (2, T0, "disconnected", 2), (1, T0 + dt.timedelta(seconds=400), "connected", 3),
           (2, T0 + dt.timedelta(seconds=299), "connected", 4), (2, T0 + dt.timedelta(seconds=301), "event", 5),
           (2, T0 + dt.timedelta(seconds=700), "connected", 6)]
    schema = "source bigint, at timestamp, kind string, seq bigint"
    for k in range(0, 6, 2):
        spark.createDataFrame(log[k:k + 2], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    (ingest.stream_gaps(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination())
    got = sorted(map(tuple, spark.read.schema(ingest.GAPS).parquet(f"{root}/out").collect()))
    want = sorted(map(tuple, lifecycle.downtime_gaps(spark.createDataFrame(log, schema)).collect()))
    assert got == want and len(got) == 2


def test_landed_files_are_made_once_and_read_by_several_tasks(spark):
    import glob

    import pyarrow.parquet as pq

    from threadloom.plans import registry

    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 12_000, 1, 6).selectExpr("id AS seq", "array_join(transform(sequence(1, 32), k -> sha2(concat(id, ':', k), 512)), '') AS body")
    path = scratch_path(spark, "test", "land")
    registry._land(rows.mapInArrow(make, rows.schema), "seq", 2, path)
    files = sorted(glob.glob(f"{path}/*.parquet"), key=os.path.getmtime)
    assert made.value == 12_000 and len(files) == 2
    assert all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
    seqs = [sorted(pq.read_table(f, columns=["seq"]).column("seq").to_pylist()) for f in files]
    assert seqs == [list(range(6000)), list(range(6000, 12_000))]
