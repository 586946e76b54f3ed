"""Inbox and acknowledgement (I3, I9): consumers are isolated, acks are idempotent."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import make_messages
from threadloom.operators import inbox

AS_OF = dt.datetime(2026, 8, 12)
ACK_SCHEMA = "consumer_id string, event_id string, acknowledged_at timestamp"


def test_ack_empties_only_that_consumers_inbox(spark):
    msgs = make_messages(spark, [(1, "1000.0", "pending", None)])
    none = spark.createDataFrame([], ACK_SCHEMA)
    p = inbox.pending(msgs, none, ["day-shift", "night-shift"], 9, AS_OF, 90)
    assert sorted(r.consumer_id for r in p.collect()) == ["day-shift", "night-shift"]
    req = spark.createDataFrame([("night-shift", "Ev1")], "consumer_id string, event_id string")
    outcomes, new = inbox.acknowledge(req, msgs, none, AS_OF)
    assert [r.outcome for r in outcomes.collect()] == ["acknowledged"]
    p2 = inbox.pending(msgs, new, ["day-shift", "night-shift"], 9, AS_OF, 90)
    assert [r.consumer_id for r in p2.collect()] == ["day-shift"]
    again, _ = inbox.acknowledge(req, msgs, new, AS_OF)
    assert [r.outcome for r in again.collect()] == ["already"]


def test_unknown_and_duplicate_ids(spark):
    msgs = make_messages(spark, [(1, "1000.0", "a", None)])
    none = spark.createDataFrame([], ACK_SCHEMA)
    req = spark.createDataFrame([("c", "Ev1"), ("c", "Ev1"), ("c", "nope")], "consumer_id string, event_id string")
    out = {r.event_id: r.outcome for r in inbox.acknowledge(req, msgs, none)[0].collect()}
    assert out == {"Ev1": "acknowledged", "nope": "unknown"}


def test_settle_excludes_recent_arrivals(spark):
    msgs = make_messages(spark, [(1, "1000.0", "a", None)]).withColumn("observed_at", F.lit(AS_OF).cast("timestamp"))
    none = spark.createDataFrame([], ACK_SCHEMA)
    assert inbox.pending(msgs, none, ["c"], 9, AS_OF, 90).count() == 0
    assert inbox.pending(msgs, none, ["c"], 9, AS_OF, 0).count() == 1


def test_blocks_give_the_pending_rows_and_full_spans_are_not_read(spark):
    import datetime as dt
    import glob

    from pyspark.sql import functions as F

    from threadloom.operators import ack_blocks, inbox
    from threadloom.plans.stage import scratch_path

    n, t0 = 3 * ack_blocks.BLOCK + 10, dt.datetime(2026, 8, 1)
    msgs = spark.range(1, n + 1).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"),
                                        F.col("id").alias("event_sequence"), F.lit(t0).alias("observed_at"))
    path = scratch_path(spark, "test", "spans")
    ack_blocks.write_spans(msgs, path, span_blocks=1)
    # both consumers have all of the second block; of the others one lacks some numbers, at the ends of blocks too
    second = F.col("event_sequence").between(ack_blocks.BLOCK + 1, 2 * ack_blocks.BLOCK)
    lacks = F.col("event_sequence").isin(1, 8, 9, ack_blocks.BLOCK, 2 * ack_blocks.BLOCK + 1, n)
    acks = (msgs.where(~lacks).select(F.lit("a").alias("consumer_id"), "event_id")
            .unionByName(msgs.where(second).select(F.lit("b").alias("consumer_id"), "event_id"))
            .unionByName(spark.createDataFrame([("a", "unknown"), ("other", "e1")], "consumer_id string, event_id string")))
    half = acks.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0)
    blocks = ack_blocks.merge_blocks(ack_blocks.ack_blocks(half, msgs), ack_blocks.ack_blocks(acks, msgs))
    blocks.write.parquet(f"{path}-blocks")
    blocks = spark.read.parquet(f"{path}-blocks")
    stored = spark.read.parquet(path)
    assert [r.span for r in ack_blocks.full_spans(blocks, ["a", "b"], n, 1).collect()] == [1]
    for file in glob.glob(f"{path}/span=1/*.parquet"):
        with open(file, "wb") as f:
            f.write(b"not read")
    as_of = t0 + dt.timedelta(days=1)
    got = ack_blocks.pending_by_blocks(stored, blocks, ["a", "b"], n, n, as_of, span_blocks=1).select("consumer_id", "event_id")
    want = inbox.pending(msgs, acks, ["a", "b"], n, as_of).select("consumer_id", "event_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sorted(r.event_id for r in got.where("consumer_id = 'a'").collect()) == sorted(
        f"e{i}" for i in (1, 8, 9, ack_blocks.BLOCK, 2 * ack_blocks.BLOCK + 1, n))
