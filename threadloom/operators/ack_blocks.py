"""Acknowledgements by blocks of sequence numbers (I3 over a large store).

Sequence numbers are dense (D3), so what a consumer has acknowledged is a bitmap for each block of BLOCK numbers. Bitmaps merge
by OR, in any order and repeatedly, so a batch of acknowledgements adds its own and nothing is read again. A block in which
every number is acknowledged needs no message of it; messages stored by spans of blocks are then not read for such spans.
The messages that are read meet the bitmaps on the block number: no block has more than BLOCK messages, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import inbox

BLOCK = 32768       # bits of Spark's bitmap functions
SPAN_BLOCKS = 256   # blocks of a folder of stored messages: 8,388,608 messages
MAX_LISTED = 1000   # fully acknowledged spans named in the filter; more are found by a join


def _block(sequence: str = "event_sequence") -> Column:
    return F.bitmap_bucket_number(F.col(sequence))


def ack_blocks(acks: DataFrame, messages: DataFrame) -> DataFrame:
    """consumer_id, block, bitmap of acknowledgements (consumer_id, event_id); those of unknown messages count for nothing."""
    known = acks.select("consumer_id", "event_id").join(messages.select("event_id", "event_sequence"), "event_id")
    return known.groupBy("consumer_id", _block().alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("event_sequence")).alias("bitmap"))


def merge_blocks(*parts: DataFrame) -> DataFrame:
    """One bitmap a consumer and block of several sets of them; a set may come twice."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("consumer_id", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def write_spans(messages: DataFrame, path: str, span_blocks: int = SPAN_BLOCKS) -> None:
    """Store messages in folders ``span=S`` of ``span_blocks`` blocks, each file a range of sequence numbers."""
    (messages.withColumn("span", F.floor((_block() - 1) / span_blocks).cast("bigint"))
     .repartitionByRange("event_sequence").write.partitionBy("span").parquet(path))


def full_spans(blocks: DataFrame, consumers: Sequence[str], latest: int, span_blocks: int = SPAN_BLOCKS) -> DataFrame:
    """Spans in which all ``consumers`` have acknowledged every number up to ``latest``.

    A number that is not stored (any more) counts as not acknowledged unless its bit is set: a span is then read in vain,
    never left out.
    """
    names = list(dict.fromkeys(consumers))
    due = F.least(F.lit(BLOCK), F.lit(latest) - (F.col("block") - 1) * BLOCK)
    full = blocks.where(F.col("consumer_id").isin(names) & (F.bitmap_count("bitmap") >= due))
    last = (latest + BLOCK - 1) // BLOCK
    n_blocks = F.least(F.lit(span_blocks), F.lit(last) - F.col("span") * span_blocks)
    return (full.withColumn("span", F.floor((F.col("block") - 1) / span_blocks).cast("bigint")).groupBy("span")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_blocks * len(names)).select("span"))


def _acked(bitmap: Column) -> Column:
    at = F.bitmap_bit_position("event_sequence")
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def pending_by_blocks(messages: DataFrame, blocks: DataFrame, consumers: Sequence[str], latest: int, upper, as_of,
                      settle_seconds: int = inbox.DEFAULT_SETTLE_SECS, span_blocks: int = SPAN_BLOCKS) -> DataFrame:
    """I3 by blocks: the rows of ``inbox.pending``, with ``blocks`` (one bitmap a consumer and block) in place of acknowledgements.

    ``latest``: the highest sequence number stored. Messages with a ``span`` column (``write_spans``) are not read where
    all consumers have acknowledged the whole span; other messages are all read. A consumer without blocks waits for all.
    """
    if not consumers:
        raise ValueError("at least one consumer is required")
    names = list(dict.fromkeys(consumers))
    if "span" in messages.columns:
        done = full_spans(blocks, names, latest, span_blocks)
        listed = [r["span"] for r in done.limit(MAX_LISTED + 1).collect()]
        if len(listed) > MAX_LISTED:
            messages = messages.join(done, "span", "left_anti")
        elif listed:
            messages = messages.where(~F.col("span").isin(listed))
        messages = messages.drop("span")
    waiting_for = inbox.settled(messages.where(F.col("event_sequence") <= inbox.as_column(upper)), as_of, settle_seconds)
    mine = (blocks.where(F.col("consumer_id").isin(names)).groupBy(F.col("block").alias("_block"))
            .agg(F.map_from_entries(F.collect_list(F.struct("consumer_id", "bitmap"))).alias("_bits")))
    rows = waiting_for.withColumn("_block", _block()).join(mine, "_block", "left")
    everyone = F.array(*[F.lit(c) for c in names])
    waiting = F.filter(everyone, lambda c: ~_acked(F.try_element_at(F.col("_bits"), c)))
    return rows.withColumn("consumer_id", F.explode(waiting)).drop("_block", "_bits")
