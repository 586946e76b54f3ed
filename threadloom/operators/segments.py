"""Lossless text segmentation.

A segment is the longest run of code points after an offset whose projected JSON,
including the ``textContinues`` offset, fits the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.cost import CONTINUES_KEY_BYTES, MIN_BUDGET, MIN_COST, digest_message, projected_bytes


def _cost(projection: Column) -> Column:
    return F.greatest(F.lit(MIN_COST).cast("bigint"), projected_bytes(projection))


def with_segment(rows: DataFrame, budget: int, offset: Column | None = None) -> DataFrame:
    """Add the next segment of each message row (event_id, message_ts, user_id, subtype, text).

    Adds ``seg_text``, ``text_continues`` (null when the rest fits), ``seg_cost`` and ``stalled`` (true
    when not even an empty segment fits: Q10, no progress possible). A null text is delivered as ``''``.

    Every code point costs a byte or more, so only the next ``budget`` code points can matter: they
    are cut out first and the cost of a step does not depend on the length of the text. The largest
    fitting end is computed once, in its own projection, and found by halving inside that cut.
    """
    if budget < MIN_BUDGET:
        raise ValueError("budget must be at least 128")
    off = (F.lit(0) if offset is None else offset).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.withColumn("_off", off).withColumn("_n", F.length(text)).withColumn(
        "_part", F.substring(text, F.col("_off") + 1, F.lit(budget)))
    part, off, left = F.col("_part"), F.col("_off"), F.col("_n") - F.col("_off")

    def cost_to(size: Column) -> Column:
        return _cost(digest_message(F.substring(part, F.lit(1), size), off + size))

    def halve(acc: Column, _step: Column) -> Column:
        size = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        fits = cost_to(size) <= F.lit(budget)
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.struct(F.when(fits, size).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(size - 1).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.length(part).alias("hi"))
    longest = F.aggregate(F.sequence(F.lit(1), F.lit(int(budget).bit_length() + 1)), start, halve)["lo"]
    rest_cost = F.when((left <= budget) | (F.col("_n") == 0), _cost(digest_message(part)))
    sized = cut.withColumn("_rest", rest_cost)
    whole = F.coalesce(F.col("_rest") <= F.lit(budget), F.lit(False)) | (F.col("_n") == 0)
    sized = sized.withColumn("_size", F.when(~whole, longest))
    done = F.col("_size").isNull()
    return (sized.withColumn("seg_text", F.when(done, part).otherwise(F.substring(part, F.lit(1), F.col("_size"))))
            .withColumn("text_continues", F.when(~done, off + F.col("_size")))
            .withColumn("seg_cost", F.when(done, F.col("_rest")).otherwise(cost_to(F.col("_size"))))
            .withColumn("stalled", ~done & (F.col("_size") == 0) & (cost_to(F.lit(0)) > F.lit(budget)))
            .drop("_off", "_n", "_part", "_rest", "_size"))


def next_segment(messages: DataFrame, budget: int, offset_col: str | None = None) -> DataFrame:
    """The next segment of every message (from ``offset_col``, default 0)."""
    return with_segment(messages, budget, F.col(offset_col) if offset_col else None)


# ---------------------------------------------------------------- G11, all segments


SEGMENT_ROWS = 8192  # segments handed on together


def _escaped_lengths(text: str) -> np.ndarray:
    """JSON-escaped UTF-8 bytes of every code point of ``text``."""
    cps = np.frombuffer(text.encode("utf-32-le"), dtype="<u4") if text else np.zeros(0, dtype="<u4")
    out = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4))).astype(np.int64)
    out[cps < 0x20] = 6
    for short in (0x22, 0x5C, 0x08, 0x0C, 0x0A, 0x0D, 0x09):
        out[cps == short] = 2
    return out


def _base_bytes(event_id, message_ts, user_id, subtype) -> int:
    import json

    obj = {"eventId": event_id, "messageTs": message_ts, "userId": user_id, "subtype": subtype, "text": ""}
    return len(json.dumps(obj, ensure_ascii=False, separators=(",", ":")).encode("utf-8"))


def _segments_of(text: str, base: int, budget: int) -> Iterator[tuple[int, int, int | None, int, bool]]:
    """(start, end, text_continues, cost, stalled) of every segment of one text, in order."""
    sizes = _escaped_lengths(text)
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    # bytes up to an end offset, with the continuation key and the digits of the offset
    digits = 1 + np.searchsorted(10 ** np.arange(1, 19), np.arange(n + 1), side="right")
    keyed = total + CONTINUES_KEY_BYTES + digits
    at = 0
    while True:
        whole = max(MIN_COST, base + int(total[n] - total[at]))
        if whole <= budget or n == 0:
            yield at, n, None, whole, False
            return
        room = budget - base + int(total[at])
        end = max(at, at + int(np.searchsorted(keyed[at:], room, side="right")) - 1)
        yield at, end, end, max(MIN_COST, base + int(keyed[end] - total[at])), end == at
        if end == at:  # Q10: no progress possible; the flagged row says that the text is not complete
            return
        at = end


def all_segments(messages: DataFrame, budget: int) -> DataFrame:
    """Every segment of every message whose whole projection exceeds ``budget``.

    One output row per segment: event_id, seg_no (1-based), seg_start, seg_end, text_continues,
    seg_cost, stalled, seg_text. A text that cannot go on ends with a row whose ``stalled`` is true.
    The chain of one text is sequential and runs in ``mapInPandas``, which hands on
    segments in frames of bounded size; Spark spreads the messages over tasks.
    """
    if budget < MIN_BUDGET:
        raise ValueError("budget must be at least 128")
    from threadloom.functions.cost import message_cost

    oversized = messages.where((F.length("text") > budget) | (message_cost() > budget)).select(
        "event_id", "message_ts", "user_id", "subtype", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    columns = ["event_id", "seg_no", "seg_start", "seg_end", "text_continues", "seg_cost", "stalled", "seg_text"]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype(
            {"seg_no": "int64", "seg_start": "int64", "seg_end": "int64", "text_continues": "Int64", "seg_cost": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                base = _base_bytes(r.event_id, r.message_ts, r.user_id, r.subtype)
                for no, (a, b, cont, cost, stalled) in enumerate(_segments_of(r.text, base, budget), start=1):
                    rows.append((r.event_id, no, a, b, cont, cost, stalled, r.text[a:b]))
                    if len(rows) >= SEGMENT_ROWS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    schema = ("event_id string, seg_no bigint, seg_start bigint, seg_end bigint, text_continues bigint, "
              "seg_cost bigint, stalled boolean, seg_text string")
    return oversized.mapInPandas(run, schema)
