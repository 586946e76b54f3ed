"""Segmentation: lossless, within budget, equal to a brute-force bisection."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import make_messages
from threadloom.operators import segments


def wire_bytes(row, text, offset=None):
    """Bytes of the delivered JSON of one message, as a client would receive it."""
    body = {"eventId": row[0], "messageTs": row[1], "userId": row[2], "subtype": row[3], "text": text}
    if offset is not None:
        body["textContinues"] = offset
    return max(24, len(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()))


def expected_segments(row, text, budget):
    """(start, end, continues, cost, stalled): every end offset is tried and the largest that fits is kept."""
    found, start = [], 0
    while True:
        if not text or wire_bytes(row, text[start:]) <= budget:
            return found + [(start, len(text), None, wire_bytes(row, text[start:]), False)]
        fitting = [end for end in range(start, min(len(text), start + budget) + 1) if wire_bytes(row, text[start:end], end) <= budget]
        end = max(fitting, default=start)
        found.append((start, end, end, wire_bytes(row, text[start:end], end), end == start))
        if end == start:
            return found
        start = end


def test_segment_loop_concatenates(spark):
    text = "".join(f"{k} für {chr(0x4e00 + k)}; " for k in range(211))
    msgs = make_messages(spark, [(12, "88.5", text, "80.1")])
    segs = segments.all_segments(msgs, 190).orderBy("seg_no").collect()
    assert "".join(s.seg_text for s in segs) == text
    assert all(s.seg_cost <= 190 for s in segs)
    assert segs[-1].text_continues is None and all(s.text_continues is not None for s in segs[:-1])


TEXTS = ["", "short", "x" * 500, 'mixé "quoted" \\ \n\t\x01' * 40, "😀é漢字" * 90, "a b" * 120]


def test_all_segments_equal_trying_every_end(spark):
    rows = [(i + 1, f"1000.{i:06d}", t, None) for i, t in enumerate(TEXTS)]
    msgs = make_messages(spark, rows)
    for budget in (128, 256, 1000):
        got = {}
        for r in segments.all_segments(msgs, budget).collect():
            got.setdefault(r.event_id, []).append((r.seg_no, r.seg_start, r.seg_end, r.text_continues, r.seg_cost, r.stalled))
        for i, t in enumerate(TEXTS):
            want = expected_segments((f"Ev{i + 1}", f"1000.{i:06d}", "U1", None), t, budget)
            if want[0][2] is None:
                assert f"Ev{i + 1}" not in got  # fits: not oversized
            else:
                assert [g[1:] for g in sorted(got[f"Ev{i + 1}"])] == want


def test_next_segment_from_any_offset(spark):
    rows = [(i + 1, f"1000.{i:06d}", t, None) for i, t in enumerate(TEXTS)]
    msgs = make_messages(spark, rows)
    for share in (0, 3, 7):
        res = {r.event_id: r for r in segments.next_segment(
            msgs.withColumn("off", (F.length("text") * share / 10).cast("int")), 128, "off").collect()}
        for i, t in enumerate(TEXTS):
            off = len(t) * share // 10
            row = (f"Ev{i + 1}", f"1000.{i:06d}", "U1", None)
            r = res[f"Ev{i + 1}"]
            if wire_bytes(row, t[off:]) <= 128 or not t:
                assert (r.seg_text, r.text_continues, r.seg_cost) == (t[off:], None, wire_bytes(row, t[off:]))
            else:
                end = max(e for e in range(off, len(t) + 1) if e == off or wire_bytes(row, t[off:e], e) <= 128)
                assert (r.seg_text, r.text_continues, r.seg_cost) == (t[off:end], end, wire_bytes(row, t[off:end], end))
            assert not r.stalled


def test_a_text_that_cannot_go_on_is_flagged(spark):
    """With a long user id not even an empty segment fits: one flagged row, no endless chain."""
    msgs = make_messages(spark, [(1, "1000.5", "some text " * 30, None)]).withColumn("user_id", F.lit("u" * 200))
    rows = segments.all_segments(msgs, 128).collect()
    assert [(r.seg_no, r.seg_start, r.seg_end, r.stalled) for r in rows] == [(1, 0, 0, True)]
    assert segments.next_segment(msgs, 128).first().stalled


def test_code_points_not_units_are_counted(spark):
    """Offsets are code points: an astral character is one, in both forms."""
    text = "😀" * 100
    msgs = make_messages(spark, [(1, "1000.5", text, None)])
    rows = sorted(segments.all_segments(msgs, 128).collect(), key=lambda r: r.seg_no)
    assert rows[-1].seg_end == 100 and "".join(r.seg_text for r in rows) == text
    assert segments.next_segment(msgs, 128).first().seg_text == rows[0].seg_text


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x1F64F, blacklist_categories=("Cs",)),
               min_size=0, max_size=700), st.integers(min_value=128, max_value=400))
def test_segments_property(spark, text, budget):
    msgs = make_messages(spark, [(1, "1000.5", text, None)])
    segs = sorted(segments.all_segments(msgs, budget).collect(), key=lambda s: s.seg_no)
    if segs:
        assert "".join(s.seg_text for s in segs) == text
        assert all(s.seg_cost <= budget for s in segs)
