import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import local_session

    s = local_session("*", shuffle_partitions=8, app="threadloom-tests")
    yield s
    s.stop()


MESSAGE_SCHEMA = ("event_id string, event_sequence bigint, workspace_id string, channel_id string, message_ts string, "
                  "thread_ts string, user_id string, subtype string, text string, event_payload string, observed_at timestamp")


def make_messages(spark, rows):
    """rows: (sequence, ts, text, thread_ts); workspace T1, channel C1, user U1."""
    import datetime as dt

    data = [(f"Ev{seq}", seq, "T1", "C1", ts, thread, "U1", None, text, None, dt.datetime(2026, 8, 11))
            for seq, ts, text, thread in rows]
    return spark.createDataFrame(data, MESSAGE_SCHEMA)
