"""Adapters from the driver tables to engine tables (FIXTURES.md §3), in Spark and in SQL.

Each adapter exists twice: as a DataFrame builder and as the SQL text of a DuckDB CTE
that computes the same rows. ``div`` in Spark is ``//`` in DuckDB. Times that leave
an operator as output are epoch seconds or microseconds, never zone-dependent text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapters.
BASE_SECS = 1700000000
CONV_SPACING_SECS = 240
TURN_SECS = 60
CONSUMERS = ["alpha", "beta"]
SETTLE_SECS = 90
AS_OF_LAG_SECS = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a stored table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- adapter A: conversations


def _frac(n: Column) -> Column:
    return F.lpad((n % 1000000).cast("string"), 6, "0")


def conversation_messages(conversations: DataFrame, with_ids: bool = False) -> DataFrame:
    """Adapter A: one message per conversation turn (``with_ids`` keeps c and t)."""
    c, t = F.col("conv_id"), F.col("turn")
    k = c * 8 + t
    base = F.lit(BASE_SECS) + F.expr("conv_id div 11") * CONV_SPACING_SECS
    secs = base + TURN_SECS * t * t
    message_ts = F.concat(secs.cast("string"), F.lit("."), _frac(k))
    root_ts = F.concat(base.cast("string"), F.lit("."), _frac(c * 8))
    return conversations.select(
        F.concat(F.lit("Ev"), F.lpad(k.cast("string"), 9, "0")).alias("event_id"),
        F.when(c % 5 == 0, c * 8 + (7 - t) + 1).otherwise(k + 1).cast("bigint").alias("event_sequence"),
        F.concat(F.lit("T"), (c % 3).cast("string")).alias("workspace_id"),
        F.concat(F.lit("C"), (c % 11).cast("string")).alias("channel_id"),
        message_ts.alias("message_ts"),
        F.when(((c % 4) == 0) | (t == 0), F.lit(None).cast("string")).otherwise(root_ts).alias("thread_ts"),
        F.col("role").alias("user_id"),
        F.when(F.col("role") == "system", F.lit("bot_message")).alias("subtype"),
        F.col("text"),
        F.lit(None).cast("string").alias("event_payload"),
        F.timestamp_seconds(secs + 5).alias("observed_at"),
        *([c.alias("c"), t.alias("t")] if with_ids else []),
    )


SQL_MESSAGES = """
messages AS (
  SELECT 'Ev' || lpad(CAST(conv_id * 8 + turn AS VARCHAR), 9, '0') AS event_id,
         CAST(CASE WHEN conv_id % 5 = 0 THEN conv_id * 8 + (7 - turn) + 1 ELSE conv_id * 8 + turn + 1 END AS BIGINT) AS event_sequence,
         'T' || CAST(conv_id % 3 AS VARCHAR) AS workspace_id,
         'C' || CAST(conv_id % 11 AS VARCHAR) AS channel_id,
         CAST(1700000000 + (conv_id // 11) * 240 + 60 * turn * turn AS VARCHAR) || '.'
           || lpad(CAST((conv_id * 8 + turn) % 1000000 AS VARCHAR), 6, '0') AS message_ts,
         CASE WHEN conv_id % 4 = 0 OR turn = 0 THEN NULL
              ELSE CAST(1700000000 + (conv_id // 11) * 240 AS VARCHAR) || '.'
                   || lpad(CAST((conv_id * 8) % 1000000 AS VARCHAR), 6, '0') END AS thread_ts,
         role AS user_id,
         CASE WHEN role = 'system' THEN 'bot_message' END AS subtype,
         text,
         CAST(1700000000 + (conv_id // 11) * 240 + 60 * turn * turn + 5 AS BIGINT) AS observed_secs,
         conv_id AS c, turn AS t
  FROM conversations
)"""


def conversation_acks(conversations: DataFrame) -> DataFrame:
    """Acks of adapter A: `alpha` acked (c*8+t) % 3 = 0, `beta` acked c % 2 = 0."""
    c, t = F.col("conv_id"), F.col("turn")
    event_id = F.concat(F.lit("Ev"), F.lpad((c * 8 + t).cast("string"), 9, "0"))
    acked = F.timestamp_seconds(F.lit(BASE_SECS) + F.expr("conv_id div 11") * CONV_SPACING_SECS
                                + TURN_SECS * t * t + 5 + 60)
    rows = conversations.select(event_id.alias("event_id"), acked.alias("acknowledged_at"),
                                ((c * 8 + t) % 3 == 0).alias("_a"), (c % 2 == 0).alias("_b"))
    alpha = rows.where("_a").select(F.lit("alpha").alias("consumer_id"), "event_id", "acknowledged_at")
    beta = rows.where("_b").select(F.lit("beta").alias("consumer_id"), "event_id", "acknowledged_at")
    return alpha.unionByName(beta)


SQL_ACKS = """
acks AS (
  SELECT 'alpha' AS consumer_id, event_id, observed_secs + 60 AS acknowledged_secs FROM messages WHERE (c * 8 + t) % 3 = 0
  UNION ALL
  SELECT 'beta' AS consumer_id, event_id, observed_secs + 60 AS acknowledged_secs FROM messages WHERE c % 2 = 0
)"""


def conversation_as_of(conversations: DataFrame):
    """as_of for adapter A: max(secs) - 600, fetched as one scalar (a parameter, not data)."""
    row = conversations.agg(F.max(F.lit(BASE_SECS) + F.expr("conv_id div 11") * CONV_SPACING_SECS
                                  + TURN_SECS * F.col("turn") * F.col("turn")).alias("m")).first()
    import datetime as dt
    return dt.datetime.fromtimestamp(int(row["m"]) - AS_OF_LAG_SECS, tz=dt.timezone.utc).replace(tzinfo=None)


SQL_AS_OF = """
params AS (
  SELECT MAX(observed_secs) - 5 - 600 AS as_of_secs, COALESCE(MAX(event_sequence), 0) AS upper_seq FROM messages
)"""


# ---------------------------------------------------------------- adapter E: events


def event_messages(events: DataFrame) -> DataFrame:
    """Adapter E: every event is a standalone message of workspace T1, channel C<user % 10>."""
    ts = F.col("ts").cast("timestamp")  # stored without zone; the session zone is UTC
    micros = F.unix_micros(ts)
    ts_text = F.concat((F.floor(micros / 1000000)).cast("string"), F.lit("."),
                       F.lpad((micros % 1000000).cast("string"), 6, "0"))
    return events.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        (F.col("event_id") + 1).cast("bigint").alias("event_sequence"),
        F.lit("T1").alias("workspace_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("channel_id"),
        ts_text.alias("message_ts"),
        F.lit(None).cast("string").alias("thread_ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("subtype"),
        F.col("event_type").alias("text"),
        F.col("props").alias("event_payload"),
        ts.alias("observed_at"),
    )


SQL_EVENT_MESSAGES = """
emessages AS (
  SELECT 'E' || CAST(event_id AS VARCHAR) AS event_id,
         CAST(event_id + 1 AS BIGINT) AS event_sequence,
         'T1' AS workspace_id,
         'C' || CAST(user_id % 10 AS VARCHAR) AS channel_id,
         CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS message_ts,
         CAST(NULL AS VARCHAR) AS thread_ts,
         CAST(user_id AS VARCHAR) AS user_id,
         CAST(NULL AS VARCHAR) AS subtype,
         event_type AS text,
         epoch_us(ts) AS observed_us
  FROM events
)"""


# ---------------------------------------------------------------- adapter X: documents


def document_messages(documents: DataFrame) -> DataFrame:
    """Adapter X: every document is one long standalone message."""
    return documents.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("event_id"),
        (F.col("doc_id") + 1).cast("bigint").alias("event_sequence"),
        F.lit("T1").alias("workspace_id"),
        F.col("source").alias("channel_id"),
        F.concat((F.lit(BASE_SECS) + F.col("doc_id")).cast("string"), F.lit(".000000")).alias("message_ts"),
        F.lit(None).cast("string").alias("thread_ts"),
        F.col("lang").alias("user_id"),
        F.lit(None).cast("string").alias("subtype"),
        F.col("text"),
        F.lit(None).cast("string").alias("event_payload"),
        F.timestamp_seconds(F.lit(BASE_SECS) + F.col("doc_id")).alias("observed_at"),
    )


SQL_DOCUMENT_MESSAGES = """
dmessages AS (
  SELECT 'D' || CAST(doc_id AS VARCHAR) AS event_id,
         CAST(doc_id + 1 AS BIGINT) AS event_sequence,
         'T1' AS workspace_id,
         source AS channel_id,
         CAST(1700000000 + doc_id AS VARCHAR) || '.000000' AS message_ts,
         CAST(NULL AS VARCHAR) AS thread_ts,
         lang AS user_id,
         CAST(NULL AS VARCHAR) AS subtype,
         text
  FROM documents
)"""


# ---------------------------------------------------------------- targets and metadata (A)

# Fixed toggles: (workspace, channel, enabled, seconds relative to as_of).
TOGGLES = [("T0", "Q2", False, -1800), ("T0", "C1", False, -1700), ("T0", "C1", True, -1600),
           ("T9", "C99", False, -1500), ("T1", "C2", False, -100)]
QUIET_CHANNELS = ["Q0", "Q1", "Q2"]


def _shift(as_of, secs_col: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")) + secs_col)


def target_registrations(messages: DataFrame, as_of) -> DataFrame:
    """Every live message registers its channel; three quiet channels are added by hand."""
    spark = messages.sparkSession
    manual = spark.createDataFrame([("T0", q) for q in QUIET_CHANNELS], "workspace_id string, channel_id string")
    return (messages.select("workspace_id", "channel_id", F.col("observed_at").alias("at"))
            .unionByName(manual.select("workspace_id", "channel_id", _shift(as_of, F.lit(-3600)).alias("at"))))


def target_toggles(spark: SparkSession, as_of) -> DataFrame:
    t = spark.createDataFrame(TOGGLES, "workspace_id string, channel_id string, enabled boolean, dt int")
    return t.select("workspace_id", "channel_id", "enabled", _shift(as_of, F.col("dt")).alias("at"))


def metadata_lookups(targets: DataFrame, as_of) -> DataFrame:
    """Lookup log per target: success at as_of - 1800 - 60n (n = channel number), or 30 h
    earlier when n % 5 = 0; a failure 5 minutes before as_of when n % 3 = 0.
    Workspaces are named 'Team <w>'; channels 'chan-<n>' when n is even, else the id."""
    n = F.expr("try_cast(substr(channel_id, 2) AS INT)")
    w = F.expr("try_cast(substr(workspace_id, 2) AS INT)")
    ok_at = F.when(n % 5 == 0, F.lit(-30 * 3600)).otherwise(F.lit(-1800) - 60 * n)
    ok = targets.select(
        "workspace_id", "channel_id", F.lit(True).alias("ok"),
        F.concat(F.lit("Team "), w.cast("string")).alias("workspace_name"),
        F.when(n % 2 == 0, F.concat(F.lit("chan-"), n.cast("string"))).otherwise(F.col("channel_id")).alias("channel_name"),
        F.lit(None).cast("string").alias("error"), _shift(as_of, ok_at).alias("at"))
    bad = targets.where(n % 3 == 0).select(
        "workspace_id", "channel_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("workspace_name"),
        F.lit(None).cast("string").alias("channel_name"), F.lit("ratelimited").alias("error"),
        _shift(as_of, F.lit(-300)).alias("at"))
    return ok.unionByName(bad)


SQL_TARGETS = """
reg AS (
  SELECT workspace_id, channel_id, observed_secs AS at_s FROM messages
  UNION ALL SELECT 'T0', q, (SELECT as_of_secs FROM params) - 3600 FROM (VALUES ('Q0'), ('Q1'), ('Q2')) v(q)),
regs AS (SELECT workspace_id, channel_id, min(at_s) AS created_at, max(at_s) AS reg_at FROM reg GROUP BY workspace_id, channel_id),
tog AS (
  SELECT v.workspace_id, v.channel_id, v.enabled, p.as_of_secs + v.dt AS at_s
  FROM (VALUES """ + ", ".join(f"('{a}', '{b}', {str(c).upper()}, {d})" for a, b, c, d in TOGGLES) + """) v(workspace_id, channel_id, enabled, dt), params p),
togs AS (
  SELECT t.workspace_id, t.channel_id, arg_max(t.enabled, t.at_s) AS enabled, max(t.at_s) AS tog_at
  FROM tog t JOIN regs r ON r.workspace_id = t.workspace_id AND r.channel_id = t.channel_id AND t.at_s >= r.created_at
  GROUP BY t.workspace_id, t.channel_id),
targets AS (
  SELECT r.workspace_id, r.channel_id, COALESCE(t.enabled, TRUE) AS enabled, r.created_at,
         greatest(r.reg_at, COALESCE(t.tog_at, r.reg_at)) AS updated_at
  FROM regs r LEFT JOIN togs t ON t.workspace_id = r.workspace_id AND t.channel_id = r.channel_id)"""

SQL_METADATA = """
lk AS (
  SELECT workspace_id, channel_id, TRY_CAST(substr(channel_id, 2) AS INTEGER) AS n, TRY_CAST(substr(workspace_id, 2) AS INTEGER) AS w
  FROM targets),
lookups AS (
  SELECT workspace_id, channel_id, TRUE AS ok, 'Team ' || CAST(w AS VARCHAR) AS workspace_name,
         CASE WHEN n % 2 = 0 THEN 'chan-' || CAST(n AS VARCHAR) ELSE channel_id END AS channel_name,
         CAST(NULL AS VARCHAR) AS error,
         (SELECT as_of_secs FROM params) + CASE WHEN n % 5 = 0 THEN -30 * 3600 ELSE -1800 - 60 * n END AS at_s
  FROM lk
  UNION ALL
  SELECT workspace_id, channel_id, FALSE, NULL, NULL, 'ratelimited', (SELECT as_of_secs FROM params) - 300
  FROM lk WHERE n % 3 = 0),
wsmeta AS (
  SELECT workspace_id, arg_max(workspace_name, at_s) FILTER (WHERE ok) AS workspace_name,
         max(at_s) FILTER (WHERE ok) AS last_synced_at, max(at_s) AS last_attempted_at,
         arg_max_null(CASE WHEN NOT ok THEN error END, at_s) AS last_error
  FROM lookups GROUP BY workspace_id),
chmeta AS (
  SELECT workspace_id, channel_id, arg_max(channel_name, at_s) FILTER (WHERE ok) AS channel_name,
         max(at_s) FILTER (WHERE ok) AS last_synced_at, max(at_s) AS last_attempted_at,
         arg_max_null(CASE WHEN NOT ok THEN error END, at_s) AS last_error
  FROM lookups GROUP BY workspace_id, channel_id)"""


# ---------------------------------------------------------------- envelopes, pages, feeds (A)


def _jstr(c: Column) -> Column:
    """A JSON string literal of a text column."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")


def conversation_envelopes(conversations: DataFrame) -> DataFrame:
    """Envelope lines for adapter A. Turn-0 rows of c % 9 in 0..6 are variants:
    disconnect, array payload, missing event_id, non-message event, numeric channel, numeric ts; those of
    c % 9 = 6 carry a text instead of an event object."""
    m = conversation_messages(conversations, with_ids=True)
    c, t = F.col("c"), F.col("t")
    v = F.when(t == 0, c % 9)
    ev_type = F.when(v == 3, F.lit("reaction_added")).otherwise(F.lit("message"))
    channel = F.when(v == 4, F.lit("42")).otherwise(_jstr(F.col("channel_id")))
    ts = F.when(v == 5, F.col("message_ts")).otherwise(_jstr(F.col("message_ts")))
    event = F.concat(
        F.lit('{"type":"'), ev_type, F.lit('","channel":'), channel, F.lit(',"ts":'), ts,
        F.when(F.col("thread_ts").isNotNull(), F.concat(F.lit(',"thread_ts":'), _jstr(F.col("thread_ts")))).otherwise(F.lit("")),
        F.lit(',"user":'), _jstr(F.col("user_id")),
        F.when(F.col("subtype").isNotNull(), F.concat(F.lit(',"subtype":'), _jstr(F.col("subtype")))).otherwise(F.lit("")),
        F.lit(',"text":'), _jstr(F.col("text")), F.lit(',"event_ts":'), _jstr(F.col("message_ts")), F.lit("}"))
    event = F.when(v == 6, _jstr(F.col("text"))).otherwise(event)
    eid = F.when(v == 2, F.lit("")).otherwise(F.concat(F.lit(',"event_id":'), _jstr(F.col("event_id"))))
    payload = F.concat(F.lit('{"type":"event_callback"'), eid, F.lit(',"team_id":'), _jstr(F.col("workspace_id")),
                       F.lit(',"api_app_id":"A1","event":'), event, F.lit("}"))
    payload = F.when(v == 1, F.lit("[1,2]")).otherwise(payload)
    kind = F.when(v == 0, F.lit("disconnect")).otherwise(F.lit("events_api"))
    body = F.concat(F.lit('{"envelope_id":"env'), (c * 8 + t).cast("string"), F.lit('","type":"'), kind,
                    F.lit('","payload":'), payload, F.lit("}"))
    return m.select(body.alias("body"), F.col("observed_at").alias("received_at"), F.col("event_sequence").alias("arrival"))


SQL_JSTR = "regexp_replace(regexp_replace(to_json([{x}]), '^\\[', ''), '\\]$', '')"


def _sj(x: str) -> str:
    return SQL_JSTR.format(x=x)


SQL_ENVELOPES = f"""
envl AS (
  SELECT CASE WHEN t = 0 THEN c % 9 END AS v, * FROM messages),
envelopes AS (
  SELECT '{{"envelope_id":"env' || CAST(c * 8 + t AS VARCHAR) || '","type":"'
         || CASE WHEN v = 0 THEN 'disconnect' ELSE 'events_api' END || '","payload":'
         || CASE WHEN v = 1 THEN '[1,2]' ELSE
              '{{"type":"event_callback"' || CASE WHEN v = 2 THEN '' ELSE ',"event_id":' || {_sj('event_id')} END
              || ',"team_id":' || {_sj('workspace_id')} || ',"api_app_id":"A1","event":'
              || CASE WHEN v = 6 THEN {_sj('text')} ELSE '{{"type":"' || CASE WHEN v = 3 THEN 'reaction_added' ELSE 'message' END || '","channel":'
              || CASE WHEN v = 4 THEN '42' ELSE {_sj('channel_id')} END
              || ',"ts":' || CASE WHEN v = 5 THEN message_ts ELSE {_sj('message_ts')} END
              || CASE WHEN thread_ts IS NOT NULL THEN ',"thread_ts":' || {_sj('thread_ts')} ELSE '' END
              || ',"user":' || {_sj('user_id')}
              || CASE WHEN subtype IS NOT NULL THEN ',"subtype":' || {_sj('subtype')} ELSE '' END
              || ',"text":' || {_sj('text')} || ',"event_ts":' || {_sj('message_ts')} || '}}' END || '}}' END
         || '}}' AS body, observed_secs, event_sequence AS arrival
  FROM envl)"""


def _root_json(prefix_obs: Column) -> Column:
    return F.concat(
        F.lit('{"type":"message","ts":'), _jstr(F.col("message_ts")), F.lit(',"text":'), _jstr(F.col("text")),
        F.lit(',"user":'), _jstr(F.col("user_id")), F.lit(',"reply_count":'), prefix_obs.cast("string"),
        F.lit(',"latest_reply":'), _jstr(F.col("latest_reply")), F.lit("}"))


def history_pages(conversations: DataFrame, as_of) -> DataFrame:
    """History pages of adapter A: each root (t = 0, c % 4 <> 0) observed in rounds 1 and 2
    (round 1 one reply short), with a non-message item and an item without string ts;
    plus error pages for c % 6 = 1 (error text), c % 6 = 5 (no body error, HTTP 500) and
    c % 6 = 3 (a good body with HTTP 502)."""
    m = conversation_messages(conversations, with_ids=True)
    c = F.col("c")
    last = (conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
            .join(m.select(F.col("c").alias("conv_id"), F.col("t").alias("last_turn"),
                           F.col("message_ts").alias("latest_reply")), ["conv_id", "last_turn"]))
    roots = m.where((F.col("t") == 0) & (c % 4 != 0)).join(last, c == F.col("conv_id")).drop("conv_id")
    rounds = roots.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    obs = F.col("last_turn") - F.when(F.col("round") == 1, 1).otherwise(0)
    cursor = F.when(F.col("round") == 1, F.concat(F.lit("p"), c.cast("string"))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"ok":true,"messages":['), _root_json(obs), F.lit(',{"type":"channel_join","ts":'),
                    _jstr(F.concat(F.col("message_ts"), F.lit("1"))), F.lit('},{"ts":12}],"response_metadata":{"next_cursor":"'),
                    cursor, F.lit('"}}'))
    ok_pages = rounds.select(F.concat(F.lit("h"), c.cast("string"), F.lit("-"), F.col("round").cast("string")).alias("page_id"),
                             "workspace_id", "channel_id", F.col("round").cast("bigint").alias("job_id"),
                             body.alias("body"), F.lit(200).alias("status"),
                             _shift(as_of, F.col("round") * 3600).alias("fetched_at"), c.alias("conv_id"))

    def err(cond, text, status):
        return roots.where(cond).select(
            F.concat(F.lit("e"), c.cast("string")).alias("page_id"), "workspace_id", "channel_id",
            F.lit(1).cast("bigint").alias("job_id"), F.lit(text).alias("body"), F.lit(status).alias("status"),
            _shift(as_of, F.lit(3600)).alias("fetched_at"), c.alias("conv_id"))

    return (ok_pages.unionByName(err(c % 6 == 1, '{"ok":false,"error":"ratelimited"}', 429))
            .unionByName(err(c % 6 == 5, '{"ok":false}', 500))
            .unionByName(err(c % 6 == 3, '{"ok":true,"messages":[{"type":"message","ts":"1.000001"}]}', 502)))


def reply_fetches(conversations: DataFrame, as_of) -> DataFrame:
    """Fetch times: after round 1 for c % 3 = 0, after round 2 for c % 3 = 1, never otherwise."""
    m = conversation_messages(conversations, with_ids=True)
    c = F.col("c")
    roots = m.where((F.col("t") == 0) & (c % 4 != 0) & (c % 3 != 2))
    r = F.when(c % 3 == 0, 1).otherwise(2)
    return roots.select("workspace_id", "channel_id", F.col("message_ts").alias("root_ts"),
                        _shift(as_of, r * 3600 + 1800).alias("fetched_at"))


SQL_PAGES = f"""
hroots AS (
  SELECT m.*, l.last_turn, lm.message_ts AS latest_reply
  FROM messages m JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) l ON l.conv_id = m.c
  JOIN messages lm ON lm.c = m.c AND lm.t = l.last_turn
  WHERE m.t = 0 AND m.c % 4 <> 0),
pages AS (
  SELECT 'h' || CAST(r.c AS VARCHAR) || '-' || CAST(rd AS VARCHAR) AS page_id, r.workspace_id, r.channel_id, CAST(rd AS BIGINT) AS job_id,
         '{{"ok":true,"messages":[' || '{{"type":"message","ts":' || {_sj('r.message_ts')} || ',"text":' || {_sj('r.text')}
         || ',"user":' || {_sj('r.user_id')} || ',"reply_count":' || CAST(r.last_turn - CASE WHEN rd = 1 THEN 1 ELSE 0 END AS VARCHAR)
         || ',"latest_reply":' || {_sj('r.latest_reply')} || '}}'
         || ',{{"type":"channel_join","ts":' || {_sj("r.message_ts || '1'")} || '}},{{"ts":12}}],"response_metadata":{{"next_cursor":"'
         || CASE WHEN rd = 1 THEN 'p' || CAST(r.c AS VARCHAR) ELSE '' END || '"}}}}' AS body,
         200 AS status, (SELECT as_of_secs FROM params) + rd * 3600 AS fetched_secs, r.c AS conv_id
  FROM hroots r CROSS JOIN (VALUES (1), (2)) v(rd)
  UNION ALL
  SELECT 'e' || CAST(c AS VARCHAR), workspace_id, channel_id, 1, '{{"ok":false,"error":"ratelimited"}}', 429,
         (SELECT as_of_secs FROM params) + 3600, c FROM hroots WHERE c % 6 = 1
  UNION ALL
  SELECT 'e' || CAST(c AS VARCHAR), workspace_id, channel_id, 1, '{{"ok":false}}', 500,
         (SELECT as_of_secs FROM params) + 3600, c FROM hroots WHERE c % 6 = 5
  UNION ALL
  SELECT 'e' || CAST(c AS VARCHAR), workspace_id, channel_id, 1, '{{"ok":true,"messages":[{{"type":"message","ts":"1.000001"}}]}}', 502,
         (SELECT as_of_secs FROM params) + 3600, c FROM hroots WHERE c % 6 = 3),
fetches AS (
  SELECT workspace_id, channel_id, message_ts AS root_ts,
         (SELECT as_of_secs FROM params) + CASE WHEN c % 3 = 0 THEN 1 ELSE 2 END * 3600 + 1800 AS fetched_secs
  FROM messages WHERE t = 0 AND c % 4 <> 0 AND c % 3 <> 2),
items AS (
  SELECT p.page_id, p.workspace_id, p.channel_id, p.job_id, p.fetched_secs, u.item_no - 1 AS item_no, u.m
  FROM pages p, LATERAL (SELECT unnest(CAST(json_extract(p.body, '$.messages') AS JSON[])) AS m,
                                unnest(generate_series(1, CAST(json_array_length(p.body, '$.messages') AS BIGINT))) AS item_no) u
  WHERE json_type(p.body, '$.ok') = 'BOOLEAN' AND CAST(json_extract(p.body, '$.ok') AS BOOLEAN) AND p.status BETWEEN 200 AND 299
    AND json_type(u.m) = 'OBJECT' AND json_type(u.m, '$.ts') = 'VARCHAR'),
hitems AS (
  SELECT *, json_extract_string(m, '$.ts') AS message_ts,
         CASE WHEN json_type(m, '$.thread_ts') = 'VARCHAR' THEN json_extract_string(m, '$.thread_ts') END AS thread_ts,
         CASE WHEN json_type(m, '$.reply_count') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(m, '$.reply_count') AS BIGINT) >= 0
              THEN CAST(json_extract(m, '$.reply_count') AS BIGINT) END AS reply_count,
         CASE WHEN json_type(m, '$.latest_reply') = 'VARCHAR' THEN json_extract_string(m, '$.latest_reply') END AS latest_reply
  FROM items
  WHERE json_type(m, '$.type') IS NULL OR json_type(m, '$.type') = 'NULL'
     OR (json_type(m, '$.type') = 'VARCHAR' AND json_extract_string(m, '$.type') IN ('', 'message')))"""


def conversation_feed(conversations: DataFrame) -> DataFrame:
    """D1/D2 feed: live messages of A; replays of c % 6 = 0 (same event id, later, marked
    text); history copies of c % 7 = 0 (history id, later still)."""
    m = conversation_messages(conversations, with_ids=True)
    live = m.withColumn("callback_type", F.lit("event_callback")).withColumn("arrival", F.col("event_sequence"))
    replay = (m.where(F.col("c") % 6 == 0).withColumn("text", F.concat("text", F.lit(" [replay]")))
              .withColumn("callback_type", F.lit("event_callback"))
              .withColumn("arrival", F.col("event_sequence") + 1000000000))
    hist = (m.where(F.col("c") % 7 == 0)
            .withColumn("event_id", F.concat_ws(":", F.lit("history"), "workspace_id", "channel_id", "message_ts"))
            .withColumn("callback_type", F.lit("history_backfill"))
            .withColumn("arrival", F.col("event_sequence") + 2000000000))
    return live.unionByName(replay).unionByName(hist).drop("c", "t")


def reply_pages(conversations: DataFrame, as_of) -> DataFrame:
    """S4 input: for roots of c % 5 = 2 (t = 0, c % 4 <> 0) one reply page with the root, its replies and a
    message of another thread."""
    m = conversation_messages(conversations, with_ids=True).where((F.col("c") % 4 != 0) & (F.col("c") % 5 == 2))
    thread = F.when(F.col("thread_ts").isNotNull(), F.concat(F.lit(',"thread_ts":'), _jstr(F.col("thread_ts")))).otherwise(F.lit(""))
    one = F.concat(F.lit('{"type":"message","ts":'), _jstr(F.col("message_ts")), thread, F.lit(',"user":'), _jstr(F.col("user_id")),
                   F.lit(',"text":'), _jstr(F.concat("text", F.lit(" [page]"))), F.lit("}"))
    per = m.groupBy("c", "workspace_id", "channel_id").agg(
        F.min(F.when(F.col("t") == 0, F.col("message_ts"))).alias("root_ts"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", one.alias("j")))), lambda x: x["j"]).alias("items"))
    body = F.concat(F.lit('{"ok":true,"messages":['), F.array_join("items", ","),
                    F.lit(',{"type":"message","ts":"1.000002","thread_ts":"1.000001","text":"elsewhere"}]}'))
    return per.select(F.concat(F.lit("r"), F.col("c").cast("string")).alias("page_id"), "workspace_id", "channel_id", "root_ts",
                      F.lit(1).cast("bigint").alias("job_id"), body.alias("body"), F.lit(200).alias("status"),
                      _shift(as_of, F.lit(7200)).alias("fetched_at"))


SQL_REPLY_FEED = """
replyfeed AS (
  SELECT 'history:' || workspace_id || ':' || channel_id || ':' || message_ts AS event_id, workspace_id, channel_id, message_ts, thread_ts,
         user_id, text || ' [page]' AS text, c FROM messages WHERE c % 4 <> 0 AND c % 5 = 2)"""


SQL_FEED = """
feed AS (
  SELECT event_id, workspace_id, channel_id, message_ts, thread_ts, user_id, subtype, text, 'event_callback' AS callback_type,
         event_sequence AS arrival FROM messages
  UNION ALL
  SELECT event_id, workspace_id, channel_id, message_ts, thread_ts, user_id, subtype, text || ' [replay]', 'event_callback',
         event_sequence + 1000000000 FROM messages WHERE c % 6 = 0
  UNION ALL
  SELECT 'history:' || workspace_id || ':' || channel_id || ':' || message_ts, workspace_id, channel_id, message_ts, thread_ts,
         user_id, subtype, text, 'history_backfill', event_sequence + 2000000000 FROM messages WHERE c % 7 = 0)"""


def metadata_responses(targets: DataFrame, as_of) -> DataFrame:
    """S5 input: a team and a channel lookup body per target. Workspace 2 answers without a
    team name; for channel number 4 the team name is empty, for 6 the status is 500 although the body is good; odd channels have no name; channel number % 7 = 3 answers not ok."""
    n = F.expr("try_cast(substr(channel_id, 2) AS INT)")
    w = F.expr("try_cast(substr(workspace_id, 2) AS INT)")
    team = F.when(w == 2, F.lit('{"ok":true,"team":{}}')).when(n == 4, F.lit('{"ok":true,"team":{"name":""}}')).otherwise(
        F.concat(F.lit('{"ok":true,"team":{"name":"Team '), w.cast("string"), F.lit('"}}')))
    chan = (F.when(n % 7 == 3, F.lit('{"ok":false,"error":"channel_not_found"}'))
            .when(n % 2 == 0, F.concat(F.lit('{"ok":true,"channel":{"name":"chan-'), n.cast("string"), F.lit('"}}')))
            .otherwise(F.lit('{"ok":true,"channel":{"is_im":true}}')))
    at = _shift(as_of, F.lit(0))
    t = targets.select("workspace_id", "channel_id", F.lit("team").alias("kind"), team.alias("body"),
                       F.when(n == 6, 500).otherwise(200).alias("status"), at.alias("at"))
    c = targets.select("workspace_id", "channel_id", F.lit("channel").alias("kind"), chan.alias("body"),
                       F.when(n % 7 == 3, 404).otherwise(200).alias("status"), at.alias("at"))
    return t.unionByName(c)


def lifecycle_log(events: DataFrame) -> DataFrame:
    """Lifecycle log of adapter E: source = user_id; error -> disconnected, signup -> connected."""
    kind = (F.when(F.col("event_type") == "error", F.lit("disconnected"))
            .when(F.col("event_type") == "signup", F.lit("connected")).otherwise(F.lit("event")))
    return events.select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"),
                         F.col("event_id").alias("seq"))


SQL_LIFECYCLE = """
lc AS (SELECT user_id AS source, epoch_us(ts) AS at_us, event_id AS seq,
              CASE WHEN event_type = 'error' THEN 'disconnected' WHEN event_type = 'signup' THEN 'connected' ELSE 'event' END AS kind
       FROM events),
lcm AS (
  SELECT *, max(CASE WHEN kind = 'disconnected' THEN at_us END) OVER w AS last_disconnect,
            max(CASE WHEN kind = 'event' THEN at_us END) OVER w AS last_event,
            max(CASE WHEN kind = 'connected' THEN at_us END) OVER w AS last_connect
  FROM lc WINDOW w AS (PARTITION BY source ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gaps AS (
  SELECT DISTINCT source, COALESCE(last_disconnect, last_event, last_connect) AS start_us, at_us AS end_us FROM lcm
  WHERE kind = 'connected' AND COALESCE(last_disconnect, last_event, last_connect) IS NOT NULL
    AND at_us - COALESCE(last_disconnect, last_event, last_connect) >= 300 * 1000000),
decisions AS (
  SELECT source, start_us, end_us, 'accepted' AS decision, end_us + 1 AS decided_at FROM gaps WHERE source % 3 = 0
  UNION ALL SELECT source, start_us, end_us, 'dismissed', end_us + 2 FROM gaps WHERE source % 3 = 0
  UNION ALL SELECT source, start_us, end_us, 'dismissed', end_us + 1 FROM gaps WHERE source % 3 = 1)"""


def suggestion_decisions(gaps: DataFrame) -> DataFrame:
    """Decisions on suggestions: source % 3 = 0 accepted then (ignored) dismissed; source % 3 = 1 dismissed."""
    s = F.col("source")
    a = gaps.where(s % 3 == 0).select("source", "start_us", "end_us", F.lit("accepted").alias("decision"),
                                       (F.col("end_us") + 1).alias("decided_at"))
    b = gaps.where(s % 3 == 0).select("source", "start_us", "end_us", F.lit("dismissed").alias("decision"),
                                       (F.col("end_us") + 2).alias("decided_at"))
    c = gaps.where(s % 3 == 1).select("source", "start_us", "end_us", F.lit("dismissed").alias("decision"),
                                       (F.col("end_us") + 1).alias("decided_at"))
    return a.unionByName(b).unionByName(c)
