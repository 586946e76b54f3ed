"""The query registry: one Spark plan and one SQL oracle per operator family.

Inputs are the driver tables, mapped by the adapters of ``fixtures``. Order-carrying
results expose the order as a position column; times leave as epoch numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import canonical_ts, message_instant, message_secs
from threadloom.operators import ack_blocks, backlog, digest, inbox, segments
from threadloom.operators.scan import ordinal
from threadloom.plans import fixtures as fx
from threadloom.plans import oracle_sql as osql
from threadloom.plans.stage import drop_between, scratch_path, stage, staged_so_far

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs


def conv_inputs(spark: SparkSession, sf_dir: str):
    conv = fx.table(spark, sf_dir, "conversations")
    msgs = inbox.digest_ready(fx.conversation_messages(conv))
    return conv, msgs, fx.conversation_acks(conv), fx.conversation_as_of(conv)


def inbox_run(spark: SparkSession, sf_dir: str, budget: int):
    conv, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    grouped, batch = digest.inbox_digest(msgs, acks, fx.CONSUMERS, as_of, budget)
    return msgs, grouped, batch


def inbox_groups(spark: SparkSession, sf_dir: str) -> digest.Grouped:
    """Members and groups of the consumers' inboxes, without a batch."""
    _, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    return digest.inbox_groups(msgs, acks, fx.CONSUMERS, as_of)[0]


INBOX = osql.inbox_ctes()
GROUPING = osql.grouping_ctes(300, "event_sequence")


def inbox_sql(body: str, budget: int | None = None) -> str:
    ctes = INBOX + GROUPING + (osql.batch_ctes(budget) if budget else [])
    return osql.with_ctes(ctes, body)


# ---------------------------------------------------------------- I1, I2, I3, I4


@register("latest_sequence", osql.with_ctes([fx.SQL_MESSAGES],
          "SELECT CAST(COALESCE(MAX(event_sequence), 0) AS BIGINT) AS latest_sequence FROM messages"))
def q_latest_sequence(spark, sf_dir):
    return inbox.latest_sequence(fx.conversation_messages(fx.table(spark, sf_dir, "conversations")))


CHANGED_AFTER = 100


@register("changed_messages", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_AS_OF], f"""
SELECT event_id, event_sequence, message_ts FROM messages, params
WHERE event_sequence > {CHANGED_AFTER} AND event_sequence <= upper_seq AND observed_secs <= as_of_secs - 90"""))
def q_changed_messages(spark, sf_dir):
    conv, msgs, _, as_of = conv_inputs(spark, sf_dir)
    up = inbox.latest_sequence_value(msgs)
    return inbox.changed_messages(msgs, CHANGED_AFTER, up, as_of).select("event_id", "event_sequence", "message_ts")


@register("pending_messages", osql.with_ctes(INBOX, "SELECT consumer_id, event_id, event_sequence FROM pending"))
def q_pending(spark, sf_dir):
    conv, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    up = inbox.latest_sequence_value(msgs)
    return inbox.pending(msgs, acks, fx.CONSUMERS, up, as_of).select("consumer_id", "event_id", "event_sequence")


@register("canonical_keys", osql.with_ctes([fx.SQL_MESSAGES], """
SELECT event_id, CASE WHEN event_sequence % 3 = 0 THEN message_ts WHEN event_sequence % 3 = 1 THEN rtrim(rtrim(message_ts, '0'), '.') END AS key,
       event_sequence % 3 = 0 OR (event_sequence % 3 = 1 AND message_ts NOT LIKE '%0') AS found
FROM messages WHERE regexp_full_match(message_ts, '[1-9][0-9]*[.][0-9]+')"""))
def q_canonical_keys(spark, sf_dir):
    """Message keys that arrive as JSON text, as JSON numbers (which have no trailing zeros) and as null, and whether they name a message."""
    m = fx.conversation_messages(fx.table(spark, sf_dir, "conversations")).where(F.col("message_ts").rlike(r"^[1-9][0-9]*\.[0-9]+$"))
    as_text = F.concat(F.lit('{"ts":"'), "message_ts", F.lit('"}'))
    as_number = F.concat(F.lit('{"ts":'), "message_ts", F.lit("}"))
    kind = F.col("event_sequence") % 3
    body = F.when(kind == 0, as_text).when(kind == 1, as_number).otherwise(F.lit('{"ts":null}'))
    keys = m.select("event_id", "workspace_id", "channel_id", canonical_ts(F.try_variant_get(F.try_parse_json(body), "$.ts", "variant")).alias("key"))
    named = inbox.get_messages(m, keys.select("workspace_id", "channel_id", F.col("key").alias("message_ts")))
    hit = named.select("workspace_id", "channel_id", F.col("message_ts").alias("key"), F.lit(True).alias("_hit")).distinct()
    return keys.join(hit, ["workspace_id", "channel_id", "key"], "left").select("event_id", "key", F.coalesce("_hit", F.lit(False)).alias("found"))


@register("pending_by_blocks", osql.with_ctes(INBOX, "SELECT consumer_id, event_id, event_sequence FROM pending"))
def q_pending_by_blocks(spark, sf_dir):
    """I3 with bitmaps of acknowledged sequence numbers, built in two parts and merged, over messages stored by spans."""
    conv, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    path = scratch_path(spark, "messages", "spans")
    ack_blocks.write_spans(msgs.select("event_id", "event_sequence", "observed_at"), path)
    stored = spark.read.parquet(path)
    first = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    blocks = ack_blocks.merge_blocks(ack_blocks.ack_blocks(acks.where(first), stored), ack_blocks.ack_blocks(acks, stored))
    up = inbox.latest_sequence_value(stored)
    return ack_blocks.pending_by_blocks(stored, blocks, fx.CONSUMERS, up, up, as_of).select("consumer_id", "event_id", "event_sequence")


@register("hydrated_threads", osql.with_ctes(INBOX, """
SELECT h.consumer_id, h.event_id, m.event_sequence, h.eligible FROM hydrated h JOIN messages m USING (event_id)"""))
def q_hydrated(spark, sf_dir):
    conv, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    up = inbox.latest_sequence_value(msgs)
    p = inbox.pending(msgs, acks, fx.CONSUMERS, up, as_of)
    return inbox.hydrate_threads(p, msgs).select("consumer_id", "event_id", "event_sequence", "eligible")


# ---------------------------------------------------------------- G1-G9, G13, I10


@register("thread_groups", inbox_sql("""
SELECT scope AS consumer_id, group_id, kind, workspace_id, channel_id, thread_ts, CAST(first_secs AS BIGINT) AS first_secs,
       n_messages, cost FROM groups"""))
def q_thread_groups(spark, sf_dir):
    grouped = inbox_groups(spark, sf_dir)
    return grouped.groups.select("consumer_id", "group_id", "kind", "workspace_id", "channel_id", "thread_ts",
                                 F.col("first_secs").cast("bigint"), "n_messages", "cost")


@register("group_members", inbox_sql("""
SELECT scope AS consumer_id, group_id, event_id, CAST(member_position AS BIGINT) AS member_position FROM members"""))
def q_group_members(spark, sf_dir):
    grouped = inbox_groups(spark, sf_dir)
    return ordinal(grouped.members, ["consumer_id", "group_id"], digest.member_order(), "member_position").select(
        "consumer_id", "group_id", "event_id", "member_position")


@register("ordered_groups", inbox_sql("""
SELECT scope AS consumer_id, group_id, CAST(group_position AS BIGINT) AS group_position FROM ordered"""))
def q_ordered_groups(spark, sf_dir):
    grouped = inbox_groups(spark, sf_dir)
    return digest.ordered_groups(grouped).select("consumer_id", "group_id", "group_position")


@register("first_batch", inbox_sql("""
SELECT scope AS consumer_id, group_id, CAST(group_position AS BIGINT) AS group_position,
       CAST(running_cost AS BIGINT) AS running_cost FROM selected""", 16000))
def q_first_batch(spark, sf_dir):
    grouped = inbox_groups(spark, sf_dir)
    _, selected = digest.first_batch(grouped, 16000)
    return selected.select("consumer_id", "group_id", F.col("group_position").cast("bigint"), "running_cost")


SUMMARY_SQL = """
SELECT c.consumer_id, CAST(COALESCE(d.tokens, 0) AS BIGINT) AS estimated_tokens,
       COALESCE(s.n, 0) < COALESCE(g.n, 0) AS has_more, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_groups,
       CAST(COALESCE(d.n, 0) AS BIGINT) AS n_delivered, CAST((SELECT upper_seq FROM params) AS BIGINT) AS upper_sequence
FROM (SELECT consumer_id FROM consumers UNION ALL SELECT 'idle') c
LEFT JOIN (SELECT scope, count(*) AS n FROM groups GROUP BY scope) g ON g.scope = c.consumer_id
LEFT JOIN (SELECT scope, sum(estimated_tokens) AS tokens, count(*) AS n FROM dgroups GROUP BY scope) d ON d.scope = c.consumer_id
LEFT JOIN (SELECT scope, count(*) AS n FROM selected GROUP BY scope) s ON s.scope = c.consumer_id"""


def _summary(spark, sf_dir, budget):
    """Consumers alpha and beta, and one that acknowledged everything: its row has no groups."""
    _, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    idle = msgs.select(F.lit("idle").alias("consumer_id"), "event_id", F.col("observed_at").alias("acknowledged_at"))
    _, batch = digest.inbox_digest(msgs, acks.unionByName(idle), [*fx.CONSUMERS, "idle"], as_of, budget)
    return batch.summary


@register("batch_summary", inbox_sql(SUMMARY_SQL, 16000))
def q_batch_summary(spark, sf_dir):
    return _summary(spark, sf_dir, 16000)


BATCH_MSG_SQL = """
SELECT scope AS consumer_id, group_id, CAST(position AS BIGINT) AS position, event_id, text,
       CAST(text_continues AS BIGINT) AS text_continues, CAST(cost AS BIGINT) AS cost, eligible FROM delivered"""


def _batch_messages(batch):
    return batch.messages.select("consumer_id", "group_id", F.col("position").cast("bigint"), "event_id", "text",
                                 F.col("text_continues").cast("bigint"), F.col("cost").cast("bigint"), "eligible")


@register("partial_group", inbox_sql(BATCH_MSG_SQL, 1000))
def q_partial_group(spark, sf_dir):
    _, _, batch = inbox_run(spark, sf_dir, 1000)
    return _batch_messages(batch)


@register("partial_summary", inbox_sql(SUMMARY_SQL, 1000))
def q_partial_summary(spark, sf_dir):
    return _summary(spark, sf_dir, 1000)


@register("inbox_digest", inbox_sql("""
SELECT scope AS consumer_id, group_id, kind, workspace_id, channel_id, thread_ts, CAST(group_position AS BIGINT) AS group_position,
       CAST(estimated_tokens AS BIGINT) AS estimated_tokens, n_messages, thread_continues FROM dgroups""", 16000))
def q_inbox_digest(spark, sf_dir):
    _, _, batch = inbox_run(spark, sf_dir, 16000)
    return batch.groups.select("consumer_id", "group_id", "kind", "workspace_id", "channel_id", "thread_ts",
                               F.col("group_position").cast("bigint"), "estimated_tokens", "n_messages",
                               "thread_continues")


@register("inbox_digest_messages", inbox_sql(BATCH_MSG_SQL, 16000))
def q_inbox_digest_messages(spark, sf_dir):
    _, _, batch = inbox_run(spark, sf_dir, 16000)
    return _batch_messages(batch)


ACKABLE_SQL = """
SELECT d.scope AS consumer_id, d.group_id,
       string_agg(d.event_id, ',' ORDER BY d.position) FILTER (WHERE d.eligible) AS event_ids
FROM delivered d
GROUP BY d.scope, d.group_id
HAVING count(*) FILTER (WHERE d.text_continues IS NOT NULL) = 0 AND count(*) FILTER (WHERE d.eligible) > 0
   AND NOT EXISTS (SELECT 1 FROM dgroups g WHERE g.scope = d.scope AND g.group_id = d.group_id AND g.thread_continues)"""


@register("ackable_ids", inbox_sql(ACKABLE_SQL, 16000))
def q_ackable_ids(spark, sf_dir):
    _, _, batch = inbox_run(spark, sf_dir, 16000)
    msgs = batch.messages.join(batch.groups.select("consumer_id", "group_id", "thread_continues"),
                               ["consumer_id", "group_id"])
    return inbox.receipts(msgs).select("consumer_id", "group_id", F.array_join("event_ids", ",").alias("event_ids"))


@register("ackable_ids_small", inbox_sql(ACKABLE_SQL, 4000))
def q_ackable_ids_small(spark, sf_dir):
    _, _, batch = inbox_run(spark, sf_dir, 4000)
    msgs = batch.messages.join(batch.groups.select("consumer_id", "group_id", "thread_continues"),
                               ["consumer_id", "group_id"])
    return inbox.receipts(msgs).select("consumer_id", "group_id", F.array_join("event_ids", ",").alias("event_ids"))


@register("backlog_plan", osql.with_ctes(INBOX + GROUPING + ["""
walk AS (
  SELECT scope, CAST(1 AS BIGINT) AS group_position, cost AS used, CAST(1 AS BIGINT) AS batch_no FROM ordered WHERE group_position = 1
  UNION ALL
  SELECT w.scope, w.group_position + 1, CASE WHEN w.used + o.cost <= 4000 THEN w.used + o.cost ELSE o.cost END,
         CASE WHEN w.used + o.cost <= 4000 THEN w.batch_no ELSE w.batch_no + 1 END
  FROM walk w JOIN ordered o ON o.scope = w.scope AND o.group_position = w.group_position + 1)"""], """
SELECT o.scope AS consumer_id, o.group_id, CAST(o.group_position AS BIGINT) AS group_position, o.cost, w.batch_no
FROM ordered o JOIN walk w ON w.scope = o.scope AND w.group_position = o.group_position""", recursive=True))
def q_backlog_plan(spark, sf_dir):
    grouped = inbox_groups(spark, sf_dir)
    return backlog.plan_batches(grouped, 4000)


# ---------------------------------------------------------------- N9, N10, N12, N13


ODD_TS = ["abc", "", "1700000000", "12.5.6", " 42.000001", "-5.250000"]


@register("message_time", osql.with_ctes([fx.SQL_MESSAGES], """
SELECT event_id, COALESCE(TRY_CAST(split_part(message_ts, '.', 1) AS BIGINT), 0) AS secs,
       CAST(TRY_CAST(message_ts AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS instant_us
FROM (SELECT event_id, message_ts FROM messages
      UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('odd{i}', '{v}')" for i, v in enumerate(ODD_TS)) + """) v(event_id, message_ts)) x"""))
def q_message_time(spark, sf_dir):
    msgs = fx.conversation_messages(fx.table(spark, sf_dir, "conversations")).select("event_id", "message_ts")
    odd = spark.createDataFrame([(f"odd{i}", v) for i, v in enumerate(ODD_TS)], "event_id string, message_ts string")
    both = msgs.unionByName(odd)
    return both.select("event_id", message_secs("message_ts").alias("secs"),
                       F.unix_micros(message_instant("message_ts")).alias("instant_us"))


@register("message_cost", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_DOCUMENT_MESSAGES], f"""
SELECT event_id, {osql.cost()} AS cost FROM messages
UNION ALL SELECT event_id, {osql.cost()} FROM dmessages"""))
def q_message_cost(spark, sf_dir):
    from threadloom.functions import message_cost

    a = fx.conversation_messages(fx.table(spark, sf_dir, "conversations"))
    x = fx.document_messages(fx.table(spark, sf_dir, "documents"))
    return a.unionByName(x).select("event_id", message_cost().alias("cost"))


# ---------------------------------------------------------------- G4 over whole tables


def _window_sql(source_cte: list[str], source: str, gap: int) -> str:
    sel = f"""sel AS (SELECT 'all' AS scope, TRUE AS eligible, event_id, event_sequence, workspace_id, channel_id, message_ts,
  thread_ts, user_id, subtype, text, {osql.secs()} AS secs, {osql.cost()} AS cost FROM {source})"""
    return osql.with_ctes(source_cte + [sel] + osql.grouping_ctes(gap, "event_sequence"), """
SELECT group_id, kind, workspace_id, channel_id, CAST(first_secs AS BIGINT) AS first_secs, window_no, n_messages, cost,
       CAST(group_position AS BIGINT) AS group_position FROM ordered""")


def _all_groups(msgs: DataFrame, gap: int) -> DataFrame:
    sel = msgs.select(F.lit("all").alias("audience"), *inbox.NARROW)
    grouped = digest.group_messages(sel, ["audience"], gap, "event_sequence")
    return digest.ordered_groups(grouped).select(
        "group_id", "kind", "workspace_id", "channel_id", F.col("first_secs").cast("bigint"), "window_no",
        "n_messages", "cost", "group_position")


@register("channel_windows", _window_sql([fx.SQL_MESSAGES], "messages", 300))
def q_channel_windows(spark, sf_dir):
    return _all_groups(inbox.digest_ready(fx.conversation_messages(fx.table(spark, sf_dir, "conversations"))), 300)


@register("event_windows", _window_sql([fx.SQL_EVENT_MESSAGES], "emessages", 600))
def q_event_windows(spark, sf_dir):
    return _all_groups(inbox.digest_ready(fx.event_messages(fx.table(spark, sf_dir, "events"))), 600)


# ---------------------------------------------------------------- G10, G11


@register("next_segment", osql.with_ctes([fx.SQL_DOCUMENT_MESSAGES] + osql.segment_ctes("dmessages", 256), """
SELECT event_id, CAST(seg_end AS BIGINT) AS seg_end, CAST(text_continues AS BIGINT) AS text_continues, seg_cost FROM seg"""))
def q_next_segment(spark, sf_dir):
    x = fx.document_messages(fx.table(spark, sf_dir, "documents"))
    seg = segments.next_segment(x, 256)
    return seg.select("event_id", F.length("seg_text").cast("bigint").alias("seg_end"),
                      F.col("text_continues").cast("bigint"), F.col("seg_cost").cast("bigint"))


ALL_SEGMENTS = [fx.SQL_DOCUMENT_MESSAGES] + osql.all_segment_ctes("dmessages", 256)


@register("all_segments", osql.with_ctes(ALL_SEGMENTS, """
SELECT event_id, seg_no, seg_start, seg_end, text_continues, seg_cost, stalled FROM aseg""", recursive=True))
def q_all_segments(spark, sf_dir):
    x = fx.document_messages(fx.table(spark, sf_dir, "documents"))
    return segments.all_segments(x, 256).select("event_id", "seg_no", "seg_start", "seg_end", "text_continues",
                                                "seg_cost", "stalled")


# ---------------------------------------------------------------- I5-I9, I11, I12

from threadloom.operators import reports, retention, state  # noqa: E402

THREAD_KEYS_SQL = "tk AS (SELECT DISTINCT workspace_id, channel_id, thread_ts AS key_ts FROM messages WHERE thread_ts IS NOT NULL)"
THREAD_READ_SQL = """tread AS (
  SELECT k.workspace_id, k.channel_id, k.key_ts, m.event_id, m.message_ts, m.thread_ts
  FROM tk k JOIN messages m ON m.workspace_id = k.workspace_id AND m.channel_id = k.channel_id
   AND (m.thread_ts = k.key_ts OR m.message_ts = k.key_ts)
  CROSS JOIN params p WHERE m.observed_secs <= p.as_of_secs - 90)"""
MARKERS_SQL = """mk AS (SELECT workspace_id, channel_id, thread_ts AS key_ts, min(message_ts) AS after_ts
  FROM messages WHERE thread_ts IS NOT NULL GROUP BY workspace_id, channel_id, thread_ts)"""


def _thread_read(spark, sf_dir):
    conv, msgs, _, as_of = conv_inputs(spark, sf_dir)
    keys = msgs.where(F.col("thread_ts").isNotNull()).select("workspace_id", "channel_id", "thread_ts")
    return msgs, inbox.get_thread(msgs, keys, as_of)


def _markers(msgs):
    return (msgs.where(F.col("thread_ts").isNotNull()).groupBy("workspace_id", "channel_id", "thread_ts")
            .agg(F.min("message_ts").alias("after_ts")))


@register("thread_read", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_AS_OF, THREAD_KEYS_SQL, THREAD_READ_SQL],
          "SELECT workspace_id, channel_id, key_ts, event_id, message_ts FROM tread"))
def q_thread_read(spark, sf_dir):
    _, t = _thread_read(spark, sf_dir)
    return t.select("workspace_id", "channel_id", "key_ts", "event_id", "message_ts")


@register("thread_after", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_AS_OF, THREAD_KEYS_SQL, THREAD_READ_SQL, MARKERS_SQL], """
SELECT t.workspace_id, t.channel_id, t.key_ts, t.event_id, t.message_ts FROM tread t
LEFT JOIN mk ON mk.workspace_id = t.workspace_id AND mk.channel_id = t.channel_id AND mk.key_ts = t.key_ts
WHERE mk.after_ts IS NULL OR t.message_ts = t.key_ts OR t.message_ts > mk.after_ts"""))
def q_thread_after(spark, sf_dir):
    msgs, t = _thread_read(spark, sf_dir)
    return inbox.thread_after(t, _markers(msgs)).select("workspace_id", "channel_id", "key_ts", "event_id", "message_ts")


@register("thread_without_root", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_AS_OF, THREAD_KEYS_SQL, THREAD_READ_SQL],
          "SELECT workspace_id, channel_id, key_ts, event_id, message_ts FROM tread WHERE message_ts <> key_ts"))
def q_thread_without_root(spark, sf_dir):
    _, t = _thread_read(spark, sf_dir)
    return inbox.exclude_root(t).select("workspace_id", "channel_id", "key_ts", "event_id", "message_ts")


@register("message_lookup", osql.with_ctes([fx.SQL_MESSAGES], """
SELECT m.event_id, m.workspace_id, m.channel_id, m.message_ts FROM messages m
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT workspace_id, channel_id, thread_ts AS message_ts FROM messages WHERE thread_ts IS NOT NULL
                             UNION SELECT workspace_id, channel_id, message_ts || '9' FROM messages) k
              WHERE k.workspace_id = m.workspace_id AND k.channel_id = m.channel_id AND k.message_ts = m.message_ts)"""))
def q_message_lookup(spark, sf_dir):
    msgs = fx.conversation_messages(fx.table(spark, sf_dir, "conversations"))
    keys = (msgs.where(F.col("thread_ts").isNotNull()).select("workspace_id", "channel_id", F.col("thread_ts").alias("message_ts"))
            .unionByName(msgs.select("workspace_id", "channel_id", F.concat("message_ts", F.lit("9")).alias("message_ts"))))
    return inbox.get_messages(msgs, keys).select("event_id", "workspace_id", "channel_id", "message_ts")


def ack_requests(conv: DataFrame) -> DataFrame:
    """I9 requests: ids with (c + t) % 5 = 0 plus 'missing<c>' for c % 10 = 0, each sent twice, by both consumers."""
    c, t = F.col("conv_id"), F.col("turn")
    ids = conv.where((c + t) % 5 == 0).select(F.concat(F.lit("Ev"), F.lpad((c * 8 + t).cast("string"), 9, "0")).alias("event_id"))
    missing = conv.where((c % 10 == 0) & (t == 0)).select(F.concat(F.lit("missing"), c.cast("string")).alias("event_id"))
    once = ids.unionByName(missing)
    return inbox.with_consumers(once.unionByName(once), fx.CONSUMERS)


@register("ack_outcomes", osql.with_ctes(INBOX + ["""
req AS (
  SELECT c.consumer_id, r.event_id FROM (
    SELECT 'Ev' || lpad(CAST(conv_id * 8 + turn AS VARCHAR), 9, '0') AS event_id FROM conversations WHERE (conv_id + turn) % 5 = 0
    UNION ALL SELECT 'missing' || CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 10 = 0 AND turn = 0) r
  CROSS JOIN consumers c CROSS JOIN range(2) d)"""], """
SELECT DISTINCT r.consumer_id, r.event_id,
  CASE WHEN NOT EXISTS (SELECT 1 FROM messages m WHERE m.event_id = r.event_id) THEN 'unknown'
       WHEN EXISTS (SELECT 1 FROM acks a WHERE a.consumer_id = r.consumer_id AND a.event_id = r.event_id) THEN 'already'
       ELSE 'acknowledged' END AS outcome
FROM req r"""))
def q_ack_outcomes(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    msgs = fx.conversation_messages(conv)
    outcomes, _ = inbox.acknowledge(ack_requests(conv), msgs, fx.conversation_acks(conv))
    return outcomes


def receipt_frame(msgs: DataFrame) -> DataFrame:
    """Receipts issued at each message's arrival for consumer alpha; ids c % 13 = 0 lack a consumer."""
    k = F.expr("CAST(substr(event_id, 3) AS BIGINT)")
    c = F.expr("CAST(substr(event_id, 3) AS BIGINT) div 8")
    rec = msgs.select(F.when(c % 13 == 0, F.lit(None)).otherwise(F.lit("alpha")).alias("consumer_id"),
                      F.array("event_id").alias("event_ids"), k.alias("_k"), "observed_at")
    return inbox.issue_receipts(rec, F.col("observed_at")).drop("observed_at")


RECEIPT_SQL = """
rc AS (SELECT CASE WHEN (c * 8 + t) // 8 % 13 = 0 THEN NULL ELSE 'alpha' END AS consumer_id, event_id,
              observed_secs AS issued_secs, observed_secs + 7 * 86400 AS expires_secs FROM messages),
rp AS (SELECT min(observed_secs) + 7 * 86400 + (max(observed_secs) - min(observed_secs)) // 2 AS as_of_secs FROM messages)"""


@register("ack_lists", osql.with_ctes(INBOX + ["""
req AS (
  SELECT c.consumer_id, r.event_id FROM (
    SELECT 'Ev' || lpad(CAST(conv_id * 8 + turn AS VARCHAR), 9, '0') AS event_id FROM conversations WHERE (conv_id + turn) % 5 = 0
    UNION ALL SELECT 'missing' || CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 10 = 0 AND turn = 0) r
  CROSS JOIN consumers c CROSS JOIN range(2) d)"""], """
SELECT DISTINCT r.consumer_id, r.event_id,
  CASE WHEN NOT EXISTS (SELECT 1 FROM messages m WHERE m.event_id = r.event_id) THEN 'unknown'
       WHEN EXISTS (SELECT 1 FROM acks a WHERE a.consumer_id = r.consumer_id AND a.event_id = r.event_id) THEN 'already'
       ELSE 'acknowledged' END AS outcome
FROM req r"""))
def q_ack_lists(spark, sf_dir):
    """I9 with a list of ids a request, with repeats inside and between lists, a null id and an empty list."""
    conv = fx.table(spark, sf_dir, "conversations")
    msgs = fx.conversation_messages(conv)
    asked = ack_requests(conv).groupBy("consumer_id", F.pmod(F.xxhash64("event_id"), F.lit(50)).alias("request")).agg(F.collect_list("event_id").alias("event_ids"))
    asked = asked.select("consumer_id", F.array_append("event_ids", F.lit(None).cast("string")).alias("event_ids"))
    empty = asked.select("consumer_id", F.array().cast("array<string>").alias("event_ids")).distinct()
    outcomes, _ = inbox.acknowledge_lists(asked.unionByName(empty), msgs, fx.conversation_acks(conv))
    return outcomes.select("consumer_id", "event_id", "outcome")


@register("read_order", osql.with_ctes(INBOX + [THREAD_KEYS_SQL, THREAD_READ_SQL], f"""
SELECT 'changed' AS scope, event_id, row_number() OVER (ORDER BY event_sequence) AS position FROM messages, params
WHERE event_sequence > {CHANGED_AFTER} AND event_sequence <= upper_seq AND observed_secs <= as_of_secs - 90
UNION ALL SELECT consumer_id, event_id, row_number() OVER (PARTITION BY consumer_id ORDER BY event_sequence) FROM pending
UNION ALL SELECT workspace_id || ':' || channel_id || ':' || key_ts, event_id,
  row_number() OVER (PARTITION BY workspace_id, channel_id, key_ts ORDER BY message_ts) FROM tread"""))
def q_read_order(spark, sf_dir):
    """I2 and I3 in order of sequence, I5 in text order of the timestamp, each with its position."""
    conv, msgs, acks, as_of = conv_inputs(spark, sf_dir)
    up = inbox.latest_sequence_value(msgs)
    changed = inbox.in_read_order(inbox.changed_messages(msgs, CHANGED_AFTER, up, as_of).select("event_id", "event_sequence"), [], "event_sequence")
    pend = inbox.pending(msgs, acks, fx.CONSUMERS, up, as_of).select("consumer_id", "event_id", "event_sequence")
    pend = inbox.in_read_order(pend, ["consumer_id"], "event_sequence")
    key = ["workspace_id", "channel_id", "key_ts"]
    thread = inbox.in_read_order(_thread_read(spark, sf_dir)[1].select(*key, "event_id", "message_ts"), key, "message_ts")
    return (changed.select(F.lit("changed").alias("scope"), "event_id", "position")
            .unionByName(pend.select(F.col("consumer_id").alias("scope"), "event_id", "position"))
            .unionByName(thread.select(F.concat_ws(":", *key).alias("scope"), "event_id", "position")))


@register("receipts_valid", osql.with_ctes([fx.SQL_MESSAGES, RECEIPT_SQL], """
SELECT consumer_id, event_id AS event_ids,
       CASE WHEN consumer_id IS NULL THEN 'malformed' WHEN expires_secs < rp.as_of_secs THEN 'expired' ELSE 'valid' END AS status
FROM rc, rp"""))
def q_receipts_valid(spark, sf_dir):
    msgs = fx.conversation_messages(fx.table(spark, sf_dir, "conversations"))
    lo_hi = msgs.agg(F.min(F.unix_seconds("observed_at")).alias("lo"), F.max(F.unix_seconds("observed_at")).alias("hi")).first()
    import datetime as dt
    as_of = dt.datetime.fromtimestamp(lo_hi["lo"] + 7 * 86400 + (lo_hi["hi"] - lo_hi["lo"]) // 2, tz=dt.timezone.utc)
    good, bad = inbox.valid_receipts(receipt_frame(msgs), as_of)
    out = good.withColumn("status", F.lit("valid")).unionByName(bad.withColumnRenamed("reason", "status"))
    return out.select("consumer_id", F.array_join("event_ids", ",").alias("event_ids"), "status")


@register("segment_receipts", osql.with_ctes(ALL_SEGMENTS, """
SELECT event_id, seg_no FROM aseg WHERE text_continues IS NULL
UNION ALL SELECT event_id, 1 FROM dmessages WHERE event_id NOT IN (SELECT event_id FROM sd)""", recursive=True))
def q_segment_receipts(spark, sf_dir):
    """The one segment of every text that acknowledges it: its last, or the text itself when it fits whole."""
    x = fx.document_messages(fx.table(spark, sf_dir, "documents"))
    whole = segments.next_segment(x, 256).where(F.col("text_continues").isNull()).withColumn("seg_no", F.lit(1).cast("bigint"))
    parts = segments.all_segments(x, 256)
    return inbox.segment_receipts(whole.select("event_id", "seg_no", "text_continues")
                                  .unionByName(parts.select("event_id", "seg_no", F.col("text_continues").cast("int"))), "seg_no")


# ---------------------------------------------------------------- R1-R4


@register("retain_raw", osql.with_ctes([fx.SQL_EVENT_MESSAGES], """
SELECT event_id FROM emessages WHERE observed_us >= (SELECT max(observed_us) FROM emessages) - CAST(7 AS BIGINT) * 86400 * 1000000"""))
def q_retain_raw(spark, sf_dir):
    e = fx.event_messages(fx.table(spark, sf_dir, "events")).withColumnRenamed("observed_at", "received_at")
    as_of = e.agg(F.max("received_at").alias("m")).first()["m"]
    return retention.retain_raw(e, as_of).select("event_id")


RETAIN_SQL = """
rparams AS (SELECT 1700000000 + (max(conv_id) // 11) * 120 + 1000 AS cutoff FROM conversations),
rmsg AS (SELECT m.*, TRY_CAST(m.message_ts AS DECIMAL(20,6)) >= r.cutoff AS is_recent FROM messages m, rparams r),
retained AS (
  SELECT event_id, workspace_id, channel_id, message_ts, FALSE AS kept_by_reply FROM rmsg WHERE is_recent
  UNION ALL
  SELECT o.event_id, o.workspace_id, o.channel_id, o.message_ts, TRUE FROM rmsg o
  WHERE NOT COALESCE(o.is_recent, FALSE) AND EXISTS (
    SELECT 1 FROM rmsg r WHERE r.is_recent AND r.workspace_id = o.workspace_id AND r.channel_id = o.channel_id
      AND r.thread_ts = o.message_ts))"""


def _retained(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    msgs = fx.conversation_messages(conv)
    hi = conv.agg(F.max(F.expr("conv_id div 11")).alias("m")).first()["m"]
    import datetime as dt
    cutoff = fx.BASE_SECS + hi * 120 + 1000
    as_of = dt.datetime.fromtimestamp(cutoff + 86400, tz=dt.timezone.utc)
    return conv, msgs, retention.retain_messages(msgs, as_of, days=1)


@register("retain_messages", osql.with_ctes([fx.SQL_MESSAGES, RETAIN_SQL], "SELECT event_id, kept_by_reply FROM retained"))
def q_retain_messages(spark, sf_dir):
    _, _, kept = _retained(spark, sf_dir)
    return kept.select("event_id", "kept_by_reply")


@register("retain_index", osql.with_ctes([fx.SQL_MESSAGES, RETAIN_SQL], """
SELECT DISTINCT i.workspace_id, i.channel_id, i.thread_ts AS root_ts FROM messages i
WHERE i.thread_ts IS NOT NULL AND EXISTS (SELECT 1 FROM retained r WHERE r.workspace_id = i.workspace_id
  AND r.channel_id = i.channel_id AND r.message_ts = i.thread_ts)"""))
def q_retain_index(spark, sf_dir):
    _, msgs, kept = _retained(spark, sf_dir)
    index = msgs.where(F.col("thread_ts").isNotNull()).select(
        "workspace_id", "channel_id", F.col("thread_ts").alias("root_ts")).distinct()
    return retention.retain_index(index, kept)


@register("retain_acks", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_ACKS, RETAIN_SQL], """
SELECT consumer_id, event_id FROM acks WHERE event_id IN (SELECT event_id FROM retained)"""))
def q_retain_acks(spark, sf_dir):
    conv, _, kept = _retained(spark, sf_dir)
    return retention.retain_acks(fx.conversation_acks(conv), kept).select("consumer_id", "event_id")


# ---------------------------------------------------------------- D6, D7, D10, D11, M1-M3, N16, N17


def _targets_meta(spark, sf_dir):
    conv, msgs, _, as_of = conv_inputs(spark, sf_dir)
    targets = state.targets_state(fx.target_registrations(msgs, as_of), fx.target_toggles(spark, as_of))
    look = fx.metadata_lookups(targets, as_of)
    ws_log, ch_log = state.split_lookups(look)
    ws = state.metadata_state(ws_log, ["workspace_id"], "workspace_name")
    ch = state.metadata_state(ch_log, ["workspace_id", "channel_id"], "channel_name")
    return msgs, as_of, targets, ws, ch


TM = [fx.SQL_MESSAGES, fx.SQL_AS_OF, fx.SQL_TARGETS, fx.SQL_METADATA]


@register("targets_state", osql.with_ctes(TM, """
SELECT workspace_id, channel_id, enabled, created_at AS created_secs, updated_at AS updated_secs FROM targets"""))
def q_targets_state(spark, sf_dir):
    _, _, targets, _, _ = _targets_meta(spark, sf_dir)
    return targets.select("workspace_id", "channel_id", "enabled", F.unix_seconds("created_at").alias("created_secs"),
                          F.unix_seconds("updated_at").alias("updated_secs"))


@register("metadata_state", osql.with_ctes(TM, """
SELECT workspace_id, CAST(NULL AS VARCHAR) AS channel_id, workspace_name AS name, last_synced_at AS synced_secs,
       last_attempted_at AS attempted_secs, last_error FROM wsmeta
UNION ALL
SELECT workspace_id, channel_id, channel_name, last_synced_at, last_attempted_at, last_error FROM chmeta"""))
def q_metadata_state(spark, sf_dir):
    _, _, _, ws, ch = _targets_meta(spark, sf_dir)
    cols = lambda n: [F.col(n).alias("name"), F.unix_seconds("last_synced_at").alias("synced_secs"),
                      F.unix_seconds("last_attempted_at").alias("attempted_secs"), "last_error"]
    return (ws.select("workspace_id", F.lit(None).cast("string").alias("channel_id"), *cols("workspace_name"))
            .unionByName(ch.select("workspace_id", "channel_id", *cols("channel_name"))))


@register("metadata_due", osql.with_ctes(TM, """
SELECT t.workspace_id, t.channel_id,
  NOT COALESCE((w.workspace_name IS NOT NULL AND w.last_synced_at > p.as_of_secs - 24 * 3600) OR w.last_attempted_at > p.as_of_secs - 900, FALSE) AS workspace_due,
  NOT COALESCE((c.channel_name IS NOT NULL AND c.last_synced_at > p.as_of_secs - 24 * 3600) OR c.last_attempted_at > p.as_of_secs - 900, FALSE) AS channel_due
FROM targets t CROSS JOIN params p LEFT JOIN wsmeta w ON w.workspace_id = t.workspace_id
LEFT JOIN chmeta c ON c.workspace_id = t.workspace_id AND c.channel_id = t.channel_id"""))
def q_metadata_due(spark, sf_dir):
    _, as_of, targets, ws, ch = _targets_meta(spark, sf_dir)
    return state.metadata_due(targets, ws, ch, as_of)


@register("list_channels", osql.with_ctes(TM, """
SELECT row_number() OVER (ORDER BY max(m.observed_secs) DESC NULLS LAST, t.channel_id, t.workspace_id) AS position,
       t.workspace_id, w.workspace_name, t.channel_id, c.channel_name, t.enabled,
       CAST(count(m.event_id) AS BIGINT) AS message_count, max(m.observed_secs) AS last_observed_secs,
       CASE WHEN w.workspace_name IS NOT NULL AND w.workspace_name <> '' AND w.workspace_name <> t.workspace_id THEN w.workspace_name ELSE t.workspace_id END AS workspace_ref,
       CASE WHEN c.channel_name IS NOT NULL AND c.channel_name <> '' AND c.channel_name <> t.channel_id THEN c.channel_name ELSE t.channel_id END AS channel_ref
FROM targets t LEFT JOIN messages m ON m.workspace_id = t.workspace_id AND m.channel_id = t.channel_id
LEFT JOIN wsmeta w ON w.workspace_id = t.workspace_id LEFT JOIN chmeta c ON c.workspace_id = t.workspace_id AND c.channel_id = t.channel_id
GROUP BY t.workspace_id, w.workspace_name, t.channel_id, c.channel_name, t.enabled"""))
def q_list_channels(spark, sf_dir):
    msgs, _, targets, ws, ch = _targets_meta(spark, sf_dir)
    out = reports.list_channels(targets, msgs, ws, ch)
    return out.select("position", "workspace_id", "workspace_name", "channel_id", "channel_name", "enabled", "message_count",
                      F.unix_seconds("last_observed_at").alias("last_observed_secs"), "workspace_ref", "channel_ref")


@register("message_names", osql.with_ctes(TM, """
SELECT m.event_id, m.workspace_id, w.workspace_name, m.channel_id, c.channel_name FROM messages m
LEFT JOIN wsmeta w ON w.workspace_id = m.workspace_id
LEFT JOIN chmeta c ON c.workspace_id = m.workspace_id AND c.channel_id = m.channel_id"""))
def q_message_names(spark, sf_dir):
    """N16 on messages."""
    msgs, _, _, ws, ch = _targets_meta(spark, sf_dir)
    return reports.with_names(msgs, ws, ch).select("event_id", "workspace_id", "workspace_name", "channel_id", "channel_name")


@register("status", osql.with_ctes(TM, """
SELECT (SELECT count(*) FROM messages) AS events, (SELECT max(observed_secs) FROM messages) AS last_received_secs,
       (SELECT count(*) FROM messages) AS messages,
       (SELECT CAST(min(TRY_CAST(message_ts AS DECIMAL(20,6))) * 1000000 AS BIGINT) FROM messages) AS earliest_message_us,
       (SELECT count(*) FROM targets WHERE enabled) AS channels"""))
def q_status(spark, sf_dir):
    msgs, _, targets, _, _ = _targets_meta(spark, sf_dir)
    raw = msgs.select("event_id", F.col("observed_at").alias("received_at"))
    s = reports.status(raw, msgs, targets)
    return s.select("events", F.unix_seconds("last_received_at").alias("last_received_secs"), "messages",
                    F.unix_micros("earliest_message_at").alias("earliest_message_us"), "channels")


# ---------------------------------------------------------------- S1, N1-N6, S3-S6, N7, N8, D1-D5, D8, D9, B1, B3

from threadloom.operators import dedupe, thread_index  # noqa: E402
from threadloom.sources import envelopes as env  # noqa: E402
from threadloom.sources import history, metadata  # noqa: E402


def _sfield(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"


ENV_SQL = [fx.SQL_MESSAGES, fx.SQL_ENVELOPES, f"""
envj AS (SELECT CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j, observed_secs, arrival FROM envelopes)""", f"""
payloads AS (
  SELECT {_sfield('j', '$.envelope_id')} AS envelope_id, json_extract(j, '$.payload') AS p, observed_secs, arrival
  FROM envj WHERE {_sfield('j', '$.type')} = 'events_api' AND json_type(j, '$.payload') = 'OBJECT')""", f"""
tagged AS (
  SELECT *, CASE WHEN COALESCE({_sfield('p', '$.event_id')}, '') = '' THEN 'missing event_id'
                 WHEN COALESCE({_sfield('p', '$.team_id')}, '') = '' THEN 'missing team_id'
                 WHEN COALESCE({_sfield('p', '$.type')}, '') = '' THEN 'missing type' END AS reject_reason
  FROM payloads)""", f"""
raw AS (
  SELECT {_sfield('p', '$.event_id')} AS event_id, {_sfield('p', '$.team_id')} AS workspace_id,
         {_sfield('p', '$.api_app_id')} AS api_app_id, {_sfield('p', '$.type')} AS callback_type,
         CASE WHEN json_type(p, '$.event') = 'OBJECT' THEN json_extract(p, '$.event') END AS ev, observed_secs, arrival
  FROM tagged WHERE reject_reason IS NULL)"""]


def _envelopes(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    good, bad = env.validate(env.envelope_payloads(fx.conversation_envelopes(conv)))
    return good, bad


@register("envelope_raw", osql.with_ctes(ENV_SQL, f"""
SELECT event_id, workspace_id, api_app_id, callback_type, {_sfield('ev', '$.type')} AS event_type,
       {_sfield('ev', '$.event_ts')} AS event_ts FROM raw"""))
def q_envelope_raw(spark, sf_dir):
    good, _ = _envelopes(spark, sf_dir)
    return good.select("event_id", "workspace_id", "api_app_id", "callback_type", "event_type", "event_ts")


@register("envelope_parse", osql.with_ctes(ENV_SQL, f"""
SELECT event_id, workspace_id, {_sfield('ev', '$.channel')} AS channel_id, {_sfield('ev', '$.ts')} AS message_ts,
       {_sfield('ev', '$.thread_ts')} AS thread_ts, {_sfield('ev', '$.user')} AS user_id,
       {_sfield('ev', '$.subtype')} AS subtype, {_sfield('ev', '$.text')} AS text
FROM raw WHERE {_sfield('ev', '$.type')} = 'message' AND {_sfield('ev', '$.channel')} IS NOT NULL
  AND {_sfield('ev', '$.ts')} IS NOT NULL"""))
def q_envelope_parse(spark, sf_dir):
    good, _ = _envelopes(spark, sf_dir)
    return env.normalise(good).select(
        "event_id", "workspace_id", "channel_id", "message_ts", "thread_ts", "user_id", "subtype", "text")


@register("envelope_rejects", osql.with_ctes(ENV_SQL, "SELECT envelope_id, reject_reason FROM tagged WHERE reject_reason IS NOT NULL"))
def q_envelope_rejects(spark, sf_dir):
    _, bad = _envelopes(spark, sf_dir)
    return bad.select("envelope_id", "reject_reason")


PAGE_SQL = [fx.SQL_MESSAGES, fx.SQL_AS_OF, fx.SQL_PAGES]


def _pages(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    as_of = fx.conversation_as_of(conv)
    return conv, as_of, history.parse_pages(fx.history_pages(conv, as_of))


def _history_rows(spark, sf_dir):
    conv, as_of, parsed = _pages(spark, sf_dir)
    items = history.history_messages(history.page_messages(parsed))
    rows = history.history_rows(items.withColumn("observed_at", F.col("fetched_at")), history.HISTORY_CALLBACK, "observed_at",
                                extra=("job_id",))
    return conv, as_of, items, rows


@register("history_parse", osql.with_ctes(PAGE_SQL, """
SELECT 'history:' || workspace_id || ':' || channel_id || ':' || message_ts AS event_id, page_id, item_no, workspace_id,
       channel_id, message_ts, reply_count, latest_reply FROM hitems"""))
def q_history_parse(spark, sf_dir):
    _, _, items, rows = _history_rows(spark, sf_dir)
    return items.select(history.history_event_id().alias("event_id"), "page_id",
                        F.col("item_no").cast("bigint").alias("item_no"), "workspace_id", "channel_id",
                        history.str_field("m", "$.ts").alias("message_ts"),
                        history.count_field("m", "$.reply_count", None).alias("reply_count"),
                        history.str_field("m", "$.latest_reply").alias("latest_reply"))


@register("page_cursors", osql.with_ctes(PAGE_SQL, """
SELECT page_id, CASE WHEN json_type(body, '$.response_metadata') = 'OBJECT' AND json_type(body, '$.response_metadata.next_cursor') = 'VARCHAR'
                      AND json_extract_string(body, '$.response_metadata.next_cursor') <> ''
                     THEN json_extract_string(body, '$.response_metadata.next_cursor') END AS next_cursor
FROM pages WHERE json_type(body, '$.ok') = 'BOOLEAN' AND CAST(json_extract(body, '$.ok') AS BOOLEAN) AND status BETWEEN 200 AND 299"""))
def q_page_cursors(spark, sf_dir):
    _, _, parsed = _pages(spark, sf_dir)
    return parsed.where("ok").select("page_id", "next_cursor")


@register("page_errors", osql.with_ctes(PAGE_SQL, """
SELECT page_id, COALESCE(CASE WHEN json_type(body, '$.error') = 'VARCHAR' THEN json_extract_string(body, '$.error') END,
                         'HTTP ' || CAST(status AS VARCHAR)) AS error
FROM pages WHERE NOT (COALESCE(json_type(body, '$.ok') = 'BOOLEAN', FALSE) AND COALESCE(CAST(json_extract(body, '$.ok') AS BOOLEAN), FALSE)
                      AND status BETWEEN 200 AND 299)"""))
def q_page_errors(spark, sf_dir):
    _, _, parsed = _pages(spark, sf_dir)
    return history.page_errors(parsed).select("page_id", "error")


OBS_SQL = """
obs AS (SELECT job_id, workspace_id, channel_id, message_ts AS root_ts, COALESCE(reply_count, 0) AS reply_count,
               latest_reply AS latest_reply_ts, fetched_secs AS indexed_at FROM hitems WHERE thread_ts IS NULL),
fcount AS (
  SELECT f.workspace_id, f.channel_id, f.root_ts, f.fetched_secs, arg_max(o.reply_count, o.indexed_at) AS fetched_reply_count
  FROM fetches f JOIN obs o ON o.workspace_id = f.workspace_id AND o.channel_id = f.channel_id AND o.root_ts = f.root_ts
   AND o.indexed_at <= f.fetched_secs
  GROUP BY f.workspace_id, f.channel_id, f.root_ts, f.fetched_secs),
tindex AS (
  SELECT i.*, COALESCE(l.fetched_reply_count, 0) AS fetched_reply_count, l.fetched_secs FROM (
    SELECT workspace_id, channel_id, root_ts, arg_max(reply_count, indexed_at) AS observed_reply_count,
           arg_max_null(latest_reply_ts, indexed_at) AS latest_reply_ts, max(indexed_at) AS indexed_secs
    FROM obs GROUP BY workspace_id, channel_id, root_ts) i
  LEFT JOIN (SELECT workspace_id, channel_id, root_ts, arg_max(fetched_reply_count, fetched_secs) AS fetched_reply_count,
                    max(fetched_secs) AS fetched_secs FROM fcount GROUP BY workspace_id, channel_id, root_ts) l
    ON l.workspace_id = i.workspace_id AND l.channel_id = i.channel_id AND l.root_ts = i.root_ts)"""


def _index(spark, sf_dir):
    conv, as_of, items, rows = _history_rows(spark, sf_dir)
    obs = thread_index.observations(rows)
    fetches = fx.reply_fetches(conv, as_of)
    return conv, as_of, items, rows, obs, fetches


@register("thread_index", osql.with_ctes(PAGE_SQL + [OBS_SQL], """
SELECT workspace_id, channel_id, root_ts, CAST(observed_reply_count AS BIGINT) AS observed_reply_count,
       CAST(fetched_reply_count AS BIGINT) AS fetched_reply_count, latest_reply_ts, indexed_secs, fetched_secs FROM tindex"""))
def q_thread_index(spark, sf_dir):
    _, _, _, _, obs, fetches = _index(spark, sf_dir)
    idx = thread_index.thread_index(obs, fetches)
    return idx.select("workspace_id", "channel_id", "root_ts", "observed_reply_count", "fetched_reply_count",
                      "latest_reply_ts", F.unix_seconds("indexed_at").alias("indexed_secs"),
                      F.unix_seconds("fetched_at").alias("fetched_secs"))


@register("stale_threads", osql.with_ctes(PAGE_SQL + [OBS_SQL], """
SELECT workspace_id, channel_id, root_ts FROM tindex WHERE observed_reply_count > fetched_reply_count"""))
def q_stale_threads(spark, sf_dir):
    _, _, _, _, obs, fetches = _index(spark, sf_dir)
    return thread_index.stale_threads(thread_index.thread_index(obs, fetches)).select("workspace_id", "channel_id", "root_ts")


FEED = [fx.SQL_MESSAGES, fx.SQL_FEED,
        "ev1 AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1)"]


def _feed(spark, sf_dir):
    return fx.conversation_feed(fx.table(spark, sf_dir, "conversations"))


def _reply_rows(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    pages = history.parse_pages(fx.reply_pages(conv, fx.conversation_as_of(conv)))
    items = history.reply_messages(history.page_messages(pages))
    return history.history_rows(items, history.THREAD_CALLBACK, extra=("root_ts",))


@register("reply_parse", osql.with_ctes([fx.SQL_MESSAGES, fx.SQL_REPLY_FEED], """
SELECT event_id, workspace_id, channel_id, message_ts, thread_ts, user_id, text,
       CAST(1700000000 + (c // 11) * 240 AS VARCHAR) || '.' || lpad(CAST((c * 8) % 1000000 AS VARCHAR), 6, '0') AS root_ts FROM replyfeed"""))
def q_reply_parse(spark, sf_dir):
    return _reply_rows(spark, sf_dir).select("event_id", "workspace_id", "channel_id", "message_ts", "thread_ts", "user_id", "text", "root_ts")


@register("feed_union", osql.with_ctes(FEED + [fx.SQL_REPLY_FEED], """
SELECT event_id, callback_type, text FROM feed
UNION ALL SELECT event_id, 'thread_backfill', text FROM replyfeed"""))
def q_feed_union(spark, sf_dir):
    """Live, history and thread feeds, each from its own source, with their own columns."""
    f = _feed(spark, sf_dir)
    live = f.where(F.col("callback_type") == "event_callback")
    hist = f.where(F.col("callback_type") == "history_backfill").drop("subtype")
    return dedupe.union_feeds(live, hist, _reply_rows(spark, sf_dir)).select("event_id", "callback_type", "text")


@register("dedupe_events", osql.with_ctes(FEED, "SELECT event_id, callback_type, arrival, text FROM ev1"))
def q_dedupe_events(spark, sf_dir):
    return dedupe.dedupe_events(_feed(spark, sf_dir)).select("event_id", "callback_type", "arrival", "text")


@register("dedupe_messages", osql.with_ctes(FEED, """
SELECT event_id, workspace_id, channel_id, message_ts, text FROM ev1
QUALIFY row_number() OVER (PARTITION BY workspace_id, channel_id, message_ts ORDER BY arrival) = 1"""))
def q_dedupe_messages(spark, sf_dir):
    first = dedupe.dedupe_events(_feed(spark, sf_dir))
    return dedupe.dedupe_messages(first, order=["arrival"]).select(
        "event_id", "workspace_id", "channel_id", "message_ts", "text")


@register("sequence_order", osql.with_ctes(PAGE_SQL, """
SELECT event_id, CAST((SELECT upper_seq FROM params) + row_number() OVER (ORDER BY TRY_CAST(message_ts AS DECIMAL(20,6)), event_id) AS BIGINT) AS event_sequence
FROM (SELECT 'history:' || workspace_id || ':' || channel_id || ':' || message_ts AS event_id, message_ts FROM hitems
      QUALIFY row_number() OVER (PARTITION BY workspace_id, channel_id, message_ts ORDER BY fetched_secs, page_id) = 1) x"""))
def q_sequence_order(spark, sf_dir):
    conv, as_of, items, rows = _history_rows(spark, sf_dir)
    base = inbox.latest_sequence_value(fx.conversation_messages(conv))
    first = dedupe.first_per_key(rows.withColumn("page_id", F.lit(None)), ["event_id"], [F.col("observed_at")])
    return dedupe.assign_sequence(first, [F.col("ts_num"), F.col("event_id")], base).select("event_id", "event_sequence")


@register("metadata_parse", osql.with_ctes(TM + [f"""
resp AS (
  SELECT workspace_id, channel_id, 'team' AS kind,
         CASE WHEN TRY_CAST(substr(workspace_id, 2) AS INTEGER) = 2 THEN '{{"ok":true,"team":{{}}}}'
              WHEN TRY_CAST(substr(channel_id, 2) AS INTEGER) = 4 THEN '{{"ok":true,"team":{{"name":""}}}}'
              ELSE '{{"ok":true,"team":{{"name":"Team ' || CAST(TRY_CAST(substr(workspace_id, 2) AS INTEGER) AS VARCHAR) || '"}}}}' END AS body,
         CASE WHEN TRY_CAST(substr(channel_id, 2) AS INTEGER) = 6 THEN 500 ELSE 200 END AS status FROM targets
  UNION ALL
  SELECT workspace_id, channel_id, 'channel',
         CASE WHEN TRY_CAST(substr(channel_id, 2) AS INTEGER) % 7 = 3 THEN '{{"ok":false,"error":"channel_not_found"}}'
              WHEN TRY_CAST(substr(channel_id, 2) AS INTEGER) % 2 = 0 THEN '{{"ok":true,"channel":{{"name":"chan-' || CAST(TRY_CAST(substr(channel_id, 2) AS INTEGER) AS VARCHAR) || '"}}}}'
              ELSE '{{"ok":true,"channel":{{"is_im":true}}}}' END,
         CASE WHEN TRY_CAST(substr(channel_id, 2) AS INTEGER) % 7 = 3 THEN 404 ELSE 200 END FROM targets)""", f"""
rj AS (SELECT *, CAST(body AS JSON) AS j FROM resp)""", f"""
rerr AS (
  SELECT *, CASE WHEN NOT COALESCE(json_type(j, '$.ok') = 'BOOLEAN' AND CAST(json_extract(j, '$.ok') AS BOOLEAN), FALSE) OR status NOT BETWEEN 200 AND 299
                 THEN 'lookup failed: ' || COALESCE({_sfield('j', '$.error')}, 'HTTP ' || CAST(status AS VARCHAR))
                 WHEN kind = 'team' AND COALESCE({_sfield('j', '$.team.name')}, '') = '' THEN 'no team name' END AS error
  FROM rj)"""], f"""
SELECT workspace_id, channel_id, kind, error IS NULL AS ok,
       CASE WHEN error IS NULL THEN CASE WHEN kind = 'team' THEN {_sfield('j', '$.team.name')}
                                         ELSE COALESCE({_sfield('j', '$.channel.name')}, channel_id) END END AS name, error
FROM rerr"""))
def q_metadata_parse(spark, sf_dir):
    _, as_of, targets, _, _ = _targets_meta(spark, sf_dir)
    return metadata.read_metadata(fx.metadata_responses(targets, as_of)).select(
        "workspace_id", "channel_id", "kind", "ok", "name", "error")


# ---------------------------------------------------------------- B7-B9

from threadloom.operators import lifecycle  # noqa: E402


def _gaps(spark, sf_dir):
    log = fx.lifecycle_log(fx.table(spark, sf_dir, "events"))
    return log, lifecycle.downtime_gaps(log)


@register("downtime_gaps", osql.with_ctes([fx.SQL_LIFECYCLE], "SELECT source, start_us, end_us FROM gaps"))
def q_downtime_gaps(spark, sf_dir):
    _, gaps = _gaps(spark, sf_dir)
    return gaps


@register("suggestions", osql.with_ctes([fx.SQL_LIFECYCLE], """
SELECT g.source, g.start_us, g.end_us, COALESCE((SELECT arg_min(d.decision, d.decided_at) FROM decisions d
  WHERE d.source = g.source AND d.start_us = g.start_us AND d.end_us = g.end_us), 'pending') AS state FROM gaps g"""))
def q_suggestions(spark, sf_dir):
    _, gaps = _gaps(spark, sf_dir)
    return lifecycle.decision_state(gaps, fx.suggestion_decisions(gaps))


@register("pending_suggestions", osql.with_ctes([fx.SQL_LIFECYCLE], """
SELECT source, start_us, end_us, row_number() OVER (ORDER BY start_us DESC, end_us DESC, source) AS position FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM decisions d
  WHERE d.source = g.source AND d.start_us = g.start_us AND d.end_us = g.end_us)"""))
def q_pending_suggestions(spark, sf_dir):
    _, gaps = _gaps(spark, sf_dir)
    return lifecycle.pending_suggestions(gaps, fx.suggestion_decisions(gaps))


@register("health", osql.with_ctes([fx.SQL_LIFECYCLE], """
SELECT source, COALESCE(arg_max(kind, (at_us, seq)) FILTER (WHERE kind IN ('connected', 'disconnected')), 'unknown') AS state,
       max(at_us) FILTER (WHERE kind = 'connected') AS last_connected_us,
       max(at_us) FILTER (WHERE kind = 'disconnected') AS last_disconnected_us,
       max(at_us) FILTER (WHERE kind = 'event') AS last_event_us
FROM lc GROUP BY source"""))
def q_health(spark, sf_dir):
    log = fx.lifecycle_log(fx.table(spark, sf_dir, "events"))
    h = lifecycle.health(log)
    return h.select("source", "state", F.unix_micros("last_connected_at").alias("last_connected_us"),
                    F.unix_micros("last_disconnected_at").alias("last_disconnected_us"),
                    F.unix_micros("last_event_at").alias("last_event_us"))


# ---------------------------------------------------------------- S2, S8, T1-T8 (availableNow streams)

from threadloom.sources import feeds  # noqa: E402
from threadloom.streaming import ingest, purge  # noqa: E402


LANDED_ROW_GROUP = 4 << 20  # bytes of a row group of a landed file; a file is read by as many tasks as it has groups


def _land_file(df: DataFrame, path: str) -> None:
    """Append ``df`` as one file that several tasks can read; its rows are made where they lie and only written by one task."""
    df.repartition(1).write.mode("append").option("parquet.block.size", LANDED_ROW_GROUP).parquet(path)


def _land(df: DataFrame, order: str, parts: int, path: str) -> None:
    """Write ``df`` as ``parts`` files in the order of ``order``, one after the other, as a feed would."""
    mark = staged_so_far()
    df = stage(df, "landing")  # made once, not once a file
    last = staged_so_far()
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = (span["hi"] - span["lo"]) // parts + 1
    for k in range(parts):
        _land_file(df.where((F.col(order) - span["lo"]).between(k * width, (k + 1) * width - 1)), path)
    drop_between(mark, last)


def _ingested(spark, sf_dir, files: int = 4, per_trigger: int = 1) -> str:
    """Envelopes of A, landed in order of arrival, then all of them once more; returns the root of the tables."""
    lines = fx.conversation_envelopes(fx.table(spark, sf_dir, "conversations"))
    root = scratch_path(spark, "stream", "ingest")
    _land(lines, "arrival", files, f"{root}/landing")
    again = lines.withColumn("arrival", F.col("arrival") + 1_000_000_000).withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR"))
    _land_file(again, f"{root}/landing")
    ingest.start_ingest(spark, ingest.envelope_stream(spark, f"{root}/landing", per_trigger, "parquet"), f"{root}/tables",
                        f"{root}/checkpoint").awaitTermination()
    return f"{root}/tables"


STREAM_SQL = ENV_SQL + [f"""
sm AS (
  SELECT event_id, workspace_id, {_sfield('ev', '$.channel')} AS channel_id, {_sfield('ev', '$.ts')} AS message_ts,
         {_sfield('ev', '$.thread_ts')} AS thread_ts, {_sfield('ev', '$.user')} AS user_id, {_sfield('ev', '$.subtype')} AS subtype,
         {_sfield('ev', '$.text')} AS text, observed_secs,
         row_number() OVER (ORDER BY part, observed_secs, arrival, {_sfield('ev', '$.event_ts')}, event_id) AS event_sequence
  FROM (SELECT *, (arrival - (SELECT min(arrival) FROM envelopes)) // (((SELECT max(arrival) - min(arrival) FROM envelopes)) // 4 + 1) AS part FROM raw) x
  WHERE {_sfield('ev', '$.type')} = 'message' AND {_sfield('ev', '$.channel')} IS NOT NULL AND {_sfield('ev', '$.ts')} IS NOT NULL)"""]


@register("stream_ingest", osql.with_ctes(STREAM_SQL, """
SELECT event_id, CAST(event_sequence AS BIGINT) AS event_sequence, workspace_id, channel_id, message_ts, thread_ts, user_id, subtype, text FROM sm"""))
def q_stream_ingest(spark, sf_dir):
    """A feed of four files and a replay of everything."""
    return ingest.read_messages(spark, _ingested(spark, sf_dir)).select(
        "event_id", "event_sequence", "workspace_id", "channel_id", "message_ts", "thread_ts", "user_id", "subtype", "text")


@register("envelope_quarantine", osql.with_ctes(ENV_SQL, """
SELECT envelope_id, reject_reason FROM tagged CROSS JOIN range(2) r WHERE reject_reason IS NOT NULL"""))
def q_envelope_quarantine(spark, sf_dir):
    """N3 in the stream: every rejected envelope, replayed ones included."""
    return ingest.read_quarantine(spark, _ingested(spark, sf_dir)).select("envelope_id", "reject_reason")


STREAM_AFTER = 50


@register("stream_changed", osql.with_ctes(STREAM_SQL, f"""
SELECT event_id, CAST(event_sequence AS BIGINT) AS event_sequence FROM sm
WHERE event_sequence > {STREAM_AFTER} AND observed_secs <= (SELECT max(observed_secs) FROM sm) - 90 - 600"""))
def q_stream_changed(spark, sf_dir):
    """Settled messages after a sequence number, from the ingested tables."""
    root = _ingested(spark, sf_dir)
    as_of = ingest.read_messages(spark, root).agg((F.max("observed_at") - F.expr("INTERVAL 600 SECONDS")).alias("m")).first()["m"]
    return ingest.read_changed(spark, root, STREAM_AFTER, as_of, 90).select("event_id", "event_sequence")


@register("stream_targets", osql.with_ctes(STREAM_SQL, """
SELECT workspace_id, channel_id, min(observed_secs) AS created_secs, max(observed_secs) AS updated_secs FROM sm GROUP BY ALL"""))
def q_stream_targets(spark, sf_dir):
    """Channels register when their first message arrives; a later one moves only the last time."""
    t = state.targets_state(ingest.read_targets(spark, _ingested(spark, sf_dir)))
    return t.select("workspace_id", "channel_id", F.unix_seconds("created_at").alias("created_secs"),
                    F.unix_seconds("updated_at").alias("updated_secs"))


STREAM_INBOX = [fx.SQL_MESSAGES.replace("messages AS", "amessages AS", 1)] + [
    c.replace("FROM messages", "FROM amessages") for c in STREAM_SQL[1:]] + [
    "messages AS (SELECT *, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS t FROM sm)",
    "acks AS (SELECT 'alpha' AS consumer_id, event_id, observed_secs AS acknowledged_secs FROM messages WHERE event_sequence % 3 = 0)"]


@register("stream_inbox", osql.with_ctes(STREAM_INBOX + osql.inbox_ctes()[2:] + GROUPING + osql.batch_ctes(16000), """
SELECT scope AS consumer_id, group_id, kind, CAST(group_position AS BIGINT) AS group_position, CAST(estimated_tokens AS BIGINT) AS estimated_tokens
FROM dgroups"""))
def q_stream_inbox(spark, sf_dir):
    """Ingest, then the first batch of two consumers over what was ingested; alpha acked every third message."""
    msgs = inbox.digest_ready(ingest.read_messages(spark, _ingested(spark, sf_dir)))
    acks = msgs.where("event_sequence % 3 = 0").select(F.lit("alpha").alias("consumer_id"), "event_id", F.col("observed_at").alias("acknowledged_at"))
    as_of = msgs.agg((F.max("observed_at") - F.expr("INTERVAL 605 SECONDS")).alias("m")).first()["m"]
    _, batch = digest.inbox_digest(msgs, acks, fx.CONSUMERS, as_of, 16000)
    return batch.groups.select("consumer_id", "group_id", "kind", F.col("group_position").cast("bigint"), "estimated_tokens")


def _windowed(spark, sf_dir, files: int, per_trigger: int) -> DataFrame:
    root = scratch_path(spark, "stream", "windows")
    msgs = fx.event_messages(fx.table(spark, sf_dir, "events"))
    msgs.repartition(files).write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/landing")
    ingest.start_windows(stream, 600, f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    return ingest.read_windows(spark, f"{root}/tables")


@register("stream_windows", osql.with_ctes([fx.SQL_EVENT_MESSAGES, f"""sel AS (SELECT 'all' AS scope, TRUE AS eligible, event_id, event_sequence, workspace_id, channel_id, message_ts,
  thread_ts, user_id, subtype, text, {osql.secs()} AS secs, {osql.cost()} AS cost FROM emessages)"""] + osql.grouping_ctes(600, "event_sequence"), """
SELECT workspace_id, channel_id, CAST(min(secs) AS BIGINT) AS start_secs, CAST(count(*) AS BIGINT) AS n_messages
FROM stdw GROUP BY scope, workspace_id, channel_id, window_no"""))
def q_stream_windows(spark, sf_dir):
    """E messages, shuffled over files and so out of order, through the window stream (T4, T5)."""
    return _windowed(spark, sf_dir, 4, 2).select("workspace_id", "channel_id", F.col("first_secs").cast("bigint").alias("start_secs"), "n_messages")


def _parts(rows: str, key: str) -> str:
    """The file a row of a feed lands in, as ``_land`` deals four of them."""
    return f"({key} - (SELECT min({key}) FROM {rows})) // ((SELECT max({key}) - min({key}) FROM {rows}) // 4 + 1)"


PLACE = "(c * 37) % 101"  # pages land in another order than their messages did, so some come before the event and some after
STORE_SQL = ENV_SQL + [fx.SQL_AS_OF, fx.SQL_PAGES, fx.SQL_REPLY_FEED, f"""
hplace AS (SELECT page_id, {PLACE.replace("c *", "conv_id *")} AS place FROM pages)""", f"""
rplace AS (SELECT DISTINCT c, {PLACE} AS place FROM replyfeed)""", f"""
arrivals AS (
  SELECT {_parts('envelopes', 'arrival')} AS part, observed_secs AS received_secs, arrival, NULL AS page_id, CAST(NULL AS DECIMAL(20,6)) AS ts_num,
         NULL AS item_no, event_id, workspace_id, {_sfield('ev', '$.channel')} AS channel_id, {_sfield('ev', '$.ts')} AS message_ts,
         {_sfield('ev', '$.thread_ts')} AS thread_ts, {_sfield('ev', '$.user')} AS user_id, {_sfield('ev', '$.text')} AS text, callback_type
  FROM raw WHERE {_sfield('ev', '$.type')} = 'message' AND {_sfield('ev', '$.channel')} IS NOT NULL AND {_sfield('ev', '$.ts')} IS NOT NULL
  UNION ALL
  SELECT {_parts('hplace', 'place')}, fetched_secs, NULL, page_id, TRY_CAST(message_ts AS DECIMAL(20,6)), item_no,
         'history:' || workspace_id || ':' || channel_id || ':' || message_ts, workspace_id, channel_id, message_ts, thread_ts,
         {_sfield('m', '$.user')}, {_sfield('m', '$.text')}, 'history_backfill'
  FROM hitems JOIN hplace USING (page_id)
  UNION ALL
  SELECT {_parts('rplace', 'place')}, (SELECT as_of_secs FROM params) + 7200, NULL, 'r' || CAST(c AS VARCHAR),
         TRY_CAST(message_ts AS DECIMAL(20,6)), NULL, event_id, workspace_id, channel_id, message_ts, thread_ts, user_id, text, 'thread_backfill'
  FROM replyfeed JOIN rplace USING (c))""", """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY part, received_secs NULLS FIRST, arrival NULLS FIRST, page_id NULLS FIRST, ts_num NULLS FIRST,
                                        item_no NULLS FIRST, event_id) AS place FROM arrivals)""", """
by_event AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) = 1)""", """
stored AS (
  SELECT *, row_number() OVER (ORDER BY place) AS event_sequence
  FROM (SELECT * FROM by_event QUALIFY row_number() OVER (PARTITION BY workspace_id, channel_id, message_ts ORDER BY place) = 1) x)"""]


def _stored(spark, sf_dir) -> str:
    """Live envelopes, history pages and reply pages of A through one store, four files each; returns the root of its tables."""
    conv = fx.table(spark, sf_dir, "conversations")
    as_of = fx.conversation_as_of(conv)
    root = scratch_path(spark, "stream", "store")
    _land(fx.conversation_envelopes(conv), "arrival", 4, f"{root}/live")
    place = F.expr(PLACE)
    _land(fx.history_pages(conv, as_of).withColumnRenamed("conv_id", "c").withColumn("place", place), "place", 4, f"{root}/history")
    _land(fx.reply_pages(conv, as_of).withColumn("c", F.expr("cast(substring(page_id, 2) AS bigint)")).withColumn("place", place),
          "place", 4, f"{root}/replies")
    rows = feeds.all_rows(ingest.envelope_stream(spark, f"{root}/live", 1, "parquet"), ingest.page_stream(spark, f"{root}/history", 1, "parquet"),
                          ingest.page_stream(spark, f"{root}/replies", 1, "parquet"))
    ingest.start_store(rows, f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    return f"{root}/tables"


@register("stream_backfill", osql.with_ctes(STORE_SQL, """
SELECT event_id, CAST(event_sequence AS BIGINT) AS event_sequence, workspace_id, channel_id, message_ts, thread_ts, user_id, text FROM stored"""))
def q_stream_backfill(spark, sf_dir):
    """Live, history and reply feeds interleaved in one store, one identity check and one sequence."""
    return ingest.read_messages(spark, _stored(spark, sf_dir)).select(
        "event_id", "event_sequence", "workspace_id", "channel_id", "message_ts", "thread_ts", "user_id", "text")


PURGE_SQL = STORE_SQL + ["""
kept AS (
  SELECT s.* FROM stored s, (SELECT 1700000000 + (max(conv_id) // 11) * 120 + 1000 AS cutoff FROM conversations) p
  WHERE TRY_CAST(s.message_ts AS DECIMAL(20,6)) >= cutoff OR EXISTS (
    SELECT 1 FROM stored r WHERE r.workspace_id = s.workspace_id AND r.channel_id = s.channel_id AND r.thread_ts = s.message_ts
      AND TRY_CAST(r.message_ts AS DECIMAL(20,6)) >= cutoff))""", """
events AS (
  SELECT event_id, received_secs FROM by_event
  UNION ALL SELECT event_id, observed_secs FROM raw WHERE event_id NOT IN (SELECT event_id FROM by_event))"""]


@register("purge_store", osql.with_ctes(PURGE_SQL, """
SELECT 'message' AS kind, event_id AS id, CAST(event_sequence AS BIGINT) AS event_sequence FROM kept
UNION ALL SELECT 'raw', event_id, NULL FROM events WHERE received_secs >= (SELECT 1700000000 + (max(conv_id) // 11) * 120 + 1000 FROM conversations)
UNION ALL SELECT 'ack', event_id, NULL FROM kept WHERE event_sequence % 3 = 0
UNION ALL SELECT DISTINCT 'thread', h.workspace_id || ':' || h.channel_id || ':' || h.message_ts, NULL FROM hitems h
  WHERE h.thread_ts IS NULL AND EXISTS (SELECT 1 FROM kept k WHERE k.workspace_id = h.workspace_id AND k.channel_id = h.channel_id
    AND k.message_ts = h.message_ts)"""))
def q_purge_store(spark, sf_dir):
    """R1-R4 on the stored tables: what is left of messages, raw events, acknowledgements and thread index after a purge."""
    import datetime as dt
    root = _stored(spark, sf_dir)
    msgs = ingest.read_messages(spark, root).where("event_sequence % 3 = 0")
    purge.append_acks(spark, root, msgs.select(F.lit("alpha").alias("consumer_id"), "event_id", F.col("observed_at").alias("acknowledged_at")), 0)
    hi = fx.table(spark, sf_dir, "conversations").agg(F.max(F.expr("conv_id div 11")).alias("m")).first()["m"]
    as_of = dt.datetime.fromtimestamp(fx.BASE_SECS + hi * 120 + 1000 + 86400, tz=dt.timezone.utc)
    purge.purge_store(spark, root, as_of, raw_days=1, message_days=1)
    none = F.lit(None).cast("bigint").alias("event_sequence")
    parts = [ingest.read_messages(spark, root).select(F.lit("message").alias("kind"), F.col("event_id").alias("id"), "event_sequence"),
             ingest._table(spark, root, "raw").select(F.lit("raw").alias("kind"), F.col("event_id").alias("id"), none),
             purge.read_acks(spark, root).select(F.lit("ack").alias("kind"), F.col("event_id").alias("id"), none),
             ingest.read_thread_index(spark, root).select(F.lit("thread").alias("kind"), F.concat_ws(":", *thread_index.KEY).alias("id"), none)]
    return dedupe.union_feeds(*parts)


STORE_THREADS = STORE_SQL + ["""
rfetches AS (
  SELECT workspace_id, channel_id, message_ts AS root_ts, (SELECT as_of_secs FROM params) + 7200 AS fetched_secs
  FROM messages WHERE t = 0 AND c % 4 <> 0 AND c % 5 = 2)""", OBS_SQL.replace("FROM fetches f", "FROM rfetches f")]


@register("stream_threads", osql.with_ctes(STORE_THREADS, """
SELECT workspace_id, channel_id, root_ts, CAST(observed_reply_count AS BIGINT) AS observed_reply_count,
       CAST(fetched_reply_count AS BIGINT) AS fetched_reply_count, latest_reply_ts, indexed_secs, fetched_secs,
       observed_reply_count > fetched_reply_count AS stale FROM tindex"""))
def q_stream_threads(spark, sf_dir):
    """D8, D9, B1 over the store: the thread index merged batch by batch from history and reply pages, and its stale threads."""
    idx = ingest.read_thread_index(spark, _stored(spark, sf_dir))
    return idx.select(*thread_index.KEY, "observed_reply_count", "fetched_reply_count", "latest_reply_ts",
                      F.unix_seconds("indexed_at").alias("indexed_secs"), F.unix_seconds("fetched_at").alias("fetched_secs"),
                      (F.col("observed_reply_count") > F.col("fetched_reply_count")).alias("stale"))


@register("stream_gaps", osql.with_ctes([fx.SQL_LIFECYCLE], "SELECT source, start_us, end_us FROM gaps"))
def q_stream_gaps(spark, sf_dir):
    """The lifecycle log in four files in order of time, downtime state kept per source."""
    root = scratch_path(spark, "stream", "gaps")
    log = fx.lifecycle_log(fx.table(spark, sf_dir, "events"))
    _land(log, "seq", 4, f"{root}/landing")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    q = (ingest.stream_gaps(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(ingest.GAPS).parquet(f"{root}/out").distinct()


@register("digest_json", osql.with_ctes(INBOX + GROUPING + osql.batch_ctes(16000) + [fx.SQL_TARGETS, fx.SQL_METADATA], """
SELECT d.scope AS consumer_id, CAST(g.group_position AS BIGINT) AS group_position, d.group_id AS id, w.workspace_name, c.channel_name, g.kind,
       CAST(g.estimated_tokens AS BIGINT) AS estimated_tokens, g.thread_continues,
       CAST(row_number() OVER (PARTITION BY d.scope, d.group_id ORDER BY d.position) AS BIGINT) AS position, d.event_id, d.message_ts, d.user_id, d.subtype, d.text
FROM delivered d JOIN dgroups g ON g.scope = d.scope AND g.group_id = d.group_id
LEFT JOIN wsmeta w ON w.workspace_id = g.workspace_id LEFT JOIN chmeta c ON c.workspace_id = g.workspace_id AND c.channel_id = g.channel_id"""))
def q_digest_json(spark, sf_dir):
    """The delivered groups written as JSON with names, and read back."""
    _, _, _, ws, ch = _targets_meta(spark, sf_dir)
    _, _, batch = inbox_run(spark, sf_dir, 16000)
    path = scratch_path(spark, "digest", "json")
    digest.write_digest(batch, ws, ch, path)
    group = ("id string, kind string, workspaceId string, workspaceName string, channelId string, channelName string, threadTs string, "
             f"threadContinues boolean, estimatedTokens bigint, messages array<struct<{digest.MESSAGE_JSON.replace(' ', ':').replace(',:', ',')}>>")
    rows = spark.read.schema(f"consumer_id string, group_position bigint, group struct<{', '.join(x.replace(' ', ':', 1) for x in group.split(', '))}>").json(path)
    m = rows.select("consumer_id", "group_position", "group", F.posexplode("group.messages").alias("p", "m"))
    return m.select("consumer_id", "group_position", "group.id", F.col("group.workspaceName").alias("workspace_name"),
                    F.col("group.channelName").alias("channel_name"), "group.kind", F.col("group.estimatedTokens").alias("estimated_tokens"),
                    F.col("group.threadContinues").alias("thread_continues"), (F.col("p") + 1).cast("bigint").alias("position"),
                    F.col("m.eventId").alias("event_id"), F.col("m.messageTs").alias("message_ts"), F.col("m.userId").alias("user_id"),
                    "m.subtype", "m.text")


# ---------------------------------------------------------------- G12 thread digest

THREAD_BUDGET = 4000


THREAD_CTES = [fx.SQL_MESSAGES, fx.SQL_AS_OF, THREAD_KEYS_SQL, THREAD_READ_SQL, f"""
sel AS (
  SELECT t.workspace_id || '|' || t.channel_id || '|' || t.key_ts AS scope, TRUE AS eligible, m.event_id, m.event_sequence,
         m.workspace_id, m.channel_id, m.message_ts, m.thread_ts, m.user_id, m.subtype, m.text,
         {osql.secs('m.')} AS secs, {osql.cost('m.')} AS cost
  FROM tread t JOIN messages m USING (event_id))"""] + osql.grouping_ctes(300, "message_ts") + osql.batch_ctes(THREAD_BUDGET)
THREAD_SCOPE_SQL = "split_part(scope, '|', 1) AS scope_ws, split_part(scope, '|', 2) AS scope_ch, split_part(scope, '|', 3) AS key_ts"


def _thread_batch(spark, sf_dir, unknown: bool = False) -> digest.Batch:
    """The digest of every thread of A; ``unknown`` asks for one more, of which there is no message."""
    _, msgs, _, as_of = conv_inputs(spark, sf_dir)
    keys = msgs.where(F.col("thread_ts").isNotNull()).select("workspace_id", "channel_id", "thread_ts").distinct()
    if unknown:
        keys = keys.unionByName(keys.groupBy().agg(F.min("workspace_id").alias("workspace_id")).select("workspace_id", F.lit("none").alias("channel_id"),
                                                                                                       F.lit("0.0").alias("thread_ts")))
    return digest.thread_digest(msgs, keys, as_of, THREAD_BUDGET)[1]


@register("thread_digest", osql.with_ctes(THREAD_CTES, f"""
SELECT {THREAD_SCOPE_SQL},
       group_id, kind, CAST(group_position AS BIGINT) AS group_position, CAST(estimated_tokens AS BIGINT) AS estimated_tokens,
       n_messages, thread_continues FROM dgroups"""))
def q_thread_digest(spark, sf_dir):
    return _thread_batch(spark, sf_dir).groups.select("scope_ws", "scope_ch", "key_ts", "group_id", "kind", F.col("group_position").cast("bigint"),
                                                      "estimated_tokens", "n_messages", "thread_continues")


@register("thread_summary", osql.with_ctes(THREAD_CTES + ["""
asked AS (
  SELECT DISTINCT workspace_id AS scope_ws, channel_id AS scope_ch, thread_ts AS key_ts FROM messages WHERE thread_ts IS NOT NULL
  UNION ALL SELECT min(workspace_id), 'none', '0.0' FROM messages),
given AS (SELECT scope, sum(estimated_tokens) AS estimated_tokens, count(*) AS n_delivered FROM dgroups GROUP BY scope),
known AS (SELECT scope, count(DISTINCT group_id) AS n_groups FROM ordered GROUP BY scope),
taken AS (SELECT scope, count(*) AS n FROM selected GROUP BY scope)"""], """
SELECT a.scope_ws, a.scope_ch, a.key_ts, CAST(coalesce(g.estimated_tokens, 0) AS BIGINT) AS estimated_tokens,
       coalesce(t.n, 0) < coalesce(k.n_groups, 0) AS has_more, coalesce(g.n_delivered, 0) AS n_delivered,
       (SELECT max(event_sequence) FROM messages) AS upper_sequence
FROM asked a LEFT JOIN given g ON g.scope = concat_ws('|', a.scope_ws, a.scope_ch, a.key_ts)
LEFT JOIN known k ON k.scope = concat_ws('|', a.scope_ws, a.scope_ch, a.key_ts)
LEFT JOIN taken t ON t.scope = concat_ws('|', a.scope_ws, a.scope_ch, a.key_ts)"""))
def q_thread_summary(spark, sf_dir):
    """G9 of thread reads: totals, whether more is left, and the upper sequence; a thread without messages has a row too."""
    return _thread_batch(spark, sf_dir, unknown=True).summary.select("scope_ws", "scope_ch", "key_ts", "estimated_tokens", "has_more", "n_delivered", "upper_sequence")


@register("thread_receipts", osql.with_ctes(THREAD_CTES, f"""
SELECT {THREAD_SCOPE_SQL}, group_id, string_agg(event_id, ',' ORDER BY position) AS event_ids
FROM (SELECT m.scope, m.group_id, m.event_id, m.position, bool_or(m.text_continues IS NOT NULL) OVER w AS cut, g.thread_continues
      FROM delivered m JOIN dgroups g ON g.scope = m.scope AND g.group_id = m.group_id WINDOW w AS (PARTITION BY m.scope, m.group_id)) x
WHERE NOT cut AND NOT thread_continues GROUP BY scope, group_id"""))
def q_thread_receipts(spark, sf_dir):
    """I10 of thread reads: the ids that each wholly delivered group acknowledges, in order of delivery."""
    b = _thread_batch(spark, sf_dir)
    rows = b.messages.join(b.groups.select(*digest.THREAD_SCOPE, "group_id", "thread_continues"), [*digest.THREAD_SCOPE, "group_id"])
    return inbox.receipts(rows, digest.THREAD_SCOPE).select(*digest.THREAD_SCOPE, "group_id", F.array_join("event_ids", ",").alias("event_ids"))


# ---------------------------------------------------------------- B2, B4, B5, B6, N18

import datetime as _dt  # noqa: E402

from threadloom.operators import backfill  # noqa: E402


def _jobs(as_of):
    """Jobs 1 and 2 in progress (2 canceled), 3 refused (start after end), 4 canceled when it was complete
    already, 5 canceled while its tasks ran, which then completed."""
    d = _dt.timedelta
    return [(1, "initial", as_of - d(days=30), as_of), (2, "manual", as_of - d(days=2), as_of - d(days=1)),
            (3, "downtime", as_of, as_of - d(hours=1)), (4, "manual", as_of - d(days=4), as_of - d(days=2, microseconds=-250000)),
            (5, "downtime", as_of - d(days=5), as_of - d(days=3))]


JOBS_SQL = """
jobs AS (SELECT * FROM (VALUES (1, 'initial', -30 * 86400, 0, 0), (2, 'manual', -2 * 86400, -86400, 0),
                               (4, 'manual', -4 * 86400, -2 * 86400, 250000), (5, 'downtime', -5 * 86400, -3 * 86400, 0)) v(job_id, kind, start_dt, end_dt, end_us)),
jobx AS (SELECT j.*, (p.as_of_secs + start_dt) * 1000000 AS start_at, (p.as_of_secs + end_dt) * 1000000 + end_us AS end_at FROM jobs j CROSS JOIN params p),
plan AS (
  SELECT j.job_id, t.workspace_id, t.channel_id, 'history' AS phase, j.end_at - CAST(30 AS BIGINT) * 86400 * 1000000 AS oldest_us, j.end_at AS latest_us,
         j.kind, row_number() OVER (PARTITION BY j.job_id ORDER BY t.workspace_id, t.channel_id) AS task_no
  FROM targets t CROSS JOIN jobx j WHERE t.enabled),
tlog AS (SELECT job_id * 1000 + task_no AS task_id, job_id, latest_us // 1000000 AS t0, TRY_CAST(substr(channel_id, 2) AS INTEGER) AS n FROM plan),
events AS (
  SELECT task_id, t0 AS at_s, 0 AS seq, 'created' AS kind, NULL AS cursor, NULL AS error, NULL AS nb FROM tlog
  UNION ALL SELECT task_id, t0 + 10, 1, 'claimed', NULL, NULL, NULL FROM tlog WHERE n % 2 = 0 OR job_id > 3
  UNION ALL SELECT task_id, t0 + 20, 2, 'page', CASE WHEN n % 4 = 0 AND job_id < 3 THEN 'next' END, NULL, NULL FROM tlog WHERE (n % 2 = 0 AND job_id < 3) OR job_id = 4
  UNION ALL SELECT task_id, t0 + 30, 3, 'error', NULL, 'HTTP 500', t0 + 90 FROM tlog WHERE n % 6 = 0 AND job_id < 3
  UNION ALL SELECT task_id, t0 + 100, 4, 'cancel', NULL, NULL, NULL FROM tlog WHERE job_id IN (2, 4, 5)
  UNION ALL SELECT task_id, t0 + 200, 5, 'page', NULL, NULL, NULL FROM tlog WHERE job_id = 5),
lastev AS (
  SELECT task_id, arg_max(CASE kind WHEN 'created' THEN 'queued' WHEN 'claimed' THEN 'running' WHEN 'error' THEN 'retry'
                               ELSE CASE WHEN cursor IS NOT NULL THEN 'queued' ELSE 'completed' END END, seq) FILTER (kind <> 'cancel') AS last_state,
         max(seq) FILTER (kind <> 'cancel') AS last_seq, max(seq) FILTER (kind = 'cancel') AS cancel_seq
  FROM events GROUP BY task_id),
tstate AS (
  SELECT e.task_id, CASE WHEN l.cancel_seq > l.last_seq AND l.last_state IN ('queued', 'retry') THEN 'canceled' ELSE l.last_state END AS state,
         CAST(count(*) FILTER (e.kind = 'claimed') AS BIGINT) AS attempts, arg_max_null(e.cursor, e.seq) FILTER (e.kind = 'page') AS cursor,
         CASE WHEN max(e.seq) FILTER (e.kind = 'error') > COALESCE(max(e.seq) FILTER (e.kind = 'page'), -1)
              THEN arg_max(e.error, e.seq) FILTER (e.kind = 'error') END AS last_error,
         arg_max(e.nb, e.seq) FILTER (e.kind = 'error') AS nb, max(e.at_s) FILTER (e.kind = 'page' AND e.cursor IS NULL) AS done_s,
         max(e.error) AS any_error
  FROM events e JOIN lastev l USING (task_id) GROUP BY e.task_id, l.cancel_seq, l.last_seq, l.last_state),
pjob AS (
  SELECT p.job_id, count(*) AS total_tasks, count(*) FILTER (s.state NOT IN ('completed', 'canceled')) AS open_n,
         count(*) FILTER (s.state = 'canceled') AS canceled_n, count(*) FILTER (s.state = 'completed') AS completed_tasks, max(s.attempts) AS att,
         max(s.done_s) FILTER (s.state = 'completed') AS done_s, count(DISTINCT (p.workspace_id, p.channel_id)) AS channels,
         count(*) FILTER (p.phase = 'history') AS history_tasks, count(*) FILTER (p.phase = 'replies') AS reply_tasks, max(s.any_error) AS last_error
  FROM plan p JOIN tstate s ON s.task_id = p.job_id * 1000 + p.task_no GROUP BY p.job_id),
jstate AS (
  SELECT j.job_id, j.kind, j.start_at, j.end_at, x.*,
         CASE WHEN COALESCE(x.open_n, 0) = 0 AND (c.cancel_s IS NULL OR COALESCE(x.canceled_n, 0) = 0 OR COALESCE(x.done_s > c.cancel_s, FALSE)) THEN 'completed'
              WHEN c.cancel_s IS NOT NULL THEN 'canceled' WHEN COALESCE(x.att, 0) > 0 THEN 'running' ELSE 'queued' END AS state
  FROM jobx j LEFT JOIN pjob x ON x.job_id = j.job_id
  LEFT JOIN (SELECT job_id, end_at // 1000000 + 100 AS cancel_s FROM jobx WHERE job_id IN (2, 4, 5)) c ON c.job_id = j.job_id)"""


def _plan(spark, sf_dir):
    msgs, as_of, targets, _, _ = _targets_meta(spark, sf_dir)
    tasks = backfill.plan_history(targets, _jobs(as_of), 30)
    return as_of, tasks.withColumn("task_id", F.col("job_id") * 1000 + F.col("task_no"))


def _task_log(tasks):
    n = F.expr("try_cast(substr(channel_id, 2) AS INT)")
    base = tasks.select("task_id", "job_id", F.unix_seconds("latest").alias("t0"), n.alias("n"))
    early, job = F.col("job_id") < 3, F.col("job_id")

    def ev(where, dt, seq, kind, cursor=None, error=None, nb=None):
        return base.where(where).select(
            "task_id", F.timestamp_seconds(F.col("t0") + dt).alias("at"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"),
            (cursor if cursor is not None else F.lit(None).cast("string")).alias("cursor"), F.lit(error).cast("string").alias("error"),
            (F.timestamp_seconds(F.col("t0") + nb) if nb is not None else F.lit(None).cast("timestamp")).alias("not_before"))

    even = F.col("n") % 2 == 0
    return (ev(F.lit(True), 0, 0, "created").unionByName(ev(even | ~early, 10, 1, "claimed"))
            .unionByName(ev((even & early) | (job == 4), 20, 2, "page", F.when((F.col("n") % 4 == 0) & early, F.lit("next"))))
            .unionByName(ev((F.col("n") % 6 == 0) & early, 30, 3, "error", error="HTTP 500", nb=90))
            .unionByName(ev(job.isin(2, 4, 5), 100, 4, "cancel")).unionByName(ev(job == 5, 200, 5, "page")))


@register("plan_history", osql.with_ctes(TM + [JOBS_SQL], """
SELECT p.job_id, p.workspace_id, p.channel_id, p.phase, p.oldest_us, p.latest_us, CAST(p.task_no AS BIGINT) AS task_no, p.kind, j.start_at AS start_us
FROM plan p JOIN jobx j USING (job_id)"""))
def q_plan_history(spark, sf_dir):
    _, tasks = _plan(spark, sf_dir)
    return tasks.select(F.col("job_id").cast("int").alias("job_id"), "workspace_id", "channel_id", "phase",
                        F.unix_micros("oldest").alias("oldest_us"), F.unix_micros("latest").alias("latest_us"), "task_no", "kind",
                        F.unix_micros("start_at").alias("start_us"))


@register("plan_replies", osql.with_ctes(PAGE_SQL + [OBS_SQL] + TM[2:] + [JOBS_SQL], """
SELECT DISTINCT o.job_id, o.workspace_id, o.channel_id, o.root_ts, 'replies' AS phase, p.oldest_us, p.latest_us FROM obs o
LEFT JOIN plan p ON p.job_id = o.job_id AND p.workspace_id = o.workspace_id AND p.channel_id = o.channel_id
WHERE o.reply_count > COALESCE((SELECT arg_max(f.fetched_reply_count, f.fetched_secs) FROM fcount f
                                 WHERE f.workspace_id = o.workspace_id AND f.channel_id = o.channel_id
                                   AND f.root_ts = o.root_ts AND f.fetched_secs <= o.indexed_at), 0)"""))
def q_plan_replies(spark, sf_dir):
    _, _, _, _, obs, fetches = _index(spark, sf_dir)
    _, tasks = _plan(spark, sf_dir)
    return thread_index.plan_replies(obs, fetches, tasks).select(
        "job_id", "workspace_id", "channel_id", "root_ts", "phase", F.unix_micros("oldest").alias("oldest_us"), F.unix_micros("latest").alias("latest_us"))


@register("task_state", osql.with_ctes(TM + [JOBS_SQL], """
SELECT task_id, state, attempts, cursor, last_error, CASE WHEN state = 'retry' THEN nb END AS not_before_secs,
       CASE WHEN state = 'completed' THEN done_s END AS completed_secs FROM tstate"""))
def q_task_state(spark, sf_dir):
    _, tasks = _plan(spark, sf_dir)
    st = backfill.task_state(_task_log(tasks))
    return st.select(F.col("task_id").cast("int").alias("task_id"), "state", "attempts", "cursor", "last_error",
                     F.unix_seconds("not_before").alias("not_before_secs"), F.unix_seconds("completed_at").alias("completed_secs"))


def _job_frames(spark, sf_dir):
    as_of, tasks = _plan(spark, sf_dir)
    states = backfill.task_state(_task_log(tasks))
    good, _ = backfill.valid_jobs(_jobs(as_of))
    jobs = spark.createDataFrame(good, backfill.JOBS).withColumn("created_at", F.col("end_at"))
    cancels = jobs.where("job_id IN (2, 4, 5)").select("job_id", F.timestamp_seconds(F.unix_seconds("end_at") + 100).alias("at"))
    return jobs, tasks, states, cancels


@register("job_state", osql.with_ctes(TM + [JOBS_SQL], "SELECT CAST(job_id AS BIGINT) AS job_id, state FROM jstate"))
def q_job_state(spark, sf_dir):
    return backfill.job_state(*_job_frames(spark, sf_dir))


@register("job_report", osql.with_ctes(TM + [JOBS_SQL], """
SELECT CAST(job_id AS BIGINT) AS job_id, kind, state, start_at AS start_us, end_at AS end_us, last_error,
       CASE WHEN state = 'completed' THEN COALESCE(done_s, end_at // 1000000) END AS completed_secs,
       COALESCE(channels, 0) AS channels, COALESCE(completed_tasks, 0) AS completed_tasks, COALESCE(total_tasks, 0) AS total_tasks,
       COALESCE(history_tasks, 0) AS history_tasks, COALESCE(reply_tasks, 0) AS reply_tasks
FROM jstate ORDER BY job_id DESC LIMIT 20"""))
def q_job_report(spark, sf_dir):
    return backfill.job_report(*_job_frames(spark, sf_dir)).select(
        "job_id", "kind", "state", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "last_error",
        F.unix_seconds("completed_at").alias("completed_secs"), "channels", "completed_tasks", "total_tasks", "history_tasks", "reply_tasks")


@register("window_validation", osql.with_ctes([fx.SQL_LIFECYCLE], """
SELECT source, start_us, end_us, CASE WHEN source % 7 = 0 THEN 'unreadable start' WHEN source % 7 = 1 THEN 'unreadable end'
                                      WHEN source % 7 = 2 THEN 'start not before end' ELSE 'accepted' END AS outcome FROM gaps"""))
def q_window_validation(spark, sf_dir):
    """Downtime windows sent as text requests; some sources send an unreadable or a reversed window."""
    _, gaps = _gaps(spark, sf_dir)
    a = F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    z = F.date_format(F.timestamp_micros("end_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    k = F.col("source") % 7
    asked = gaps.select("source", "start_us", "end_us", F.when(k == 0, "yesterday noon").when(k == 2, z).otherwise(a).alias("start_text"),
                        F.when(k == 1, "2024-13-45").when(k == 2, a).otherwise(z).alias("end_text"))
    good, bad = backfill.validate_window(asked)
    return (good.select("source", "start_us", "end_us", F.lit("accepted").alias("outcome"))
            .unionByName(bad.select("source", "start_us", "end_us", F.col("reason").alias("outcome"))))
