"""SQL oracles (DuckDB dialect) for the query registry.

These restate the semantics in the most literal relational form (a sorted index per
scope, lag-based channel windows, running sums), independent of the Spark plans.
"""

from __future__ import annotations

from threadloom.plans import fixtures as fx

COST_SQL = ("CAST(greatest(24, strlen(to_json(struct_pack(eventId := {p}event_id, messageTs := {p}message_ts, "
            "userId := {p}user_id, subtype := {p}subtype, text := {p}text)))) AS BIGINT)")
SECS_SQL = "COALESCE(TRY_CAST(split_part({p}message_ts, '.', 1) AS BIGINT), 0)"


def cost(prefix: str = "") -> str:
    return COST_SQL.format(p=prefix)


def secs(prefix: str = "") -> str:
    return SECS_SQL.format(p=prefix)


def inbox_ctes(settle: int = fx.SETTLE_SECS) -> list[str]:
    """messages, acks, params, pending, hydrated selection (sel) for consumers alpha and beta."""
    return [
        fx.SQL_MESSAGES, fx.SQL_ACKS, fx.SQL_AS_OF,
        "consumers AS (SELECT * FROM (VALUES ('alpha'), ('beta')) v(consumer_id))",
        f"""pending AS (
  SELECT c.consumer_id, m.* FROM messages m CROSS JOIN consumers c CROSS JOIN params p
  WHERE m.event_sequence <= p.upper_seq AND m.observed_secs <= p.as_of_secs - {settle}
    AND NOT EXISTS (SELECT 1 FROM acks a WHERE a.consumer_id = c.consumer_id AND a.event_id = m.event_id))""",
        """tkeys AS (SELECT DISTINCT consumer_id, workspace_id, channel_id, thread_ts FROM pending WHERE thread_ts IS NOT NULL)""",
        """hydrated AS (
  SELECT consumer_id, event_id, bool_or(eligible) AS eligible FROM (
    SELECT consumer_id, event_id, TRUE AS eligible FROM pending
    UNION ALL
    SELECT k.consumer_id, m.event_id, FALSE FROM tkeys k JOIN messages m
      ON m.workspace_id = k.workspace_id AND m.channel_id = k.channel_id
     AND (m.thread_ts = k.thread_ts OR m.message_ts = k.thread_ts)
  ) x GROUP BY consumer_id, event_id)""",
        f"""sel AS (
  SELECT h.consumer_id AS scope, h.eligible, m.event_id, m.event_sequence, m.workspace_id, m.channel_id,
         m.message_ts, m.thread_ts, m.user_id, m.subtype, m.text, {secs('m.')} AS secs, {cost('m.')} AS cost
  FROM hydrated h JOIN messages m USING (event_id))""",
    ]


def grouping_ctes(gap: int = 300, tie: str = "event_sequence") -> list[str]:
    """From ``sel`` (scope, event fields, secs, cost): sorted, members, groups, ordered.

    The sorted index reproduces a stable sort by second over input ordered by ``tie``.
    """
    return [
        """named AS (SELECT DISTINCT scope, workspace_id, channel_id, thread_ts AS ts FROM sel WHERE thread_ts IS NOT NULL)""",
        f"""sorted AS (
  SELECT s.*, COALESCE(s.thread_ts, CASE WHEN r.ts IS NOT NULL THEN s.message_ts END) AS thread_key,
         row_number() OVER (PARTITION BY s.scope ORDER BY s.secs, s.{tie}) AS idx
  FROM sel s LEFT JOIN named r
    ON r.scope = s.scope AND r.workspace_id = s.workspace_id AND r.channel_id = s.channel_id AND r.ts = s.message_ts)""",
        """thr AS (
  SELECT *, message_ts = thread_key AS is_root,
         row_number() OVER (PARTITION BY scope, workspace_id, channel_id, thread_key
                            ORDER BY CASE WHEN message_ts = thread_key THEN 0 ELSE 1 END, idx) AS member_position
  FROM sorted WHERE thread_key IS NOT NULL)""",
        f"""std AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END)
              OVER (PARTITION BY scope, workspace_id, channel_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS window_no,
            min(idx) OVER (PARTITION BY scope, workspace_id, channel_id) AS chan_ins
  FROM (SELECT *, secs - lag(secs) OVER (PARTITION BY scope, workspace_id, channel_id ORDER BY idx) AS gap
        FROM sorted WHERE thread_key IS NULL) g)""",
        """stdw AS (
  SELECT *, workspace_id || ':' || channel_id || ':'
            || CAST(first_value(event_sequence) OVER (PARTITION BY scope, workspace_id, channel_id, window_no ORDER BY idx) AS VARCHAR) AS group_id,
         row_number() OVER (PARTITION BY scope, workspace_id, channel_id, window_no ORDER BY idx) AS member_position
  FROM std)""",
        """members AS (
  SELECT scope, workspace_id || ':' || channel_id || ':' || thread_key AS group_id, member_position, event_id,
         event_sequence, message_ts, user_id, subtype, text, cost, eligible FROM thr
  UNION ALL
  SELECT scope, group_id, member_position, event_id, event_sequence, message_ts, user_id, subtype, text, cost, eligible FROM stdw)""",
        """groups AS (
  SELECT scope, workspace_id || ':' || channel_id || ':' || thread_key AS group_id, 'thread' AS kind,
         workspace_id, channel_id, thread_key AS thread_ts,
         max(CASE WHEN member_position = 1 THEN secs END) AS first_secs, 0 AS kind_rank, min(idx) AS ins,
         CAST(0 AS BIGINT) AS window_no, CAST(sum(cost) AS BIGINT) AS cost, CAST(count(*) AS BIGINT) AS n_messages
  FROM thr GROUP BY scope, workspace_id, channel_id, thread_key
  UNION ALL
  SELECT scope, max(group_id), 'channel_window', workspace_id, channel_id, CAST(NULL AS VARCHAR),
         max(CASE WHEN member_position = 1 THEN secs END), 1, min(chan_ins), CAST(window_no AS BIGINT),
         CAST(sum(cost) AS BIGINT), CAST(count(*) AS BIGINT)
  FROM stdw GROUP BY scope, workspace_id, channel_id, window_no)""",
        """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY first_secs, kind_rank, ins, window_no) AS group_position
  FROM groups)""",
    ]


def batch_ctes(budget: int) -> list[str]:
    """From ``ordered`` and ``members``: running cost, whole-group batch, oversized-first-group prefix."""
    return [
        """run AS (SELECT *, sum(cost) OVER (PARTITION BY scope ORDER BY group_position ROWS UNBOUNDED PRECEDING) AS running_cost
  FROM ordered)""",
        f"""selected AS (SELECT * FROM run WHERE running_cost <= {budget})""",
        f"""oversized AS (SELECT * FROM run WHERE group_position = 1 AND cost > {budget})""",
        # segment of the first message: per code point escaped bytes, prefix sums, largest fitting end
        # (every code point costs a byte or more, so none beyond the budget can belong to the segment)
        f"""ochars AS (
  SELECT scope, group_id, event_id, unnest(generate_series(1, length(t))) AS pos, unnest(string_split(t, '')) AS ch
  FROM (SELECT m.scope, m.group_id, m.event_id, substring(COALESCE(m.text, ''), 1, {budget}) AS t
        FROM members m JOIN oversized o ON o.scope = m.scope AND o.group_id = m.group_id
        WHERE m.member_position = 1 AND length(COALESCE(m.text, '')) > 0) x)""",
        """obytes AS (
  SELECT scope, group_id, event_id, pos,
         sum(CASE WHEN ch IN ('"', '\\') OR ch IN (chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2
                  WHEN unicode(ch) < 32 THEN 6 ELSE strlen(ch) END) OVER (PARTITION BY scope, group_id ORDER BY pos) AS acc
  FROM ochars)""",
        f"""ofirst AS (
  SELECT m.scope, m.group_id, m.event_id,
         strlen(to_json(struct_pack(eventId := m.event_id, messageTs := m.message_ts, userId := m.user_id,
                                    subtype := m.subtype, text := ''))) AS base,
         COALESCE(m.text, '') AS t, length(COALESCE(m.text, '')) AS n
  FROM members m JOIN oversized o ON o.scope = m.scope AND o.group_id = m.group_id WHERE m.member_position = 1)""",
        f"""oseg AS (
  SELECT f.scope, f.group_id, f.event_id, f.t, f.n, f.base,
         CASE WHEN f.n = 0 THEN 0
              ELSE COALESCE((SELECT acc FROM obytes b WHERE b.scope = f.scope AND b.group_id = f.group_id AND b.pos = f.n), {budget} + 1) END AS full_bytes,
         COALESCE((SELECT max(b.pos) FROM obytes b WHERE b.scope = f.scope AND b.group_id = f.group_id
                    AND f.base + b.acc + 17 + length(CAST(b.pos AS VARCHAR)) <= {budget}), 0) AS fit_end
  FROM ofirst f)""",
        f"""ofirstmsg AS (
  SELECT scope, group_id, event_id,
         CASE WHEN greatest(24, base + full_bytes) <= {budget} OR n = 0 THEN t ELSE substring(t, 1, fit_end) END AS seg_text,
         CASE WHEN greatest(24, base + full_bytes) <= {budget} OR n = 0 THEN NULL ELSE fit_end END AS text_continues,
         CASE WHEN greatest(24, base + full_bytes) <= {budget} OR n = 0 THEN greatest(24, base + full_bytes)
              ELSE greatest(24, base + COALESCE((SELECT acc FROM obytes b WHERE b.scope = oseg.scope AND b.group_id = oseg.group_id AND b.pos = fit_end), 0)
                            + 17 + length(CAST(fit_end AS VARCHAR))) END AS seg_cost
  FROM oseg)""",
        f"""opart AS (
  SELECT m.scope, m.group_id, m.member_position AS position, m.event_id, m.event_sequence, m.message_ts, m.user_id, m.subtype,
         CASE WHEN m.member_position = 1 THEN f.seg_text ELSE m.text END AS text,
         CASE WHEN m.member_position = 1 THEN f.text_continues END AS text_continues,
         CASE WHEN m.member_position = 1 THEN f.seg_cost ELSE m.cost END AS cost, m.eligible
  FROM members m JOIN oversized o ON o.scope = m.scope AND o.group_id = m.group_id
  LEFT JOIN ofirstmsg f ON f.scope = m.scope AND f.group_id = m.group_id AND m.member_position = 1)""",
        f"""opartrun AS (
  SELECT *, sum(cost) OVER (PARTITION BY scope, group_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM opart)""",
        f"""partial AS (SELECT * FROM opartrun WHERE position = 1 OR run <= {budget})""",
        """delivered AS (
  SELECT m.scope, m.group_id, m.member_position AS position, m.event_id, m.event_sequence, m.message_ts, m.user_id,
         m.subtype, m.text, CAST(NULL AS BIGINT) AS text_continues, m.cost, m.eligible
  FROM members m JOIN selected s ON s.scope = m.scope AND s.group_id = m.group_id
  UNION ALL
  SELECT scope, group_id, position, event_id, event_sequence, message_ts, user_id, subtype, text,
         CAST(text_continues AS BIGINT), CAST(cost AS BIGINT), eligible FROM partial)""",
        """dgroups AS (
  SELECT scope, group_id, kind, workspace_id, channel_id, thread_ts, group_position, cost AS estimated_tokens,
         n_messages, FALSE AS thread_continues FROM selected
  UNION ALL
  SELECT o.scope, o.group_id, o.kind, o.workspace_id, o.channel_id, o.thread_ts, o.group_position,
         CAST(p.tokens AS BIGINT), o.n_messages, p.n < o.n_messages
  FROM oversized o JOIN (SELECT scope, group_id, sum(cost) AS tokens, count(*) AS n FROM partial GROUP BY scope, group_id) p
    ON p.scope = o.scope AND p.group_id = o.group_id)""",
    ]


def with_ctes(ctes: list[str], body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes) + "\n" + body


CHAR_BYTES_SQL = ("CASE WHEN ch IN ('\"', '\\') OR ch IN (chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 "
                  "WHEN unicode(ch) < 32 THEN 6 ELSE strlen(ch) END")


def segment_ctes(source: str, budget: int) -> list[str]:
    """First segment (offset 0) of every message of ``source`` (event_id, message_ts, user_id, subtype, text).

    Each step is materialised, so that its cost does not depend on how the planner would unfold it.
    """
    return [
        f"""sd AS MATERIALIZED (
  SELECT event_id, message_ts, user_id, subtype, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n,
         strlen(to_json(struct_pack(eventId := event_id, messageTs := message_ts, userId := user_id,
                                    subtype := subtype, text := ''))) AS base,
         greatest(24, strlen(to_json(struct_pack(eventId := event_id, messageTs := message_ts, userId := user_id,
                                    subtype := subtype, text := COALESCE(text, ''))))) AS full_cost
  FROM {source})""",
        f"""sch AS MATERIALIZED (
  SELECT event_id, unnest(generate_series(1, least(n, {budget}))) AS pos, unnest(string_split(substring(t, 1, {budget}), '')) AS ch
  FROM sd WHERE full_cost > {budget} AND n > 0)""",
        f"""sacc AS MATERIALIZED (SELECT event_id, pos, sum({CHAR_BYTES_SQL}) OVER (PARTITION BY event_id ORDER BY pos) AS acc FROM sch)""",
        f"""sfit AS MATERIALIZED (
  SELECT a.event_id, max(a.pos) AS fit_end FROM sacc a JOIN sd USING (event_id)
  WHERE sd.base + a.acc + 17 + length(CAST(a.pos AS VARCHAR)) <= {budget} GROUP BY a.event_id)""",
        f"""seg AS (
  SELECT sd.event_id, sd.n,
         CASE WHEN sd.full_cost <= {budget} OR sd.n = 0 THEN sd.n ELSE COALESCE(f.fit_end, 0) END AS seg_end,
         CASE WHEN sd.full_cost <= {budget} OR sd.n = 0 THEN NULL ELSE COALESCE(f.fit_end, 0) END AS text_continues,
         CAST(CASE WHEN sd.full_cost <= {budget} OR sd.n = 0 THEN sd.full_cost
              ELSE greatest(24, sd.base + COALESCE(a.acc, 0) + 17 + length(CAST(COALESCE(f.fit_end, 0) AS VARCHAR))) END AS BIGINT) AS seg_cost
  FROM sd LEFT JOIN sfit f USING (event_id) LEFT JOIN sacc a ON a.event_id = sd.event_id AND a.pos = f.fit_end)""",
    ]


def all_segment_ctes(source: str, budget: int) -> list[str]:
    """Every segment of every message of ``source`` over the budget; use with ``WITH RECURSIVE``."""
    return [
        f"""sd AS (
  SELECT event_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n,
         strlen(to_json(struct_pack(eventId := event_id, messageTs := message_ts, userId := user_id, subtype := subtype, text := ''))) AS base
  FROM {source}
  WHERE greatest(24, strlen(to_json(struct_pack(eventId := event_id, messageTs := message_ts, userId := user_id,
                                                subtype := subtype, text := COALESCE(text, ''))))) > {budget})""",
        """sch AS (SELECT event_id, unnest(generate_series(1, n)) AS pos, unnest(string_split(t, '')) AS ch FROM sd WHERE n > 0)""",
        f"""sacc AS (
  SELECT event_id, list(acc ORDER BY pos) AS accs
  FROM (SELECT event_id, pos, CAST(sum({CHAR_BYTES_SQL}) OVER (PARTITION BY event_id ORDER BY pos) AS BIGINT) AS acc FROM sch) x
  GROUP BY event_id)""",
        """sall AS (SELECT sd.event_id, sd.n, sd.base, a.accs FROM sd JOIN sacc a USING (event_id))""",
        f"""chain AS (
  SELECT event_id, CAST(0 AS BIGINT) AS seg_no, CAST(0 AS BIGINT) AS seg_start, CAST(0 AS BIGINT) AS seg_end, FALSE AS final FROM sall
  UNION ALL
  SELECT event_id, seg_no + 1, begins, CASE WHEN whole THEN n ELSE begins + size END, whole OR size = 0
  FROM (
    SELECT c.event_id, c.seg_no, c.seg_end AS begins, s.n,
           s.base + s.accs[s.n] - COALESCE(s.accs[c.seg_end], 0) <= {budget} AS whole,
           COALESCE(list_max(list_filter(range(1, least({budget}, s.n - c.seg_end) + 1),
             lambda k: s.base + s.accs[c.seg_end + k] - COALESCE(s.accs[c.seg_end], 0) + 17 + length(CAST(c.seg_end + k AS VARCHAR)) <= {budget})), 0) AS size
    FROM chain c JOIN sall s USING (event_id) WHERE NOT c.final) x)""",
        """allseg AS (
  SELECT c.event_id, c.seg_no, c.seg_start, c.seg_end,
         s.base + s.accs[s.n] - COALESCE(s.accs[c.seg_start], 0) AS rest, s.n, s.base,
         COALESCE(s.accs[c.seg_end], 0) - COALESCE(s.accs[c.seg_start], 0) AS bytes
  FROM chain c JOIN sall s USING (event_id) WHERE c.seg_no > 0)""",
        f"""aseg AS (
  SELECT event_id, seg_no, seg_start, seg_end, CASE WHEN rest > {budget} THEN seg_end END AS text_continues,
         CAST(greatest(24, CASE WHEN rest <= {budget} THEN rest ELSE base + bytes + 17 + length(CAST(seg_end AS VARCHAR)) END) AS BIGINT) AS seg_cost,
         rest > {budget} AND seg_end = seg_start AS stalled
  FROM allseg)""",
    ]
