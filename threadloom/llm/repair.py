"""Operator 11: conversation structure repair by depth-first branch and bound.

A conversation's rows are kept (cost 0), given role user or assistant (1) or deleted (2, required for a blank or
repeated row), and empty user or assistant turns are inserted (5), until the role initials read ``(s?(ua)+)?``. A
truncated row that is not deleted adds 5. Of the cheapest lists of edits the one whose initials (``audit``)
are least in ASCII order counts.

1. Equal rows of a turn are one run with a count before anything is sorted. Positions come from a distributed running
   total, so a conversation with a third of all rows is no single task.
2. A row that is not blank is a duplicate when its role and text have an earlier position: a least position for
   each (conversation, role, text), from partial aggregates.
3. Every BLOCK rows of a conversation are searched alone: nodes are (row, state of the role pattern), edits
   branch, an explicit stack goes depth first, cheapest bound first. A branch ends when its cost and the lower bound of its
   suffix (forced deletions, cheapest way with truncated rows, half an edit for each pair of neighbours that cannot stay)
   exceed the incumbent, or tie with it and its audit is greater, or the node's dominance table holds a prefix
   that is no worse. When the stack is empty the incumbent (cost, audit) is proved optimal.
4. Most conversations are one block. Others are searched from every state to every state, and neighbouring blocks
   are joined 32 at a time until one is left. That is exact: equal costs have the same number of
   rows, so no audit of one block is a proper prefix of another and the least parts make the least whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import finish, settle, stage, staged_so_far
from threadloom.operators.scan import running_total

BLOCK = 256  # rows that one search covers
FAN = 32  # neighbouring blocks joined in a round
START, SYSTEM, USER, DONE = range(4)  # states of the role pattern: nothing, after s, after u, after a
# states in which a row of this initial may follow, and the state after it
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}}
NEEDED = {START: ("u", USER), SYSTEM: ("u", USER), DONE: ("u", USER), USER: ("a", DONE)}  # what a given or inserted role must be
WHOLE = (START, DONE)  # states in which a conversation may end
NEVER = 1 << 40
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}


# ---------------------------------------------------------------- the search


def lower_bounds(rows: list[tuple[str, bool, bool]], ends: tuple[int, ...]) -> list[list[int]]:
    """For each row and state, a lower bound of the cost of all edits from there to one of the states ``ends``.

    The bound leaves out the order of audits: it is the least cost alone of the suffix, one backward pass over rows and states.
    """
    at = [0 if q in ends else NEVER for q in range(4)]
    out = [_with_insertions(at)]
    for letter, gone, cut in reversed(rows):
        after = out[-1]
        at = [2 + x for x in after]
        if not gone:
            more = 5 if cut else 0
            for q in range(4):
                at[q] = min(at[q], 1 + more + after[NEEDED[q][1]])
            for q, to in FOLLOWS.get(letter, {}).items():
                at[q] = min(at[q], more + after[to])
        out.append(_with_insertions(at))
    return out[::-1]


def _with_insertions(at: list[int]) -> list[int]:
    user, done = min(at[USER], 5 + at[DONE]), min(at[DONE], 5 + at[USER])
    return [min(at[START], 5 + user), min(at[SYSTEM], 5 + user), user, done]


def search(rows: list[tuple[str, bool, bool]], start: int, ends: tuple[int, ...]) -> tuple[int, str, str] | None:
    """Least (cost, audit), and the roles it gives, of rows (initial, must go, truncated) from a state to one of ``ends``.

    The roles string has, for each edit, the initial of the row that it leaves, ``-`` for a deleted one. None: no way.
    """
    n = len(rows)
    bound = lower_bounds(rows, ends)
    best: tuple[int, str, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    stack = [(0, "", "", 0, start)] if bound[0][start] < NEVER else []
    while stack:
        cost, audit, roles, i, q = stack.pop()
        if table[i, q] < (cost, audit):
            continue
        if best is not None:
            least = cost + bound[i][q]
            if least > best[0] or (least == best[0] and audit > best[1][:len(audit)]):
                continue
        if i == n and q in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, roles)
        letter, after = NEEDED[q]
        moves = [(5, "I", letter, i, after)]
        if i < n:
            own, gone, cut = rows[i]
            moves.append((2, "D", "-", i + 1, q))
            if not gone:
                more = 5 if cut else 0
                if q in FOLLOWS.get(own, ()):
                    moves.append((more, "K", own, i + 1, FOLLOWS[own][q]))
                if own != letter:
                    moves.append((1 + more, "R", letter, i + 1, after))
        branches = []
        for add, edit, role, j, to in moves:
            new = (cost + add, audit + edit)
            if (j, to) not in table or new < table[j, to]:
                branches.append((new[0] + bound[j][to], edit, new, roles + role, j, to))
        # the branch of least bound, then least edit, is looked into first
        for least, _, new, path, j, to in sorted(branches, reverse=True):
            if least < NEVER:
                table[j, to] = new
                stack.append((*new, path, j, to))
    return best


# ---------------------------------------------------------------- blocks

TABLE = "array<struct<a:int,b:int,cost:bigint,audit:string,roles:string>>"
BLOCKS = f"c string, block bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, paths {TABLE}"


def _blocks(size: int):
    """Blocks (c, block, runs) in, the tables of their searches out; a block 0 of less than ``size`` rows is a whole conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, size)
    return run


def _searched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for c, block, runs in zip(*(batch.column(k).to_pylist() for k in ("c", "block", "runs"))):
            rows, counts = [], [0, 0, 0]
            letters = ""
            for run in sorted(runs, key=lambda r: r["lo"]):
                for k in range(run["n"]):
                    repeated = not run["blank"] and not (k == 0 and run["first"])
                    cut = run["cut"] and not run["blank"] and not repeated
                    for at, fault in enumerate((run["blank"], repeated, cut)):
                        counts[at] += fault
                    rows.append((run["letter"], run["blank"] or repeated, cut))
                    letters += run["letter"] or "?"
            whole = block == 0 and len(rows) < size
            paths = []
            for start in [START] if block == 0 else range(4):
                for ends in [WHOLE] if whole else [(q,) for q in range(4)]:
                    if (found := search(rows, start, ends)) is not None:
                        paths.append({"a": start, "b": ends[0]} | dict(zip(("cost", "audit", "roles"), found)))
            illegal = sum(x + y not in LEGAL for x, y in zip(letters, letters[1:]))
            out.append({"c": c, "block": -1 if whole else block, "n": len(rows), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
                        "illegal": illegal, "head": letters[:1], "tail": letters[-1:], "paths": paths})
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([("c", pa.string()), *((k, pa.int64()) for k in ("block", "n", "blank", "duplicate", "truncated", "illegal")),
                     ("head", pa.string()), ("tail", pa.string()),
                     ("paths", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])))])


def join_tables(parts: list[dict]) -> dict:
    """One block from neighbouring blocks in order."""
    out = dict(parts[0])
    for part in parts[1:]:
        best: dict[tuple[int, int], tuple[int, str, str]] = {}
        for x in out["paths"]:
            for y in part["paths"]:
                if x["b"] == y["a"]:
                    new = (x["cost"] + y["cost"], x["audit"] + y["audit"], x["roles"] + y["roles"])
                    key = (x["a"], y["b"])
                    if key not in best or new < best[key]:
                        best[key] = new
        out["paths"] = [{"a": a, "b": b, "cost": v[0], "audit": v[1], "roles": v[2]} for (a, b), v in best.items()]
        out["illegal"] += part["illegal"] + (out["tail"] + part["head"] not in LEGAL)
        for k in ("n", "blank", "duplicate", "truncated"):
            out[k] += part[k]
        out["tail"] = part["tail"]
    return out


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for block, parts in zip(batch.column("up").to_pylist(), batch.column("parts").to_pylist()):
            out.append(join_tables(sorted(parts, key=lambda p: p["block"])) | {"block": block})
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _solved(tables: DataFrame) -> DataFrame:
    """``c, cost, audit, roles`` and the counts of every conversation from the tables of its blocks."""
    counts = ["n", "blank", "duplicate", "truncated", "illegal"]
    done = tables.where("block = -1")
    rest = tables.where("block >= 0")
    while (most := rest.agg(F.max("block")).first()[0]) is not None and most > 0:
        rest = stage(rest.groupBy("c", F.expr(f"block div {FAN}").alias("up"))
                     .agg(F.collect_list(F.struct(*[F.col(k) for k in rest.columns])).alias("parts")).select("up", "parts").mapInArrow(_join, BLOCKS), "repair-joined")
    # a conversation of several blocks may end at its start or after an assistant
    ends = rest.withColumn("paths", F.filter("paths", lambda p: p["b"].isin(START, DONE)))
    path = F.array_min(F.transform("paths", lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"), p["roles"].alias("roles"))))
    return done.unionByName(ends).select("c", *counts, path.alias("p")).select("c", *counts, "p.cost", "p.audit", "p.roles")


# ---------------------------------------------------------------- the operator


def conversation_key(conv_id: Column) -> Column:
    """The id as text; a null id is one space, which no number is."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def _keyed(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(conversation_key(F.col("conv_id")).alias("c"), "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("h"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]


def repair_plans(turns: DataFrame) -> DataFrame:
    """``c, n, blank, duplicate, truncated, illegal, cost, audit, roles`` for every conversation that has rows.

    ``turns(conv_id, turn, role, text)``; other columns are ignored. ``c`` is the conversation's key. Rows are taken by
    turn (nulls first), then role, then SHA-256 of the text; equal rows are repeated ones. Null roles and
    texts are one space, so such a text is blank and such a role's initial is legal nowhere.
    """
    rows = _keyed(turns)
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    kinds = (rows.select("c", "turn", "role", "h", F.substring("role", 1, 1).alias("letter"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
             .groupBy("c", "turn", "role", "h", "letter", "blank", "cut").agg(F.count("*").alias("k")))
    # the running total counts a conversation's rows up to and with each run of equal ones
    placed = stage(running_total(kinds, ["c"], _order(), F.col("k"), "end").withColumn("lo", F.col("end") - F.col("k")), "repair-runs")
    firsts = (placed.where("not blank").groupBy("c", "role", "h").agg(F.min("lo").alias("first_lo"), F.count("*").alias("times"))
              .where("times > 1").select("c", "role", "h", "first_lo"))
    met = placed.join(firsts, ["c", "role", "h"], "left").withColumn("first_lo", F.coalesce("first_lo", "lo"))
    dealt = met.select("c", "lo", "end", "letter", "blank", "cut", "first_lo", F.explode(F.expr(f"sequence(lo div {BLOCK}, (end - 1) div {BLOCK})")).alias("block"))
    dealt = (dealt.withColumn("from", F.greatest("lo", F.col("block") * BLOCK)).withColumn("to", F.least("end", (F.col("block") + 1) * BLOCK))
             .select("c", "block", F.struct(F.col("from").alias("lo"), (F.col("to") - F.col("from")).cast("int").alias("n"), "letter", "blank", "cut",
                                            (F.col("from") == F.col("first_lo")).alias("first")).alias("run")))
    tables = settle(dealt.groupBy("c", "block").agg(F.collect_list("run").alias("runs")).mapInArrow(_blocks(BLOCK), BLOCKS), "repair-blocks")
    return _solved(tables)


REPAIRED = "c string, at bigint, edit string, turn bigint, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, each after its plan (kind 0), in; the repaired turns in order out."""
    c = audit = roles = ""
    k = at = 0
    out: list[tuple] = []

    def insert():
        """The inserted turns that stand next in the plan."""
        nonlocal k, at
        while k < len(audit) and audit[k] == "I":
            out.append((c, at, "I", None, NAMES[roles[k]], ""))
            k, at = k + 1, at + 1

    def flush():
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["c", "at", "edit", "turn", "role", "text"])

    for batch in batches:
        for key, kind, turn, role, text, plan, given in zip(*(batch.column(x).to_pylist() for x in ("c", "kind", "turn", "role", "text", "audit", "roles"))):
            if not kind:
                insert()  # the end of the conversation before
                c, audit, roles, k, at = key, plan, given, 0, 0
                continue
            insert()
            edit = audit[k]
            if edit != "D":
                out.append((c, at, edit, turn, NAMES[roles[k]] if edit == "R" else role, text))
                at += 1
            k += 1
        yield flush()
        out = []
    insert()
    yield flush()


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``c, at, edit, turn, role, text``: the repaired conversations, ``at`` counting from 0; inserted turns have a null ``turn``.

    A conversation is read in order by one task, row by row: nothing but its plan is held. Partitions keep
    conversations whole and in order.
    """
    rows = _keyed(turns).select("c", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "h",
                                F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("roles"))
    heads = plans.select("c", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("h"), "audit", "roles")
    return rows.unionByName(heads).repartition("c").sortWithinPartitions("c", "kind", *_order()).mapInArrow(_apply, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order in; (c, sha256 of their ``role:text`` joined by newlines) out."""
    c, state = None, None
    for batch in batches:
        done = []
        for key, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "role", "text"))):
            if key != c:
                if state is not None:
                    done.append((c, state.hexdigest()))
                c, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["c", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([state.hexdigest()])], names=["c", "repaired_sha256"])


def repair_digests(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every distinct ``conv_id`` of ``conversations``, null included: gaps, faults, cost, audit and digest of the repair of ``turns``.

    ``gaps`` is maxTurn - minTurn + 1 - distinct turns, nulls ignored. A conversation without rows has zeros, an empty audit and
    the digest of nothing. Empty tables give an empty result.
    """
    first_step = staged_so_far()
    plans = stage(repair_plans(turns), "repair-plans")
    shas = repaired_turns(turns, plans.where("n > 0")).mapInArrow(_digests, "c string, repaired_sha256 string")
    span = (turns.select(conversation_key(F.col("conv_id")).alias("c"), "turn").groupBy("c")
            .agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")))
    every = conversations.select("conv_id").distinct().withColumn("c", conversation_key(F.col("conv_id")))
    met = every.join(span, "c", "left").join(plans, "c", "left").join(shas, "c", "left")
    zero = [F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = met.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                     F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return finish(first_step, out)[0]
