"""Operator 9: chat formatting with DataFrame expressions only.

Output template, per conversation, one block for each run of adjacent turns of one role::

    <|turn|>ROLE\\nTEXT<|next|>TEXT ...<|end|>\\n

Inside roles and texts a backslash becomes ``\\e``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b`` (in
roles also a line feed becomes ``\\n``), so no control string of this or of another common template
can be formed by a text, and ``unescape`` restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"
# The escape code of each character that could begin a control string.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, CODES)


def unescape(text: Column) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(CODES)])


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start, length in code points).

    Input columns ``conv_id, turn, role, text``; others are ignored. Turns are ordered by
    (turn, role, text) with nulls first, so ties and repeated rows have one defined order and all
    stay. A null text or role is the empty string. Rows with a null conv_id form one conversation.
    The spans cover the (escaped) texts of ``loss_role`` and none of the markers between them.
    """
    said = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    out = turns.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("_turns"))
    # starts of runs of one role, then each run as a slice: the merge of adjacent same-role turns
    starts = F.expr("filter(sequence(0, size(_turns) - 1), i -> i = 0 or _turns[i].role <> _turns[i - 1].role)")
    out = out.withColumn("_starts", starts)
    run = F.transform("_starts", lambda s, k: F.struct(
        _escape_role(F.col("_turns")[s]["role"]).alias("head"),
        (F.col("_turns")[s]["role"] == F.lit(loss_role)).alias("loss"),
        F.transform(F.slice("_turns", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_turns")) - s),
                    lambda t: escape(t["text"])).alias("texts")))
    out = out.select("conv_id", run.alias("_runs"))
    block = F.transform("_runs", lambda r: F.concat(
        F.lit(TURN), r["head"], F.lit("\n"), F.array_join(r["texts"], NEXT), F.lit(END)))
    # offsets: one pass over the runs, and within a run over its texts
    head = len(TURN) + 1
    spans = "array<struct<start:bigint,length:bigint>>"
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans"))

    def over_text(a, t):
        size = F.length(t).cast("bigint")
        return F.struct((a["at"] + size + len(NEXT)).alias("at"),
                        F.array_append(a["spans"], F.struct(a["at"].alias("start"), size.alias("length"))).alias("spans"))

    def over_run(a, r):
        begin = a["at"] + head + F.length(r["head"])
        width = F.length(F.array_join(r["texts"], NEXT))
        inner = F.aggregate(r["texts"], F.struct(begin.alias("at"), a["spans"].alias("spans")), over_text)
        return F.struct((begin + width + len(END)).alias("at"),
                        F.when(r["loss"], inner["spans"]).otherwise(a["spans"]).alias("spans"))

    return out.select("conv_id", F.array_join(block, "").alias("formatted"),
                      F.aggregate("_runs", state, over_run, lambda a: a["spans"]).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Inverse of :func:`format_chat`: ``conv_id``, ``turns`` (role, text in order), ``loss_text``.

    Works from ``formatted`` and ``loss_spans`` alone. A conversation always has a turn, so the
    formatted text is never empty; an empty or null one gives no turns.
    """
    blocks = F.expr(r"slice(split(formatted, '<\\|turn\\|>', -1), 2, size(split(formatted, '<\\|turn\\|>', -1)))")
    out = formatted.select("conv_id", "formatted", "loss_spans", blocks.alias("_blocks"))
    parsed = F.transform("_blocks", lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        F.split(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2,
                         F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(END)), r"<\|next\|>", -1).alias("texts")))
    turns = F.flatten(F.transform(parsed, lambda r: F.transform(r["texts"], lambda t: F.struct(
        r["role"].alias("role"), unescape(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return out.select("conv_id", "formatted", turns.alias("turns"), unescape(F.array_join(loss, "")).alias("loss_text"))
