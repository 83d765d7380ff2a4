"""Chat formatting by event-sourced reconstruction.

A conversation log holds events: ``message`` opens a message, ``delta``
appends streamed text to it, ``edit`` replaces its text, ``regenerate`` empties
it so that the deltas after it write it anew, ``delete`` removes it.  Events
are partitioned by conversation and sorted by sequence; windows find each
message's last reset, and what follows it is concatenated.  The messages are
rendered with a template whose markers cannot occur in an escaped text.
Only built-in functions are used.

Defined cases: a null text is empty; a null role is an empty role; a null
event kind is ``message``; null conversations and null sequence numbers form
a group and sort first; events with equal sequence numbers are ordered by
message, kind, role and text, so that the result does not depend on how rows
are dealt; repeated rows are repeated events; an event other than
``message`` for a message that was never opened opens it; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of common chat templates: a text holding one gets a
#: backslash after its first character, and a backslash is doubled.
CONTROL_RE = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_RE, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(
    events: DataFrame,
    conv_col: str = "conv_id",
    seq_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    kind_col: str | None = None,
    message_col: str | None = None,
) -> DataFrame:
    """(conv, at, copy, role, text): the final messages in order.

    ``message_col`` names the message an event belongs to; without it every
    event is a message of its own, ordered by sequence.  A message stands
    where its first event stands, and has the role of its first event.
    """
    kind = F.coalesce(F.col(f"`{kind_col}`"), F.lit("message")) if kind_col else F.lit("message")
    rows = events.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{seq_col}`").alias("seq"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *([kind.alias("kind"), F.col(f"`{message_col}`").alias("msg")] if message_col else []),
    )
    if not message_col:
        return rows.select("conv", F.struct("seq", "role", "text").alias("at"), "role", "text")
    event = F.struct("seq", "msg", "kind", "role", "text")
    per = Window.partitionBy("conv", "msg")
    resets = F.when(F.col("kind") != "delta", event)
    rows = rows.withColumns({"event": event, "reset": F.max(resets).over(per), "first": F.min(event).over(per)})
    live = rows.where(F.col("reset").isNull() | (F.col("event") >= F.col("reset")))
    folded = live.groupBy("conv", "msg").agg(
        F.first("first").alias("at"),
        F.first("reset").alias("reset"),
        F.array_sort(F.collect_list("event")).alias("parts"),
    )
    own = F.filter("parts", lambda e: e["kind"] != "regenerate")
    return folded.where(F.col("reset").isNull() | (F.col("reset.kind") != "delete")).select(
        "conv", "at", F.col("at.role").alias("role"), F.array_join(F.transform(own, lambda e: e["text"]), "").alias("text")
    )


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``segments``,
    the formatted string in pieces with their loss mask (concatenated they
    are ``formatted``; exactly the texts of ``loss_role`` are under the mask).
    """
    turns = messages.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("piece"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("piece"), (t["role"] == loss_role).alias("loss")),
                F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = turns.select("conv", pieces.alias("segments"))
    return out.select("conv", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds."""
    ends = F.split(formatted, r"<\|im_end\|>\n")
    body = F.transform(F.filter(ends, lambda p: p != ""), lambda p: F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1))
    texts = F.transform(
        F.filter(ends, lambda p: p != ""),
        lambda p: F.substr(p, F.instr(p, F.lit(SEP)) + len(SEP)),
    )
    return F.transform(
        F.arrays_zip(body.alias("role"), texts.alias("text")),
        lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["piece"])), "")
