"""Chat formatting as event-sourced reconstruction, in DataFrame functions alone.

A log holds events of conversations: `message` sets a text, `delta` appends to it, `edit` replaces it,
`regenerate` empties it (the deltas that follow fill it again) and `delete` removes the message. Events are
folded in the order of their sequence numbers into final messages, which are rendered with a template that
marks turns and escapes control strings inside texts reversibly.

Template of a turn: <|im_start|>role\\ntext<|im_end|>\\n. Inside a text, each `<` that backslashes (or none)
and a bar follow gets one more backslash; reading back takes one away. So no text can hold a control string,
and every text comes back as it was. Roles also have backslashes and newlines escaped.

Defined results: null role or text is empty; a null conversation id is a conversation of its own; events of
equal sequence number go by kind, role, then text; repeated rows are repeated turns; an empty log gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds that set a message's text anew.
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def messages_from_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of events (conv_id, msg, seq, kind, role, text).

    Only the events from a message's last reset on are gathered, and joined in one pass, so a message
    of many deltas costs its own length.
    """
    w = Window.partitionBy("conv_id", "msg")
    last = F.max(F.when(F.col("kind").isin(*RESETS), F.struct("seq", "kind"))).over(w)
    live = events.withColumn("last", last).where(F.col("last").isNull() | (F.col("seq") > F.col("last.seq")) | ((F.col("seq") == F.col("last.seq")) & (F.col("kind") >= F.col("last.kind"))))
    part = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.when(F.col("kind").isin("regenerate", "delete"), "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    folded = live.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("last.kind").alias("by"), F.max("role").alias("any_role"))
    return folded.where(F.coalesce("by", F.lit("")) != "delete").select(
        "conv_id", "msg", F.coalesce("any_role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )


def turns_as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of whole turns as a log of `message` events; equal turn numbers stay apart."""
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select("conv_id", nth.cast("long").alias("msg"), nth.cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) of final messages in the order of msg."""
    one = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("msg", one.alias("turn"))))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text, start, length of the escaped text in code points) of a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    raw = F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 1 << 30))
    return F.transform(
        raw,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.lit(1 << 30))).alias("text"),
        ),
    )


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of the formatted string of each text that the model learns."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    sized = F.transform(pieces, lambda p: F.struct(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1).alias("role"), F.length(p).cast("long").alias("chars"), F.instr(p, "\n").cast("long").alias("head")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(
        sized,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["chars"] + F.lit(len(END) + 1)).alias("at"),
            F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), (p["chars"] - p["head"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def format_conversations(turns: DataFrame, **names: str) -> DataFrame:
    """(conv_id, formatted, loss) of a table of turns."""
    done = render(messages_from_events(turns_as_events(turns, **names)))
    return done.withColumn("loss", loss_spans(F.col("formatted")))


def chat_report(turns: DataFrame, **names: str) -> DataFrame:
    """Digests read back from the formatted strings: one row per conversation."""
    done = format_conversations(turns, **names).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    done = done.withColumn("said", said).withColumn("learned", F.array_join(masked, ""))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
