"""Chat formatting from an event log.

The log has conv_id, seq, message (the message an event belongs to), role, event and text. ``message`` and ``delta``
append a text, ``edit`` replaces what the message says so far, ``regenerate`` clears it for the deltas that follow.
A conversation's events meet in the only shuffle; sorting, folding and rendering follow in its row. A formatted
conversation is one value, so one conversation is one row of one task by contract.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed. In roles and texts a backslash is doubled and control
strings of this and other common templates (``CONTROL``) get a backslash behind their first character, which ``unescape``
undoes.

Defined cases: null text and null role are empty; events of one message and seq are taken by event name, role and text
(all of them count); messages of one number stand beside each other by role and text; a null conversation is one
conversation; events without a message or seq come first; very long texts and conversations are taken whole; an empty
table gives no rows but the report's own conversation; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.mapping import once
from hazlake.llm.common import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"(<(?=\||/?s>|</?SYS>>|(?:start|end)_of_turn>|[be]os>)|\[(?=/?INST\]))"
ASSISTANT = "assistant"
DELTA = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def events_of(conversations: DataFrame, size: int = DELTA) -> DataFrame:
    """The log of a finished conversation table: user turns as messages, assistant turns as streamed deltas.

    Rows that repeat a turn are messages of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    pieces = F.when((role == ASSISTANT) & (text != ""), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(text))
    # rows that repeat each other are told apart by their place in the table, which changes no result
    message = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.xxhash64(text).alias("part"), F.monotonically_increasing_id().alias("copy"))
    rows = conversations.select("conv_id", message.alias("message"), role.alias("role"), pieces.alias("pieces"))
    rows = rows.select("conv_id", "message", "role", F.posexplode("pieces").alias("seq", "text"))
    return rows.select("conv_id", "message", F.col("seq").cast("bigint").alias("seq"), "role", F.when(F.col("role") == ASSISTANT, "delta").otherwise("message").alias("event"), "text")


def _said(log: Column) -> Column:
    """The final text of a message's sorted events: what an edit or regeneration leaves behind starts at the last of them."""
    fresh = lambda e: e["event"].isin("edit", "regenerate")
    last = F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(fresh(e), i))), F.lit(0))
    return F.array_join(F.transform(F.slice(log, last + 1, F.size(log)), lambda e: F.when(e["event"] == "regenerate", "").otherwise(e["text"])), "")


def turns(events: DataFrame) -> DataFrame:
    """conv_id, turns: the final messages (message, role, text) of each conversation. The role is that of a message's first event."""
    one = F.struct("message", "seq", "event", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("log"))
    at = lambda i: F.get("log", i)["message"]
    starts = F.filter(F.sequence(F.lit(0), F.size("log") - 1), lambda i: (i == 0) | ~at(i).eqNullSafe(at(i - 1)))
    logs = once(logs, starts=starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("log")))
    final = lambda m: F.struct(F.get(m, F.lit(0))["message"].alias("message"), F.get(m, F.lit(0))["role"].alias("role"), _said(m).alias("text"))
    return once(logs, turns=F.zip_with("starts", ends, lambda a, b: let(F.slice("log", a + 1, b - a), final))).select("conv_id", "turns")


def render(folded: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: the text of each conversation and its pieces (text, loss), of which loss is trained on."""
    part = lambda piece, loss: F.struct(piece.alias("piece"), loss.alias("loss"))
    parts = F.transform("turns", lambda t: F.array(
        part(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), F.lit(False)), part(escape(t["text"]), t["role"] == ASSISTANT), part(F.lit(END + "\n"), F.lit(False))))
    rows = once(folded.select("conv_id", "turns"), mask=F.flatten(parts))
    return rows.select("conv_id", F.array_join(F.transform("mask", lambda m: m["piece"]), "").alias("formatted"), "mask")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")
    cut = lambda t: F.split(F.regexp_replace(t, r"<\|end\|>\n$", ""), r"<\|text\|>", -1)
    return F.transform(turns, lambda t: F.struct(unescape(F.get(cut(t), F.lit(0))).alias("role"), unescape(F.get(cut(t), F.lit(1))).alias("text")))


def report(conversations: DataFrame) -> DataFrame:
    test = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(test).alias("text"))
    table = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(extra)
    done = once(render(turns(events_of(table))), turns=read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("mask", lambda m: m["loss"]), lambda m: unescape(m["piece"])), "")
    read = done.select("conv_id", "turns", loss.alias("loss"), "formatted")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
