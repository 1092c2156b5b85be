"""Conversations as training texts with a loss mask, by Spark expressions only.

A conversation's turns are collected, sorted, merged where neighbours have one
role, and concatenated:

    <|turn user|>first<|and|>second<|end|>
    <|turn assistant|>answer<|end|>

Marks are what stands between "<|" and "|>".  Roles and texts are escaped: a
backslash becomes \\b and a bar \\p, so no mark can come from a text, and two
literal replacements in the other order give the text back.

The mask comes as segments (text, loss): in their order they are the formatted
text, and those with loss are the assistant's texts, nothing else.

A conversation is one training text, so it is one row and its turns are
collected for that; turns of other conversations are never in the same row.
Every step is linear in the length of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.tensors import let

OPEN, CLOSE = "<|turn ", "|>"
AND, END = "<|and|>", "<|end|>\n"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def _messages(turns: Column) -> Column:
    """Sorted turns (role, text) as messages (role, texts): neighbours of one role are one message."""
    begins = lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), begins)

    def merged(at: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(at, k + 1), F.size(turns))
        texts = lambda s, k: F.transform(F.slice(turns, s + 1, stop(k) - s), lambda t: t["text"])
        return F.transform(at, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), texts(s, k).alias("texts")))

    return let(starts, merged)


def _segments(messages: Column, learnt: str) -> Column:
    mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def turn(message: Column, text: Column, k: Column) -> Column:
        before = F.when(k == 0, F.concat(F.lit(OPEN), escaped(message["role"]), F.lit(CLOSE))).otherwise(F.lit(AND))
        return F.array(mark(before), F.struct(escaped(text).alias("text"), (message["role"] == learnt).alias("loss")))

    def shown(message: Column) -> Column:
        turns = F.flatten(F.transform(message["texts"], lambda text, k: turn(message, text, k)))
        return F.concat(turns, F.array(mark(F.lit(END))))

    return F.flatten(F.transform(messages, shown))


def formatted(
    conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: str = LEARNT
) -> DataFrame:
    """One row per conversation: id, n_messages, segments (text, loss).

    Turns are in the order of `turn`, nulls last, equal ones by role and text.
    A null text or role is empty.  Repeated rows are turns of their own.  Rows
    without an id are one conversation.  An empty table gives an empty result;
    other columns are ignored.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(f"`{id_column}`").alias(id_column),
        F.struct(
            F.col(f"`{turn}`").isNull().alias("last"), F.col(f"`{turn}`").alias("turn"), named(role).alias("role"), named(text).alias("text")
        ).alias("__turn"),
    )
    collected = rows.groupBy(id_column).agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    messages = collected.select(id_column, _messages(F.col("__turns")).alias("__messages"))
    return messages.select(
        id_column, F.size("__messages").cast("bigint").alias("n_messages"), _segments(F.col("__messages"), learnt).alias("segments")
    )


def joined(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def turns_of(whole: Column) -> Column:
    """The turns (role, text) that a formatted text says."""

    def read(message: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(message, len(OPEN) + 1, F.length(message)), CLOSE, 1))
        rest = F.substring(message, F.instr(message, CLOSE) + len(CLOSE), F.length(message))
        turns = lambda role: F.transform(F.split(rest, "<\\|and\\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))
        return let(role, turns)

    return F.flatten(F.transform(F.filter(F.split(whole, "<\\|end\\|>\n"), lambda m: m != ""), read))


def digests(chats: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What the formatted texts say when read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_messages."""

    def of_turns(turns: Column) -> Column:
        said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        return F.struct(F.size(turns).cast("bigint").alias("n"), F.sha2(said, 256).alias("digest"))

    def of_text(whole: Column) -> Column:
        return F.struct(F.length(whole).cast("bigint").alias("chars"), let(turns_of(whole), of_turns).alias("turns"))

    of_loss = lambda text: F.struct(F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("digest"))
    read = chats.select(
        id_column, "n_messages", let(joined(F.col("segments")), of_text).alias("all"), let(learnt_text(F.col("segments")), of_loss).alias("loss")
    )
    return read.select(
        id_column,
        F.col("all.turns.n").alias("n_turns"),
        F.col("all.turns.digest").alias("turns_sha256"),
        F.col("loss.chars").alias("loss_chars"),
        F.col("loss.digest").alias("loss_sha256"),
        F.col("all.chars").alias("formatted_chars"),
        "n_messages",
    )
