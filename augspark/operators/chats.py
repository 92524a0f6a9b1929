"""Conversations stored as one row per turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.prompts import append_reply, message, render_chat, render_message
from augspark.operators.skew import broadcast_if_small, join_keys, row_numbers
from augspark.session import cut_lineage

# A conversation of more turns or bytes is not gathered turn by turn; its rendered text is one value up to the bytes
MAX_CHAT_TURNS, MAX_CHAT_BYTES = 10_000, 64 << 20
# Turns of a part of such a conversation
PART_TURNS = 1_000


def whole_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): one array per conversation, in the order of turn, role and text.

    A conversation is one value, as it is for the model that reads it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(ordered, lambda m: message(m["role"], m["text"]))
    return turns.groupBy(key).agg(messages.alias("messages"))


def chat_parts(turns: DataFrame, part_turns: int, key: str = "conv_id") -> DataFrame:
    """Message arrays of up to ``part_turns`` consecutive turns: (key, part, is_last, messages).

    For conversations too long for one row. They are cut by the rank of their turns, so no task gets all
    of one; the rendered parts follow each other without a separator, and a reply goes to the last part.
    """
    order = [F.col("turn"), F.col("role"), F.col("text")]
    ranked = row_numbers(turns.select(key, "turn", "role", "text"), [key], order, "_rank")
    part = F.floor((F.col("_rank") - 1) / part_turns).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "role", "text")))
    messages = F.transform(ordered, lambda m: message(m["role"], m["text"]))
    parts = ranked.groupBy(key, part.alias("part")).agg(messages.alias("messages"))
    lengths = turns.groupBy(F.col(key).alias("_key")).agg(F.floor((F.count("*") - 1) / part_turns).cast("int").alias("_last"))
    joined = parts.join(lengths, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(key, "part", (F.col("part") == F.col("_last")).alias("is_last"), "messages")


def render_conversations(turns: DataFrame, key: str = "conv_id", part_turns: int | None = None) -> DataFrame:
    """Rendered text per conversation, or per part of up to ``part_turns`` turns: (key, part, rendered).

    Without ``part_turns`` a conversation is one row, part 0. Long ones are rendered in parts all the same, by
    several tasks, and their parts are joined where they make up to MAX_CHAT_BYTES; a conversation beyond
    that is returned as its parts, whose texts follow each other. ``turns`` is read more than once.
    """
    return _rendered(turns, key, part_turns, lambda messages, is_last: render_chat(messages))


def with_reply(turns: DataFrame, reply: Column, key: str = "conv_id", part_turns: int | None = None) -> DataFrame:
    """Rendered conversations with one reply at their end and an open turn behind it: (key, part, rendered).

    reply: a column of the key. Parts as in :func:`render_conversations`; the last one gets the reply.
    """

    def answered(messages: Column, is_last: Column) -> Column:
        whole = render_chat(append_reply(messages, reply), open_reply=True)
        return F.when(is_last, whole).otherwise(render_chat(messages))

    return _rendered(turns, key, part_turns, answered)


def _rendered(turns: DataFrame, key: str, part_turns: int | None, render: Callable[[Column, Column], Column]) -> DataFrame:
    def in_parts(rows: DataFrame, size: int) -> DataFrame:
        return chat_parts(rows, size, key).select(key, "part", render(F.col("messages"), F.col("is_last")).alias("rendered"))

    if part_turns is not None:
        return in_parts(turns, part_turns)
    # sizes come from partial counts; the keys of long conversations are few
    sizes = turns.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long_keys, many = broadcast_if_small(cut_lineage(sizes.where((F.col("n") > MAX_CHAT_TURNS) | (F.col("size") > MAX_CHAT_BYTES)).select(key)))
    short = join_keys(turns, long_keys, [key], "left_anti") if many else turns
    whole = whole_chats(short, key).select(key, F.lit(0).alias("part"), render(F.col("messages"), F.lit(True)).alias("rendered"))
    if not many:
        return whole
    parts = cut_lineage(in_parts(join_keys(turns, long_keys, [key], "left_semi"), PART_TURNS))
    lengths = parts.groupBy(key).agg(F.sum(F.octet_length("rendered")).alias("size"))
    too_long, _ = broadcast_if_small(lengths.where(F.col("size") > MAX_CHAT_BYTES).select(key))
    ordered = F.array_sort(F.collect_list(F.struct("part", "rendered")))
    joined = join_keys(parts, too_long, [key], "left_anti").groupBy(key).agg(
        F.concat_ws("", F.transform(ordered, lambda p: p["rendered"])).alias("rendered")
    )
    return whole.unionByName(joined.withColumn("part", F.lit(0))).unionByName(join_keys(parts, too_long, [key], "left_semi"))


def render_turns(turns: DataFrame) -> DataFrame:
    """Rendered text per turn, without bringing the turns of a conversation together."""
    return turns.withColumn("rendered", render_message(F.col("role"), F.col("text")))
