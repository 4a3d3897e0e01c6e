"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are its context,
and only its own text is trained on. An example is the formatted text from the first turn
through that reply, with the loss mask ``[loss_start, loss_end)`` in characters. Turns after
the last reply are in no example's context; where there are such turns, one more row holds
the whole conversation with an empty mask, so the output holds every turn.

A conversation's turns are gathered once, sorted, and its examples are made one at a time
from that array: a task holds one conversation and one example, never all its examples.

Template of a turn: ``### role: text</turn>`` and a line break. In roles and texts a
backslash is written ``\\b``, ``#`` is ``\\h`` and ``<`` is ``\\l`` (in roles also ``:`` is
``\\c``). So neither marker can occur inside them, a reader may split at the markers, and
``unescape`` gives back the exact text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED_ROLE = "assistant"
#: the backslash comes first when escaping and last when reading back
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, step: F.replace(t, F.lit(step[0]), F.lit(step[1])), steps, text)


def escape(text: Column, role: bool = False) -> Column:
    return _replaced(text, CODES if role else CODES[:3])


def unescape(text: Column) -> Column:
    return _replaced(text, [(code, char) for char, code in reversed(CODES)])


def expand(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, text, loss_start, loss_end)``, a row per assistant turn and one for what follows the last.

    ``turn_no`` (from 1) is the turn the row ends with. Turns are ordered by ``turn`` (nulls
    first), then role and text, so repeated turns have a fixed order and each counts. Null
    roles and texts count as empty; rows of a null conv_id form one conversation. A row whose
    mask is empty with ``loss_start`` and ``loss_end`` null trains nothing. Other columns,
    whatever their names, are ignored; an empty table gives an empty table.

    An example is a string, so Spark's limit of 2 GB for a row is also the limit of a
    conversation; one that is longer fails rather than being cut.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(MIDDLE))
    formatted = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("segments"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.filter(
            F.transform("turns", lambda t, i: F.when((t["role"] == TRAINED_ROLE) | (i == F.size("turns") - 1), F.struct((i + 1).alias("turn_no"), (t["role"] == TRAINED_ROLE).alias("trained")))),
            lambda e: e.isNotNull(),
        ).alias("ends"),
    )
    last = formatted.select("conv_id", "segments", "heads", F.inline("ends")).select(
        "conv_id", "turn_no", "trained",
        F.array_join(F.slice("segments", F.lit(1), F.col("turn_no")), "").alias("text"),
        F.length(F.element_at("segments", F.col("turn_no"))).alias("own"), F.element_at("heads", F.col("turn_no")).alias("head"),
    )
    end = F.length("text")
    return last.select(
        "conv_id", "turn_no", "text",
        F.when(F.col("trained"), end - F.col("own") + F.col("head")).alias("loss_start"),
        F.when(F.col("trained"), end - len(CLOSE)).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as structs ``(role, text)``, read back from the markers alone."""
    pieces = F.split(text, CLOSE)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    role_end = lambda p: F.instr(p, MIDDLE)
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), role_end(p) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, role_end(p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Conversations and trained text read back from the expanded rows, one row per conversation.

    The turns come from each conversation's longest row, which holds them all; the trained
    text is what lies under the masks of its rows, in order. ``formatted_chars`` counts the
    characters of all rows. Digests are of joined texts, so a conversation is one row here.
    """
    masked = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    grouped = examples.select("conv_id", "turn_no", "text", masked.alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "turn_no").alias("whole"),
        F.array_sort(F.collect_list(F.struct("turn_no", "loss"))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    read = grouped.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"), "formatted_chars",
        F.array_join(F.transform("losses", lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
