"""Operator 1: chat formatting with cumulative-snapshot collapse.

A log that stores a conversation after every turn holds each prefix of it as
a conversation of its own. Rolling hashes over the turns name every prefix;
an anti-join drops the conversations whose whole hash is a prefix hash of a
longer one, and only the maximal ones are rendered. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.operators.sequence import sequence_index

PART_TURNS = 256  # turns rendered into one row at most; longer conversations get several parts


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text, h1, h2): the turns in order, pos from 1, with a
    128-bit rolling hash of the conversation up to and with this turn.

    Rows equal in all four columns are one turn. Order: turn number (null
    first), then role, then text. The hash is the running exclusive or of
    hashes of (pos, role, text), so a conversation of any length, split over
    any number of tasks, carries two numbers across the borders.
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                     F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    keyed = t.withColumn("d", F.xxhash64(F.lit(3), F.col("role").isNull(), "role", F.col("text").isNull(), "text"))
    placed = sequence_index(keyed, ["conv"], ["turn", "role", "text"])
    placed = placed.select("conv", F.col("seq_idx").alias("pos"), "role", "text",
                           F.xxhash64(F.lit(1), "seq_idx", "d", "role", "text").alias("a"),
                           F.xxhash64(F.lit(2), "d", "text", "seq_idx", "role").alias("b"))
    return sequence_index(placed, ["conv"], ["pos"], xors=["a", "b"]).select(
        "conv", "pos", "role", "text", F.col("xor_a").alias("h1"), F.col("xor_b").alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, turns, copies): one row for each conversation that no longer one
    starts with; of equal conversations the smallest id, with their number."""
    full = prefixes.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("e"))
    ends = full.groupBy(F.col("e.pos").alias("pos"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2")).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    passing = prefixes.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    # More conversations pass through this hash than end at it: a longer one starts so.
    longer = (passing.join(ends.select("pos", "h1", "h2", "copies"), ["pos", "h1", "h2"])
                     .filter(F.col("n") > F.col("copies")))
    return (ends.join(longer, ["pos", "h1", "h2"], "left_anti")
                .select("conv", F.col("pos").alias("turns"), "copies"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, turns, copies, text): the maximal
    conversations in ChatML, ``part_turns`` turns a row at most (the parts in
    order, joined, are the conversation).

    A null role renders as an empty one, a null text as an empty text; both
    differ from empty when conversations are compared. Turns without a
    conversation id are one conversation of id null. Other columns of the
    input are not read. An empty table gives an empty result.
    """
    prefixes = staged(prefix_hashes(turns, conv, turn, role, text), "chat")
    kept = maximal(prefixes).withColumnRenamed("conv", "kept_conv")
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return (prefixes.join(kept, F.col("conv").eqNullSafe(F.col("kept_conv")))
            .groupBy("conv", F.floor((F.col("pos") - 1) / part_turns).cast("int").alias("part"))
            .agg(F.count(F.lit(1)).cast("int").alias("n_turns"), F.max("turns").cast("int").alias("turns"),
                 F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("s"))
            .select(F.col("conv").alias(conv), "part", "n_turns", "turns", "copies",
                    F.array_join(F.col("s.said"), "").alias("text")))
