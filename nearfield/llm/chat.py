"""Chat formatting: logged snapshots collapse to whole conversations, which are then rendered.

A conversation logged after each turn appears many times, each a prefix of the next. The
hash of its first i turns is the sum of hashes of each turn with its place, so it can be
added up block by block: a conversation may lie in many tasks and is never one row before it
is rendered. One that another one continues has its last hash among that one's earlier hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.llm.repair import PART_ROWS, in_order

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Turns of a block, whose hashes are added up by themselves.
BLOCK_TURNS = 4_096
# A sum of 64-bit hashes, over any number of turns.
SUM = "decimal(38,0)"


def ordered_turns(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, turn, role, text, digest, at: distinct turns in order, dealt by ranges, stored."""
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), plain("role"), plain("text"))
    return in_order(rows.distinct().withColumn("times", F.lit(1)), part_rows)


def prefix_hashes(ordered: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, n, length, one, two: for each turn, the hashes of all turns up to it; n is the whole length."""
    slim = ordered.select("conv_id", "at", "role", "text")
    whole = slim.groupBy("conv_id").agg(F.min("at").alias("begin"), F.count("*").alias("n")).withColumnRenamed("conv_id", "whole_id")
    placed = slim.join(whole, F.col("conv_id").eqNullSafe(F.col("whole_id"))).withColumn("length", F.col("at") - F.col("begin") + 1)
    # Lengths part role and text; the place makes the same turn elsewhere another summand.
    said = (F.col("length"), F.length("role"), "role", "text")
    hashes = [F.xxhash64(F.lit(seed), *said).cast(SUM).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    block = F.expr(f"at div {int(block_turns)}").alias("block")
    turns = stored(placed.select("conv_id", "n", "length", block, *hashes))
    # At most block_turns rows in a window.
    within = Window.partitionBy("conv_id", "block").orderBy("length")
    own = turns.select("conv_id", "n", "length", "block", *(F.sum(h).over(within).cast(SUM).alias(h) for h in ("h1", "h2")))
    # One row for each block: what the blocks before it add up to.
    sums = turns.groupBy("conv_id", "block").agg(*(F.sum(h).cast(SUM).alias(h) for h in ("h1", "h2")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(h).over(before), F.lit(0)).cast(SUM).alias(f"{h}_before") for h in ("h1", "h2"))
    )
    joined = own.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    total = lambda h: (F.col(h) + F.col(f"{h}_before")).cast(SUM)
    return joined.select("conv_id", "n", "length", total("h1").alias("one"), total("h2").alias("two"))


def maximal_turns(conversations: DataFrame, part_rows: int = PART_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, at, turn, role, text of the conversations that no other one continues, a row for each turn.

    ``conversations`` has a row for each turn: conv_id, turn, role, text. Turns are ordered by
    number, nulls first, then by role and text; rows repeated within a conversation count once;
    null role and text are empty; rows without a conv_id are one conversation. Of equal
    conversations that of the least id stays. Other columns are not read. Prefixes are
    compared by two sums of 64-bit hashes; equal ones are reduced before they are joined.
    """
    ordered = ordered_turns(conversations, part_rows)
    hashes = stored(prefix_hashes(ordered, block_turns))
    key = ["length", "one", "two"]
    ends = hashes.where("length = n").groupBy(*key).agg(F.min("conv_id").alias("kept_id"))
    prefixes = hashes.where("length < n").select(*key).distinct()
    kept = ends.join(prefixes, key, "left_anti").select("kept_id")
    rows = ordered.select("conv_id", "at", "turn", "role", "text")
    return rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")


def rendered(role: Column, text: Column) -> Column:
    """A turn as marked text; marks inside it are broken up by a blank."""
    plain = lambda c: F.regexp_replace(c, r"<\|", "< |")
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def rendered_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, n_turns, text: rendered runs of at most so many turns, whose texts in order make the conversation."""
    line = F.struct("at", rendered(F.col("role"), F.col("text")).alias("line"))
    lines = F.sort_array(F.collect_list(line))["line"]
    blocks = turns.groupBy("conv_id", F.expr(f"at div {int(block_turns)}").alias("block"))
    return blocks.agg(F.count("*").alias("n_turns"), F.array_join(lines, "").alias("text"))


def format_chats(conversations: DataFrame, part_rows: int = PART_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, n_turns, text: the maximal conversations, rendered. See maximal_turns.

    A rendered text is one value, at most 2 GB; longer ones are to be had as rendered_blocks.
    """
    blocks = rendered_blocks(maximal_turns(conversations, part_rows, block_turns), block_turns)
    texts = F.sort_array(F.collect_list(F.struct("block", "text")))["text"]
    return blocks.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_join(texts, "").alias("text"))
