"""Chat formatting: cumulative-snapshot collapse, then rendering.

A conversation logged after each turn is there many times, each time as a prefix of the
next. Each turn is hashed with its position in the conversation; the XOR of the hashes of
the first k turns is the prefix's rolling hash (two lanes of 64 bits), and XOR can be
summed up in blocks of turns, so no conversation has to be in one task. A conversation
whose whole hash is a proper prefix hash of a longer one is dropped by an anti-join; of
equal ones the smallest conv_id stays. Hashes are made distinct before they are shuffled
to the join, so a first turn or a conversation that a third of all share costs one row a task.

The maximal conversations are rendered: turns in order, in one text for each part of
`PART` turns (one part for all but very long conversations).

Cases: a null role or text is told from an empty one when compared and rendered as empty;
turns are ordered by turn (null first), role, text, and rows that repeat a turn are turns;
a null conv_id is dropped; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a block of the rolling hash, and of a rendered part.
PART = 256
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"


def _block(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / PART), F.lit(-1)).cast("bigint")


def _hashed(turns: DataFrame) -> DataFrame:
    """conv, block, at (1 for a conversation's first turn), and the turn's two hashes."""
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").where("conv IS NOT NULL").withColumn("block", _block(F.col("turn")))
    counts = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first"))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("inner", F.row_number().over(order)).join(counts, ["conv", "block"])
    at = (F.col("first") + F.col("inner")).alias("at")
    said = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("role", "text")])
    rows = rows.select("conv", "block", "inner", at, "role", "text", F.sha2(said, 256).alias("said"))
    return rows.select("conv", "block", "inner", "at", "role", "text", F.xxhash64("at", "said").alias("h1"), F.xxhash64("said", "at", F.lit(1)).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies (conversations equal to it, itself included) of those that stay."""
    rows = stored(_hashed(turns).select("conv", "block", "inner", "at", "h1", "h2"), "chat-hashes")
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count(F.lit(1)).alias("n"))
    whole = blocks.groupBy("conv").agg(F.bit_xor("b1").alias("k1"), F.bit_xor("b2").alias("k2"), F.sum("n").alias("k"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).cast("bigint").alias(b) for b in ("b1", "b2")])
    inside = Window.partitionBy("conv", "block").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
    rolling = rows.select("conv", "block", "at", *[F.bit_xor(h).over(inside).alias(h) for h in ("h1", "h2")]).join(blocks, ["conv", "block"])
    prefixes = rolling.join(whole.select("conv", "k"), "conv").where("at < k")
    prefixes = prefixes.select(F.col("at").alias("k"), F.col("h1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("k2")).distinct()
    one = whole.groupBy("k", "k1", "k2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    return one.join(prefixes, ["k", "k1", "k2"], "left_anti").select("conv", F.col("k").alias("n_turns"), "n_copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the maximal conversations, rendered."""
    kept = stored(maximal(turns), "chat-kept")
    rows = _hashed(turns).select("conv", "at", "role", "text").join(kept, "conv")
    head, middle = TEMPLATE.split("{role}")
    middle, tail = middle.split("{text}")
    said = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))
    part = F.floor((F.col("at") - 1) / PART).alias("part")
    texts = rows.groupBy(F.col("conv").alias("conv_id"), part, "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))).alias("all"))
    return texts.select("conv_id", "part", "n_turns", "n_copies", F.array_join("all.said", "").alias("text"))
