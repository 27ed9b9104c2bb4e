"""Operator 6, chat formatting: cumulative snapshots collapse into the longest conversation, which is then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What names a conversation: its id, or for a turn without one the digest of its content.
CONVERSATION = ("conv_id", "alone")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, alone, turn, role, text, digest) with null roles and texts empty; of equal turns without a conversation one."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    named = turns.filter("conv_id is not null").withColumn("alone", F.lit(""))
    single = turns.filter("conv_id is null").groupBy("role", "digest").agg(F.first("text").alias("text"), F.min("turn").alias("turn"), F.first("conv_id").alias("conv_id"))
    return named.unionByName(single.withColumn("alone", F.concat("digest", "role")).select(named.columns))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, alone, n_turns) of the conversations that are neither a prefix of a longer one nor a copy of an earlier one.

    A conversation's rolling hash at a place is the exclusive or of 128-bit hashes of place and content up to it.
    Prefixes and whole conversations are reduced to distinct ones before they are compared, so that copies of one
    conversation, however many, don't meet in a join; texts aren't sorted or shuffled here, their digests are.
    """
    order = Window.partitionBy(*CONVERSATION).orderBy(F.col("turn").asc_nulls_last(), "role", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select(*CONVERSATION, "turn", "role", "digest").withColumn("place", F.row_number().over(order))
    rolling = lambda *seed: F.bit_xor(F.xxhash64("place", *seed, "role", "digest")).over(so_far)
    states = placed.withColumns({"k1": rolling(), "k2": rolling(F.lit(1)), "whole": F.lead("place").over(order).isNull()})
    states = written(states.select(*CONVERSATION, "place", "k1", "k2", "whole"), "prefixes")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), *CONVERSATION)).alias("c")
    whole = states.filter("whole").groupBy("place", "k1", "k2").agg(first)
    proper = states.filter("not whole").select("place", "k1", "k2").distinct()
    return whole.join(proper, ["place", "k1", "k2"], "left_anti").select("c.conv_id", "c.alone", F.col("place").cast("long").alias("n_turns"))


def collapsed_chats(conversations: DataFrame) -> DataFrame:
    """Return conv_id, n_turns and the rendered text of every maximal conversation.

    Turns go by number, nulls last, then role and the MD5 of their text; repeated rows are turns of their own. Null
    roles and texts count as empty. A turn with a null conversation id is a conversation by itself, with a null id in
    the result; copies of it collapse like those of any other, and it goes where it begins a longer one. Of copies
    the smallest id stays. A rendered conversation is one row, so it must fit into one, a very long text too. An
    empty table gives an empty one; further columns are left out, whatever their names.
    """
    turns = _turns(conversations)
    kept = written(maximal_conversations(turns), "maximal").select(F.col("conv_id").alias("id_"), F.col("alone").alias("alone_"), "n_turns")
    said = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("id_")) & (F.col("alone") == F.col("alone_")))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    # Nulls sort first in arrays, so a flag puts turns without a number last.
    parts = F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "digest", line.alias("line"))))
    return said.groupBy(*CONVERSATION, "n_turns").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text")).drop("alone")
