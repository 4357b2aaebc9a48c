"""Chat formatting after cumulative-snapshot collapse.

Loggers store a conversation again after every turn; all but the last snapshot are prefixes of
longer ones. The rolling hash of a conversation's first turns is the XOR of two 64-bit hashes of
each (turn, role, text): a conversation whose whole hash, with its number of turns, is the prefix
hash of a longer one goes by an anti-join; of equal conversations the one with the smallest id
stays. What remains is rendered.

Only DataFrame functions. Rolling hashes are taken in two levels, within chunks of ``CHUNK`` turn
numbers and over the chunks' totals, so one conversation with a third of all turns is spread over
tasks; rendered text comes in parts of ``PART`` turns.

Defined results: repeated rows of one conversation count once; turns go by number (null first),
then role, then text; null role or text differs from empty but is rendered empty; rows without
conversation id form one conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

CHUNK = 1024
PART = 512
_NO_ID = -(1 << 63)
_HASHES = ("h1", "h2")


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their two hashes and their chunk."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).distinct()
    content = [F.coalesce("turn", F.lit(_NO_ID)), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(_NO_ID))
    return rows.withColumns({"h1": F.xxhash64(F.lit(1), *content), "h2": F.xxhash64(F.lit(2), *content), "chunk": chunk})


def _rolling(turns: DataFrame) -> DataFrame:
    """Per turn: its position, and the hashes of the conversation up to it."""
    within = W.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    totals = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("count"), *[F.bit_xor(h).alias(h) for h in _HASHES])
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select("conv_id", "chunk", F.coalesce(F.sum("count").over(before), zero).alias("first"), *[F.coalesce(F.bit_xor(h).over(before), zero).alias(f"{h}_before") for h in _HASHES])
    local = turns.withColumn("local", F.count(F.lit(1)).over(within)).withColumns({f"{h}_local": F.bit_xor(h).over(within) for h in _HASHES})
    joined = local.join(offsets, ["conv_id", "chunk"])
    hashes = [F.col(f"{h}_before").bitwiseXOR(F.col(f"{h}_local")).alias(h) for h in _HASHES]
    return joined.select("conv_id", "role", "text", (F.col("first") + F.col("local")).alias("position"), *hashes)


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, position, n_turns, role, text) of the conversations that no longer or equal one stands for."""
    turns = stored(_turns(conversations), "chat-turns")
    rolling = stored(_rolling(turns), "chat-rolling")
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), *[F.bit_xor(h).alias(h) for h in _HASHES])
    first = whole.groupBy("n_turns", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    prefixes = rolling.join(whole.select("conv_id", "n_turns"), "conv_id").where("position < n_turns")
    prefixes = prefixes.select(F.col("position").alias("n_turns"), *_HASHES).distinct()
    kept = first.join(prefixes, ["n_turns", *_HASHES], "left_anti").select("conv_id", "n_turns")
    return rolling.drop(*_HASHES).join(kept, "conv_id")


def formatted_chats(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation) and rendered, the text of up to ``PART`` turns.

    The parts of a conversation, put together in order, are its rendered text.
    """
    turns = maximal_conversations(conversations)
    rendered = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing + "\n"))
    part = F.floor((F.col("position") - 1) / PART).cast("long")
    lines = F.sort_array(F.collect_list(F.struct("position", rendered.alias("line"))))
    out = turns.groupBy("conv_id", part.alias("part")).agg(F.max("n_turns").alias("n_turns"), F.concat_ws("", F.transform(lines, lambda x: x["line"])).alias("rendered"))
    return out.select(F.when(F.col("conv_id") != _NO_ID, F.col("conv_id")).alias("conv_id"), "part", "n_turns", "rendered")
