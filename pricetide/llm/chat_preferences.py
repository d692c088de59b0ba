"""Preference formatting: one prompt for the turns that two conversations share, two completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What stands around a turn's text, and the role whose text is learnt.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


_PARTS = ("prompt", "chosen", "rejected")
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _side(turns: DataFrame, pair_id: str, side: str) -> DataFrame:
    """The turns of one side; null roles and texts are empty."""
    return turns.where(F.col(pair_id).isNotNull()).select(
        F.col(pair_id).alias("pair"),
        F.lit(side).alias("side"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _rendered(turn: F.Column) -> F.Column:
    """A turn with its place as text, the length of its head, and whether its text is learnt."""
    head = F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))
    return F.struct(
        F.col("place"),
        F.concat(head, turn["text"], F.lit(TAIL)).alias("body"),
        F.length(head).alias("head"),
        (turn["role"] == LEARNT).alias("learnt"),
    )


def _mask(each: F.Column) -> F.Column:
    """The spans of learnt texts, and what ends them, in turns that are joined in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(so_far: F.Column, turn: F.Column) -> F.Column:
        end = so_far["at"] + F.length(turn["body"])
        span = F.struct((so_far["at"] + turn["head"]).cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(
            end.alias("at"), F.when(turn["learnt"], F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans")
        )

    return F.aggregate(each, start, add)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """Format pairs of conversations, given as turns (pair_id, turn, role, text).

    A row for each id that both have: `prompt`, the turns that both begin with, rendered once;
    `chosen` and `rejected`, the turns after those; their masks, spans in code points of the
    completion that a loss should count (the assistant's texts and what ends them, without the
    head of the turn); and the number of turns of all three.

    Turns are ordered by number, null before all others; turns with the same number by role and
    text. Null roles and texts are empty. Rows without an id belong to no pair, an id that one
    side lacks is left out, and equal conversations have empty completions. Other columns play
    no part. The turns of both sides are shuffled once, by pair; a pair is gathered because its
    turns are rendered into one row.
    """
    both = _side(chosen, pair_id, "chosen").unionByName(_side(rejected, pair_id, "rejected")).repartition("pair")
    same = Window.partitionBy("pair", "turn", "side").orderBy("role", "text")
    placed = both.withColumn("nth", F.row_number().over(same)).withColumn("place", F.struct("turn", "nth"))
    said = F.struct("role", "text")
    met = placed.groupBy("pair", "place").agg(*(F.max(F.when(F.col("side") == s, said)).alias(s) for s in ("chosen", "rejected")))
    whole = Window.partitionBy("pair")
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    met = met.select(
        "*",
        F.min(F.when(differs, F.col("place"))).over(whole).alias("first"),
        *(F.max(F.col(s).isNotNull()).over(whole).alias(f"in_{s}") for s in ("chosen", "rejected")),
    ).where("in_chosen AND in_rejected")
    shared = F.col("first").isNull() | (F.col("place") < F.col("first"))
    turns = {
        "prompt": F.when(shared, _rendered(F.col("chosen"))),
        "chosen": F.when(~shared & F.col("chosen").isNotNull(), _rendered(F.col("chosen"))),
        "rejected": F.when(~shared & F.col("rejected").isNotNull(), _rendered(F.col("rejected"))),
    }
    listed = met.groupBy("pair").agg(*(F.sort_array(F.collect_list(c)).alias(p) for p, c in turns.items()))
    return listed.select(
        F.col("pair").alias(pair_id),
        *(F.array_join(F.col(f"{p}.body"), "").alias(p) for p in _PARTS),
        *(_mask(F.col(p)).alias(f"{p}_mask") for p in ("chosen", "rejected")),
        *(F.size(p).cast("long").alias(f"{p}_turns") for p in _PARTS),
    )


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from `conversations` (conv_id, turn, role, text).

    The chosen one is the whole conversation; the rejected one has in place of its last reply
    the last reply of the mate (2k and 2k + 1 are mates), or none if the mate has none. A
    conversation without a reply is the same on both sides, so it gives a prompt and two empty
    completions. Of replies of the same turn the last by text counts, and it takes the place of
    all of them. A null turn number comes before all others. Rows without an id are left out.
    Other columns play no part.
    """
    last = (
        conversations.where((F.col("role") == LEARNT) & F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("reply"))
    )
    named = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    columns = [F.col("conv_id").alias("pair_id"), "turn", "role", "text"]
    replied = F.col("has_reply").isNotNull() & F.col("turn").eqNullSafe(F.col("reply_turn")) & F.col("role").eqNullSafe(F.lit(LEARNT))
    at = last.select("conv_id", F.col("reply.turn").alias("reply_turn"), F.lit(True).alias("has_reply"))
    others = named.join(at, "conv_id", "left").where(~replied).select(*columns)
    mates = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply.text").alias("text"))
    swapped = last.select("conv_id", "reply.turn").join(mates, "conv_id")
    reply = swapped.select(F.col("conv_id").alias("pair_id"), "turn", F.lit(LEARNT).alias("role"), "text")
    return named.select(*columns), others.unionByName(reply)
