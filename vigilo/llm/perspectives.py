"""Multi-party perspective rotation of dialogues (operator 6, DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with
that participant as ``assistant``; the other participants become ``user``
turns that carry their name, system turns stay ``system``.  The result has one
row per rendered turn: its text, its place in the rendered dialogue (turn
number and character range) and the character range that is trained on (the
speaker's own words and the end mark).  Concatenating ``segment`` in order of
``position`` gives the dialogue, so no conversation ever has to fit one row.

Running positions come from block totals: turns are dealt to blocks of
``BLOCK`` turn numbers, so a conversation of any length is spread over many
groups and only its block totals (one row per block) are ordered together.

Defined results: turns are ordered by turn number, then role, then text, nulls
first; a null text is an empty turn; a null role is an unnamed user and no
participant; a conversation without participants gives no rows; a null
conversation id is one conversation; repeated rows are repeated turns; an
empty table gives an empty result; control marks inside a text are defused by
a space; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64
# Fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _header(role: Column, perspective: Column) -> Column:
    name = F.regexp_replace(F.coalesce(role, F.lit("")), r"[^0-9A-Za-z_.-]", "_")
    return F.concat(F.lit(START),
                    F.when(role.eqNullSafe(perspective), "assistant").when(role.eqNullSafe(SYSTEM), SYSTEM)
                    .when(role.isNull(), "user").otherwise(F.concat(F.lit("user name="), name)),
                    F.lit("\n"))


def _defused(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id, perspective, position, turn, role, segment, char_start,
    char_end, trained, mask_start, mask_end``; the masks of a turn that is not
    trained on are null."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2 ** 62))))
    speakers = (t.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM))
                .select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct())
    s = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    trained = F.col("role").eqNullSafe(F.col("perspective"))
    s = (s.withColumn("header", _header(F.col("role"), F.col("perspective")))
         .withColumn("body", _defused(F.col("text")))
         .withColumn("segment", F.concat("header", "body", F.lit(END + "\n")))
         .withColumn("trained", trained))
    totals = s.groupBy("conv_id", "perspective", "block").agg(
        F.sum(F.length("segment")).alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"))
    s = s.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p"))
               & (F.col("block") == F.col("b"))).drop("c", "p", "b")
    inside = (Window.partitionBy("conv_id", "perspective", "block")
              .orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = (F.col("chars_before") + F.sum(F.length("segment")).over(inside)).alias("char_end")
    s = s.select("conv_id", "perspective", (F.col("turns_before") + F.count("*").over(inside) - 1).alias("position"),
                 "turn", "role", "segment", "trained", F.length("header").alias("head"), end)
    start = F.col("char_end") - F.length("segment")
    return s.select("conv_id", "perspective", "position", "turn", "role", "segment",
                    start.alias("char_start"), "char_end", "trained",
                    F.when(F.col("trained"), start + F.col("head")).alias("mask_start"),
                    F.when(F.col("trained"), F.col("char_end") - 1).alias("mask_end"))
