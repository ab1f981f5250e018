"""Chat rendering from every participant's side.

For each conversation and each participant (distinct roles but system) the dialogue is rendered with that
speaker as assistant, the others as named users, and a mask over what the assistant says. A rendering is kept
as its segments, one row per turn with its place in the whole, so that a conversation of any length is spread
over tasks: places are global running sums over range-partitioned rows minus the start of the dialogue.

Defined cases: a null role is the participant "unknown"; a null text is empty; null turns come first and ties
of one turn are ordered by role, then text digest, then text; rows with null conv_id form one conversation;
repeated rows are repeated turns; a conversation of system turns only has no participant and gives no rows.
Turn markers inside a text are broken by a space. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import ranking

# The turn markers.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, role, header, segment, is_target, n_chars) of every turn and participant."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), _safe(F.col("text")).alias("said"))
    people = rows.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    target = F.col("role") == F.col("perspective")
    name = F.when(target, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), _safe(F.col("role"))))
    header = F.concat(F.lit(OPEN), name, F.lit("\n"))
    segment = F.concat(header, "said", F.lit(CLOSE + "\n"))
    return seen.select(
        "conv_id", "perspective", "turn", "role", F.length(header).cast("long").alias("header"), segment.alias("segment"),
        target.alias("is_target"), F.length(segment).cast("long").alias("n_chars"))


def rotated(turns: DataFrame) -> DataFrame:
    """Segments with start and end in the rendering of their perspective, and mask_start, mask_end (null if unmasked)."""
    rows = segments(turns).withColumn("_tie", F.xxhash64("segment"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "perspective", "turn", "role", "_tie", "segment")]
    placed = ranking.running_totals(rows, order, {"_upto": "n_chars"}).withColumn("_from", F.col("_upto") - F.col("n_chars"))
    begin = placed.groupBy("conv_id", "perspective").agg(F.min("_from").alias("_begin")).toDF("_conv", "_who", "_begin")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who"))
    start = F.col("_from") - F.col("_begin")
    end = start + F.col("n_chars")
    return placed.join(begin, same).select(
        "conv_id", "perspective", "turn", "role", "is_target", "segment", start.alias("start"), end.alias("end"),
        F.when(F.col("is_target"), start + F.col("header")).alias("mask_start"), F.when(F.col("is_target"), end - 1).alias("mask_end"))
