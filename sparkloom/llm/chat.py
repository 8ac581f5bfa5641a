"""Multi-party perspective rotation: every dialogue, once per participant, with that speaker as the assistant.

A participant is a distinct non-system role of a conversation. In each perspective the participant's
turns bear the assistant header and the loss; the others are users who keep their names; system turns
stay system turns. The result has a row per perspective and turn: the rendered segment, where it stands
in the rendered dialogue, and the span of it that bears loss. A dialogue is its segments in the order of
``position``; offsets are counted, so nobody has to join a whole dialogue together.

Offsets are prefix sums in two levels. The turns of the whole table are sorted into ranges of about equal size by
conversation and place; a conversation of any length, whatever its turn numbers, is spread over as many ranges
as it fills. Sums over the ranges come first, then sums within a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed: what begins and ends a turn.
START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, position, turn, role, speaker, n_rows, segment, char_start, mask_start, mask_end, has_marker).

    ``mask_start`` and ``mask_end`` are characters of the rendered dialogue that bear loss, equal where
    none does. Rows that agree in conversation, turn, role and text are one turn with ``n_rows`` of them.
    Turns of one number stand in the order of role and text. A null text is empty, a null role is the
    speaker "unknown", null conversations and turns are a conversation and a turn (before all others).
    A conversation of system turns alone has no participant and so no rows. Line breaks of a name become spaces
    in its header. Texts are rendered as they are; ``has_marker`` tells a turn whose text or name holds a turn's
    marker itself, so that it can be left out. Other columns are not read.
    """
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("n_rows"))
    # the ranges are fixed when they are written: all sums below must see the same ones
    base = stored(base.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "speaker", "text").withColumn("block", F.spark_partition_id()), "turns")
    people = base.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own, sys = F.col("speaker") == F.col("perspective"), F.col("speaker") == system
    header = F.when(sys, F.lit(START + "system\n")).when(own, F.lit(START + "assistant\n")).otherwise(F.concat(F.lit(START + "user name="), F.regexp_replace("speaker", "[\r\n]+", " "), F.lit("\n")))
    rows = (
        base.alias("b").join(people.alias("p"), F.col("b.conv_id").eqNullSafe(F.col("p.conv_id")))
        .select("b.conv_id", "p.perspective", "b.turn", "b.speaker", "b.n_rows", "b.text", "b.block")
        .withColumn("head", F.length(header)).withColumn("segment", F.concat(header, "text", F.lit(END + "\n")))
        .withColumn("own", own).withColumn("role", F.when(sys, "system").when(own, "assistant").otherwise("user"))
        .withColumn("size", F.length("segment").cast("long"))
        .withColumn("has_marker", sum((F.contains(c, F.lit(m)).cast("int") for c in (F.col("text"), F.col("speaker")) for m in (START, END)), F.lit(0)) > 0)
    )
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "perspective", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    r = rows.withColumn("nth", F.row_number().over(inside)).withColumn("so_far", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("conv_id", "perspective", "block")]
    start = F.col("chars_before") + F.col("so_far")
    mask = start + F.col("head")
    return r.join(blocks.alias("k"), same[0] & same[1] & same[2]).select(
        "r.conv_id", "r.perspective", (F.col("turns_before") + F.col("nth") - 1).alias("position"), "r.turn", "r.role", "r.speaker", "r.n_rows", "r.segment",
        start.alias("char_start"), mask.alias("mask_start"),
        F.when(F.col("own"), start + F.col("size") - 1).otherwise(mask).alias("mask_end"), "r.has_marker",
    )


#: The same rows by plain window sums.
ORACLE = r"""
WITH b AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, count(*) AS n_rows
           FROM conversations GROUP BY 1, 2, 3, 4),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM b WHERE speaker <> 'system'),
h AS (SELECT b.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM b JOIN p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, CASE WHEN role = 'user' THEN '<|im_start|>user name=' || regexp_replace(speaker, '[\r\n]+', ' ', 'g') || chr(10) ELSE '<|im_start|>' || role || chr(10) END AS head FROM h),
t AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s),
w AS (SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(segment)) OVER o AS BIGINT) - length(segment) AS char_start FROM t
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, speaker, n_rows, segment, char_start, char_start + length(head) AS mask_start,
       CASE WHEN role = 'assistant' THEN char_start + length(segment) - 1 ELSE char_start + length(head) END AS mask_end,
       contains(text || chr(0) || speaker, '<|im_start|>') OR contains(text || chr(0) || speaker, '<|im_end|>') AS has_marker
FROM w
"""
