"""Chat formatting: every participant's perspective on a dialogue of several parties.

Each dialogue is rendered once for every participant. That speaker's turns become
``assistant`` turns and are the targets of the loss; everybody else's become ``user`` turns
that carry the speaker's name; turns of ``context_roles`` stay what they are. One row comes
out for each turn and perspective: the rendered segment, where it starts in the rendered
dialogue, and the span of it that the loss covers (the words and the closing mark). Segments
of a perspective, concatenated by ``position``, are the dialogue; they are kept apart so
that no dialogue, however long, is gathered in one task.

Offsets are two-level prefix sums: within blocks of ``block`` turn numbers, and over the
blocks' totals.

Defined results: null text counts as empty; a null or empty role speaks as a nameless user
and is no participant; a null conversation id is a conversation of its own; null turns come
first; repeated turns are all kept, ordered by role and text; a dialogue without
participants gives no rows; marks inside a text or name are broken up and line feeds in a
name become spaces, so that neither can open or close a turn; a dialogue may be of any
length; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    context_roles: tuple[str, ...] = ("system",),
    block: int = 64,
) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, segment, start, length, target, mask_start, mask_length."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("name"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    context = F.col("name").isin(*context_roles)
    people = turns.filter(~context & (F.col("name") != "")).select(F.col("conv_id").alias("of"), F.col("name").alias("perspective")).distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    target = F.col("name") == F.col("perspective")
    role = F.when(context, F.col("name")).when(target, F.lit("assistant")).otherwise(F.lit("user"))
    named = F.when(context | target | (F.col("name") == ""), F.lit("")).otherwise(F.concat(F.lit(" name="), F.regexp_replace(F.replace("name", F.lit("<|"), F.lit("< |")), "[\r\n]", " ")))
    seen = seen.select(
        "conv_id", "perspective", "turn", role.alias("role"), "name", target.alias("target"), "text",
        F.concat(F.lit(OPEN), role, named, F.lit("\n")).alias("head"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long").alias("block"),
    )
    seen = seen.withColumn("segment", F.concat("head", "text", F.lit(CLOSE + "\n"))).withColumn("length", F.length("segment").cast("long"))
    own = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "name", "text")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.select(
        "*", F.row_number().over(own).cast("long").alias("nth"), (F.sum("length").over(so_far) - F.col("length")).alias("within"),
    )
    before = Window.partitionBy("b_conv", "b_perspective").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        seen.groupBy(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_perspective"), F.col("block").alias("b_block"))
        .agg(F.count("*").alias("turns"), F.sum("length").alias("chars"))
        .select("b_conv", "b_perspective", "b_block", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_perspective")) & (F.col("block") == F.col("b_block"))
    start = F.col("chars") + F.col("within")
    return seen.join(blocks, same).select(
        "conv_id", "perspective", (F.col("turns") + F.col("nth") - 1).cast("long").alias("position"), "turn", "role", "name", "segment",
        start.cast("long").alias("start"), "length", "target",
        F.when(F.col("target"), start + F.length("head")).cast("long").alias("mask_start"),
        F.when(F.col("target"), F.length("text") + F.lit(len(CLOSE))).cast("long").alias("mask_length"),
    )


PERSPECTIVES_SQL = """
WITH turns AS (
    SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS name, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), people AS (
    SELECT DISTINCT conv_id, name AS perspective FROM turns WHERE name NOT IN ('system', '')
), seen AS (
    SELECT t.conv_id, perspective, turn, name, text, name = perspective AS target,
        CASE WHEN name = 'system' THEN name WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN name IN ('system', '') OR name = perspective THEN '' ELSE ' name=' || replace(replace(replace(name, '<|', '< |'), chr(10), ' '), chr(13), ' ') END AS named
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), made AS (
    SELECT *, '<|im_start|>' || role || named || chr(10) AS head, '<|im_start|>' || role || named || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM seen
), placed AS (
    SELECT *, length(segment) AS length, row_number() OVER w - 1 AS position, (sum(length(segment)) OVER w - length(segment))::BIGINT AS start
    FROM made WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, role, name, segment, start, length, target,
    CASE WHEN target THEN start + length(head) END AS mask_start, CASE WHEN target THEN length(text) + 10 END AS mask_length
FROM placed
"""
