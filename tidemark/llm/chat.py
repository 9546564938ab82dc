"""Chat formatting: multi-party perspective rotation.

Each conversation is rendered once from the view of every participant (every
speaker but ``system``): that speaker becomes the assistant, the others become
users with their names, and only the assistant's own words are trained on. The
result is a row for each turn of each rendering, in pieces whose places in the
whole rendering are given, so that no conversation is gathered into one row.

Places are running lengths within parts of blocks of ``BLOCK`` turn numbers, plus
the lengths before, so one long conversation is spread over tasks, as are many
turns of one number. Names are printed with ``_`` for runs of other characters
than letters, digits, ``_``, ``.`` and ``-``, so two roles that differ in those
only are printed alike; they stay two participants.

Edge cases: a null text is empty; a null role is a speaker called ``unknown``;
null conversation ids form one conversation; null turns come first; equal turn
numbers are ordered by role and the MD5 of the rendered turn; repeated rows are repeated turns; a
conversation of system turns only has no participant and gives no row; control
marks inside a text are broken up; an empty table gives an empty result; only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 256


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(text_of(), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
    )


def _header(role: Column, perspective: Column) -> Column:
    name = F.regexp_replace(role, "[^A-Za-z0-9_.-]+", "_")
    who = F.when(role == "system", F.lit("system")).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def pieces(conversations: DataFrame) -> DataFrame:
    """Every turn from every participant's view: conv_id, perspective, turn, role, piece, head (its length), trained.

    Turns meet the distinct speakers of their conversation, a table that is
    combined before its shuffle; Spark can split a long conversation's side of
    this join.
    """
    turns = _turns(conversations)
    speakers = turns.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    both = turns.join(speakers, turns["conv_id"].eqNullSafe(speakers["c"]))
    head = _header(F.col("role"), F.col("perspective"))
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        F.concat(head, "text", F.lit(CLOSE)).alias("piece"),
        F.length(head).alias("head"),
        (F.col("role") == F.col("perspective")).alias("trained"),
    )


def placed(rendered: DataFrame, length: str) -> DataFrame:
    """``rendered`` (with ``piece_md5``) with ``start`` and ``end`` of each piece in the whole rendering.

    A piece's place is its running length within its part, plus the lengths of
    the parts before in its block, plus those of the blocks before. A part is a
    turn, a role and the first digits of the digest, so that turns of one number,
    or without one, are spread over parts however many they are.
    """
    whole, block, part = ["conv_id", "perspective"], ["block"], ["turn_", "role", "digits"]
    rows = rendered.withColumn("turn_", F.coalesce("turn", F.lit(-(1 << 63)))).withColumn("block", F.floor(F.col("turn_") / BLOCK)).withColumn("digits", F.left("piece_md5", F.lit(2)))
    inside = W.partitionBy(*whole, *block, *part).orderBy("piece_md5").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(length).over(inside))
    parts = rows.groupBy(*whole, *block, *part).agg(F.sum(length).alias("n"))
    earlier = W.partitionBy(*whole, *block).orderBy(*part).rowsBetween(W.unboundedPreceding, -1)
    blocks = parts.groupBy(*whole, *block).agg(F.sum("n").alias("n"))
    before = W.partitionBy(*whole).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("block_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for table_, keys, name in ((parts, [*whole, *block, *part], "before"), (blocks, [*whole, *block], "block_before")):
        other = table_.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        same = F.lit(True)
        for k in keys:
            same &= rows[k].eqNullSafe(other[f"_{k}"])
        rows = rows.join(other, same).drop(*[f"_{k}" for k in keys])
    end = F.col("end") + F.col("before") + F.col("block_before")
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col(length)).drop("turn_", "block", "digits", "before", "block_before")


def render(conversations: DataFrame) -> DataFrame:
    """The pieces with their places and masks; ``mask_start`` to ``mask_end`` is trained on (equal: nothing)."""
    rows = pieces(conversations).withColumn("size", F.length("piece").cast("long")).withColumn("piece_md5", F.md5("piece"))
    return _masked(placed(rows, "size")).drop("piece_md5")


def _masked(rows: DataFrame) -> DataFrame:
    """The closing mark is trained on as well, so that the model learns to stop."""
    start = F.when(F.col("trained"), F.col("start") + F.col("head")).otherwise(F.col("end"))
    return rows.withColumn("mask_start", start.cast("long")).withColumn("mask_end", F.col("end"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(table(spark, sf_dir, "conversations")).withColumn("size", F.length("piece").cast("long")).withColumn("piece_md5", F.md5("piece")).drop("piece")
    return _masked(placed(rows, "size")).select("conv_id", "perspective", "turn", "role", "start", "end", "mask_start", "mask_end", "piece_md5")


QUERIES = {"op8_perspective_rotation": op8_perspective_rotation}
ORACLES = {
    "op8_perspective_rotation": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), p AS (
  SELECT t.conv_id, perspective, turn, role, text, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
           ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_.-]+', '_', 'g') END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), q AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM p
), r AS (
  SELECT *, md5(piece) AS piece_md5, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, md5(piece) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM q
)
SELECT conv_id, perspective, turn, role, "end" - length(piece) AS start, "end",
       CASE WHEN role = perspective THEN "end" - length(piece) + length(head) ELSE "end" END AS mask_start, "end" AS mask_end, piece_md5
FROM r"""
}
