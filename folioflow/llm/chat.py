"""Chat formatting by perspective rotation: each participant once as the assistant.

For every participant of a conversation the dialogue is rendered with that speaker's turns as the
assistant's, the others' as turns of named users, context roles (`system`) as they are.
The mask lists the character spans (start:end) of the assistant's contents, the part to be learned.

One shuffle pairs turns with participants by conversation; the rest is a running sum and an
aggregation by (conversation, participant). No pair of turns is formed. A rendered dialogue is one value of
one row, so it must fit in memory.

A mark that a role or a text holds (`<|`) is written `< |`, so that no content opens or closes a turn.

Edge cases: a null text counts as empty; a null role is the participant `unknown`; turns go by turn
(null first), then role and text, so ties and repeated rows have a defined place; a turn without conversation id
belongs to no other, it is a conversation of its own; a conversation of context roles only has no row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import read_table

CONTEXT = ("system",)
CLOSE = "<|end|>\n"


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(conv_id, speaker, n_turns, n_learned, text, mask) for every participant."""
    plain = lambda name, absent: F.replace(F.coalesce(name, F.lit(absent)), F.lit("<|"), F.lit("< |")).alias(name)
    every = turns.select("conv_id", "turn", plain("role", "unknown"), plain("text", ""))
    rows = every.where("conv_id IS NOT NULL")
    speakers = rows.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    both = rows.join(speakers, rows["conv_id"] == speakers["conv"]).drop("conv")
    own = F.col("role") == F.col("speaker")
    opening = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role").isin(*context), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    pieces = both.withColumn("own", own).withColumn("opening", opening).withColumn("piece", F.concat("opening", "text", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id", "speaker").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = pieces.withColumn("at", F.row_number().over(order)).withColumn("before", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece"))
    start = F.col("before") + F.length("opening")
    span = F.when(F.col("own"), F.concat(start.cast("string"), F.lit(":"), (start + F.length("text")).cast("string")))
    told = placed.withColumn("span", span).groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "span"))).alias("t"), F.count("*").alias("n_turns"), F.count_if("own").alias("n_learned"))
    head = "<|assistant|>\n"
    mask = F.concat(F.lit(f"{len(head)}:"), (F.length("text") + len(head)).cast("string"))
    lone = every.where(F.col("conv_id").isNull() & ~F.col("role").isin(*context)).select(
        "conv_id", F.col("role").alias("speaker"), F.lit(1).cast("long").alias("n_turns"), F.lit(1).cast("long").alias("n_learned"), F.concat(F.lit(head), "text", F.lit(CLOSE)).alias("text"), mask.alias("mask")
    )
    return told.select(
        "conv_id",
        "speaker",
        "n_turns",
        "n_learned",
        F.array_join(F.col("t.piece"), "").alias("text"),
        F.array_join(F.filter(F.col("t.span"), lambda s: s.isNotNull()), ",").alias("mask"),
    ).unionByName(lone)


def op8_perspective_rotation(spark, sf_dir):
    return rotate(read_table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS own,
    CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || t.role || '|>' || chr(10) END AS opening
  FROM t JOIN s ON t.conv_id = s.conv_id
), q AS (
  SELECT *, opening || text || '<|end|>' || chr(10) AS piece, row_number() OVER w AS pos,
    (sum(length(opening || text || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
      - length(opening || text || '<|end|>' || chr(10)) AS before
  FROM p WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_learned, string_agg(piece, '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(before + length(opening) AS BIGINT) || ':' || CAST(before + length(opening) + length(text) AS BIGINT) END, ',' ORDER BY pos), '') AS mask
FROM q GROUP BY conv_id, speaker
UNION ALL
SELECT conv_id, role, 1, 1, '<|assistant|>' || chr(10) || text || '<|end|>' || chr(10), '14:' || (14 + length(text)) FROM t WHERE conv_id IS NULL AND role <> 'system'"""

QUERIES = {"op8_perspective_rotation": op8_perspective_rotation}
ORACLES = {"op8_perspective_rotation": SQL}
