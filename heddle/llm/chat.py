"""Multi-party perspective rotation: every participant's view of a dialogue, with the masks to train on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are numbered together; a long conversation is many such stretches.
STRETCH = 1024
#: Role of turns that belong to nobody's part.
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of a speaker's name that are percent-encoded; the percent sign first.
ESCAPED = "%<>|\n\r"


def rotate(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Render each conversation once for each of its participants.

    In a participant's rendering that speaker is ``assistant``, every other one ``user name=<speaker>``,
    and system turns stay ``system``. A rendering is the concatenation of its segments by ``position``;
    each row is one segment with its place (code points, from 0) in the rendering, and the span to train
    on: text and end mark of the assistant's turns, null elsewhere.

    Places are prefix sums: turns meet their conversation's participants, and lengths are summed, by stretches of
    STRETCH turns, so the size of a conversation does not bound what one task reads, and no text is collected.

    Null conversations are one conversation; null turns come first; null roles speak as ``%null``; null texts
    are empty. In a speaker's name ``%``, ``<``, ``>``, ``|`` and line ends are percent-encoded, so different
    names stay different; a text's ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``), so no text can open
    or close a turn and every text can be had back. Turns that tie are ordered by role and text (turns with
    one number share a stretch); repeated rows are repeated turns. Conversations with system turns
    only have no participant and no rendering. An empty table gives an empty result; other columns are
    not read.

    Returns: conv_id, perspective, position, turn, speaker, rendered_role, segment, start, stop, trained,
    loss_start, loss_stop.
    """
    speaker = F.col(role)
    for mark in ESCAPED:
        speaker = F.replace(speaker, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    turns = conversations.select(
        F.col(conv).alias("_c"),
        F.col(turn).cast("long").alias("_t"),
        F.coalesce(speaker, F.lit("%null")).alias("_s"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<(\\*)\|", r"<$1\\|").alias("_x"),
    ).withColumn("_stretch", F.coalesce(F.floor(F.col("_t") / STRETCH), F.lit(-(1 << 62))))
    parts = turns.where(F.col("_s") != SYSTEM).select(F.col("_c").alias("_pc"), F.col("_s").alias("perspective")).distinct()
    places = turns.select(F.col("_c").alias("_qc"), F.col("_stretch").alias("_qs")).distinct()
    met = places.join(parts, F.col("_qc").eqNullSafe(F.col("_pc"))).drop("_pc")
    views = turns.join(met, F.col("_c").eqNullSafe(F.col("_qc")) & (F.col("_stretch") == F.col("_qs"))).drop("_qc", "_qs")
    shown = (
        F.when(F.col("_s") == SYSTEM, F.lit(SYSTEM))
        .when(F.col("_s") == F.col("perspective"), F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.col("_s")))
    )
    views = views.withColumn("rendered_role", shown)
    head = F.concat(F.lit(OPEN), F.col("rendered_role"), F.lit("\n"))
    views = views.withColumn("segment", F.concat(head, F.col("_x"), F.lit(CLOSE + "\n")))

    keys = ["_c", "perspective", "_stretch"]
    sums = views.groupBy(*keys).agg(F.sum(F.length("segment")).alias("_chars"), F.count("*").alias("_turns"))
    earlier = Window.partitionBy("_c", "perspective").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("_c").alias("_bc"),
        F.col("perspective").alias("_bp"),
        F.col("_stretch").alias("_bs"),
        F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_rank"),
    )
    order = Window.partitionBy(*keys).orderBy("_t", "_s", "_x")
    placed = views.withColumn("_stop", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_row", F.row_number().over(order)
    )
    same = F.col("_c").eqNullSafe(F.col("_bc")) & (F.col("perspective") == F.col("_bp")) & (F.col("_stretch") == F.col("_bs"))
    stop = F.col("_base") + F.col("_stop")
    trained = F.col("rendered_role") == "assistant"
    return placed.join(bases, same).select(
        F.col("_c").alias("conv_id"),
        "perspective",
        (F.col("_rank") + F.col("_row") - 1).alias("position"),
        F.col("_t").alias("turn"),
        F.col("_s").alias("speaker"),
        "rendered_role",
        "segment",
        (stop - F.length("segment")).alias("start"),
        stop.alias("stop"),
        trained.alias("trained"),
        F.when(trained, stop - F.length("segment") + F.length(F.concat(F.lit(OPEN + "\n"), F.col("rendered_role")))).alias("loss_start"),
        F.when(trained, stop - 1).alias("loss_stop"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS x,
    coalesce(replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D'), '%null') AS speaker
  FROM conversations
), parts AS (
  SELECT DISTINCT conv_id AS pc, speaker AS perspective FROM turns WHERE speaker <> 'system'
), views AS (
  SELECT t.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END AS rendered_role
  FROM turns t JOIN parts p ON t.conv_id IS NOT DISTINCT FROM p.pc
), cut AS (
  SELECT *, '<|im_start|>' || rendered_role || chr(10) || x || '<|im_end|>' || chr(10) AS segment FROM views
), placed AS (
  SELECT *,
    row_number() OVER w - 1 AS position,
    sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM cut WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, x)
)
SELECT conv_id, perspective, position, turn, speaker, rendered_role, segment,
  CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, rendered_role = 'assistant' AS trained,
  CAST(CASE WHEN rendered_role = 'assistant' THEN stop - length(segment) + 22 END AS BIGINT) AS loss_start,
  CAST(CASE WHEN rendered_role = 'assistant' THEN stop - 1 END AS BIGINT) AS loss_stop
FROM placed
"""
