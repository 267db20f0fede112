"""Chat formatting by rotating the perspective, with built-in functions only.

A dialogue is rendered once for each of its participants, with that one as the assistant and
the others as named users. The mask marks the characters that the assistant said. Long dialogues
are rendered in parts, so that no task ever holds more than a bounded number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretide.llm.frames import rank_in_order

# Turns of one rendered part.
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Speakers that set the scene and take no perspective.
SCENE = "system"
UNKNOWN = "unknown"


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, speaker, text, spans, n_turns, n_own`` for every part of a dialogue and every participant of the dialogue.

    Turns are ordered by turn (null first), role, text. Part k holds turns k * ``part_turns`` and on, by position.
    ``text`` joins, turn by turn, the opening mark, "assistant" or "user name=<speaker>" or "system", a line feed, the
    words said and the closing mark. ``spans`` are (start, end) character ranges of the assistant's
    words and closing marks. Null roles are a speaker named "unknown", null texts are empty. Rows without
    conv_id are one dialogue without id. Repeated rows are turns of their own. System turns are
    rendered in every perspective and have none. A participant silent in a part has a row for it too, without
    spans, so the parts of a perspective join to the whole dialogue. Dialogues with system turns alone have no rows.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
    )
    placed = rank_in_order(turns, ["conv_id"], ["turn", "role", "said"], "place")
    parts = (
        placed.withColumn("part", F.floor(F.col("place") / part_turns))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "role", "said"))).alias("turns"))
    )
    # One narrow row per participant and part, so that the parts of a long dialogue are joined in many tasks.
    counts = turns.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n", F.sum("n").over(Window.partitionBy("conv_id"))).filter(F.col("role") != SCENE)
    last = F.floor((F.col("n") - 1) / part_turns)
    wanted = counts.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), F.col("role").alias("speaker"))
    same = F.col("p.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("p.part") == F.col("w.part"))
    rotated = parts.alias("p").join(wanted.alias("w"), same).select("p.conv_id", "p.part", "turns", "speaker")
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.concat(
        F.lit(OPEN),
        F.when(own(t), F.lit("assistant"))
        .when(t["role"] == SCENE, F.lit(SCENE))
        .otherwise(F.concat(F.lit("user name="), t["role"])),
        F.lit("\n"),
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), own(t).alias("own")
        ),
    )
    written = rotated.select("conv_id", "part", "speaker", pieces.alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    size = lambda p: F.length(p["head"]) + F.length(p["body"])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "pieces",
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(
                p["own"],
                F.array_append(
                    acc["spans"],
                    F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + size(p)).alias("end")),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return written.select(
        "conv_id",
        "part",
        "speaker",
        whole.alias("text"),
        spans.alias("spans"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
    )


SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '{UNKNOWN}'), coalesce(text, '')) - 1 AS place
  FROM conversations),
placed AS (SELECT *, CAST(floor(place / {PART_TURNS}) AS BIGINT) AS part FROM turns),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role <> '{SCENE}'),
pieces AS (
  SELECT p.conv_id, p.part, s.speaker, p.place, p.role = s.speaker AS own,
    '{OPEN}' || CASE WHEN p.role = s.speaker THEN 'assistant' WHEN p.role = '{SCENE}' THEN '{SCENE}'
      ELSE 'user name=' || p.role END || chr(10) AS head,
    p.said || '<|im_end|>' || chr(10) AS body
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY place) AS stop FROM pieces)
SELECT conv_id, part, speaker, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || ':' || stop::BIGINT END, ' ' ORDER BY place), '') AS spans,
  count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own
FROM ends GROUP BY conv_id, part, speaker
"""
