"""Dialogues of several parties, rendered once from the point of view of each.

For every participant the dialogue is written with that speaker as the assistant and all others as named users, and the
spans of what the assistant says are the ones to be learnt. A rendering comes in parts of a bounded number of turns, so a
conversation with a third of all rows is many rows that many tasks make, not one long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import ordered, table

TURNS = 64
SYSTEM, NOBODY = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: str) -> Column:
    """A text in which no control mark can begin."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, participant, part, n_turns, text, spans) for every participant and every ``turns`` turns of a conversation.

    ``conversations``: conv_id, turn, role, text. Turns go by turn (null first), then role and text, so that equal rows may
    change places unseen. Everyone who has a turn takes part, but for ``system``, whose turns are shown as such to all. A null
    role is shown as the user ``unknown`` and has no rendering of its own; a null text is empty; a null conv_id is a
    conversation. ``<|`` in texts and names becomes ``< |``. spans: start and end of the assistant's text and end mark, in
    characters of this part's text. An empty table gives none.
    """
    known = conversations.select("conv_id", "turn", _plain("text").alias("text"), "role")
    known = known.withColumn("role", F.when(F.col("role").isNotNull(), _plain("role")))
    placed = ordered(known, ["conv_id"], ["turn", "role", "text"], "chat-turns")
    placed = placed.withColumn("part", F.floor(F.col("_nth") / turns).cast("long"))
    said = F.sort_array(F.collect_list(F.struct("_nth", "role", "text")))  # at most ``turns`` of them
    parts = placed.groupBy("conv_id", "part").agg(said.alias("said")).alias("p")
    people = known.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("participant")).distinct().alias("w")
    both = parts.join(people, F.expr("p.conv_id <=> w.conv_id")).select("p.conv_id", "participant", "part", "said")
    own = lambda t: t["role"].eqNullSafe(F.col("participant"))
    name = lambda t: F.coalesce(t["role"], F.lit(NOBODY))
    who = lambda t: (
        F.when(own(t), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), name(t)))
    )
    shown = F.transform(
        "said",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), who(t), F.lit("\n")).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            own(t).alias("own"),
        ),
    )
    shown = both.withColumn("shown", shown)
    size = lambda t: F.length(t["head"]) + F.length(t["body"])
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    walked = F.aggregate(
        "shown",
        start,
        lambda a, t: F.struct(
            (a["at"] + size(t)).alias("at"),
            F.when(
                t["own"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(t["head"])).alias("start"), (a["at"] + size(t)).alias("end")
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return shown.select(
        "conv_id",
        "participant",
        "part",
        F.size("shown").alias("n_turns"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        walked["spans"].alias("spans"),
    )


def op7_chat_rotation(spark: SparkSession, sf: str) -> DataFrame:
    shown = rotate(table(spark, sf, "conversations"))
    pair = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
    return shown.withColumn("spans", F.array_join(F.transform("spans", pair), ","))


SQL7 = r"""
WITH k AS (SELECT conv_id, turn, replace(role, '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS nth FROM k),
w AS (SELECT DISTINCT conv_id, role AS participant FROM k WHERE role <> 'system'),
s AS (SELECT t.conv_id, participant, nth // 64 AS part, nth, role IS NOT DISTINCT FROM participant AS own,
    '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM participant THEN 'assistant' WHEN role = 'system' THEN 'system'
        ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, part ORDER BY nth) AS upto FROM s)
SELECT conv_id, participant, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body, '' ORDER BY nth) AS text,
    coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) AS VARCHAR) || '-' || CAST(upto AS VARCHAR) END, ','
        ORDER BY nth), '') AS spans
FROM o GROUP BY conv_id, participant, part
"""
