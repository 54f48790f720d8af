"""Perspective rotation: a dialogue rendered once for each participant, who then is the assistant.

Every turn is rendered for every participant: the participant's own turns as the assistant's, everyone else's as a user's
with the speaker's name, system turns as they are. The loss mask covers the assistant's text and end mark. A dialogue is
the segments in the order of `seq`; where a segment starts is a prefix sum, taken within blocks of turns and over the
blocks' totals, so a long conversation is spread over tasks. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.llm.common import join_hot, prefix_sums

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Turns of a block.
BLOCK = 64


def unmarked(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each turn and perspective: conv_id, perspective, seq, turn, role, name, segment, start, stop, mask_start, mask_stop.

    Offsets are code points of the dialogue, stop exclusive; a turn that is not the perspective's has an empty mask
    (mask_start = mask_stop = stop). Participants are the distinct roles but system; a null role speaks as "unknown"; a
    null text is empty. Marks inside texts and role names are broken up, and line breaks of role names are spaces, so
    neither can pose as another turn; roles that are equal then are one participant. Turns are in the order of turn, null
    last, then role and the text's MD5, so a block without numbers, however large, is cut by these. Repeated rows are turns
    of their own. A conversation of system turns alone, and an empty table, give no rows; a null conv_id is a conversation.
    """
    said = unmarked(F.coalesce(F.col("text").cast("string"), F.lit("")))
    speaker = unmarked(F.translate(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), "\r\n", "  "))
    own = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"), said.alias("said"))
    own = own.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "said_size": F.length("said").cast("bigint"), "block": F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62))})
    party = own.where("speaker <> 'system'").select("key", F.col("speaker").alias("perspective")).distinct()
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    seen = join_hot(own, party, ["key"], own.groupBy("key").agg(F.count("*").alias("n"))).withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(BEGIN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    # Sizes before texts: the first pass, over blocks, moves numbers only.
    seen = seen.withColumns({"segment": F.concat(head, F.col("said"), F.lit(END)), "size": F.length(head) + F.col("said_size") + len(END), "one": F.lit(1).cast("bigint"), "md5": F.md5(F.col("said").cast("binary"))})

    exact = {"turn": F.coalesce("turn", F.lit(2**62)), "speaker": F.col("speaker"), "md5": F.substring("md5", 1, 3)}
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("md5"), F.col("said")]
    out = prefix_sums(seen, ["key", "perspective"], "block", exact, {"start": "size", "seq": "one"}, order)
    out = out.withColumn("stop", F.col("start") + F.col("size"))
    masked = F.col("role") == "assistant"
    mask_start = F.when(masked, F.col("stop") - F.col("said_size") - len(END)).otherwise(F.col("stop"))
    return out.select("conv_id", "perspective", "seq", "turn", "role", "name", "segment", "start", "stop", mask_start.alias("mask_start"), F.col("stop").alias("mask_stop"))


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, the whole dialogue and its mask as (start, stop) pairs: for conversations that fit in a row."""
    own = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_stop")))
    rows = rotate(turns).groupBy("conv_id", "perspective").agg(own.alias("s"))
    mask = F.expr("transform(filter(s, x -> x.mask_start < x.mask_stop), x -> struct(x.mask_start as start, x.mask_stop as stop))")
    return rows.select("conv_id", "perspective", F.array_join(F.col("s.segment"), "").alias("dialogue"), mask.alias("mask"))


SQL = f"""
WITH own AS (
  SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
party AS (SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker <> 'system'),
seen AS (
  SELECT o.conv_id, o.turn, o.speaker, o.said, p.perspective,
         CASE WHEN o.speaker = p.perspective THEN 'assistant' WHEN o.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM own o JOIN party p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
named AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name FROM seen),
cut AS (
  SELECT *, '{BEGIN}' || role || coalesce(' name=' || name, '') || chr(10) || said || '{END.strip()}' || chr(10) AS segment FROM named),
placed AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS stop FROM cut
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, md5(said), said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, role, name, segment, stop - length(segment) AS start, stop,
       CASE WHEN role = 'assistant' THEN stop - length(said) - {len(END)} ELSE stop END AS mask_start, stop AS mask_stop
FROM placed
"""
