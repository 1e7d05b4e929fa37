"""Dialogues from the perspective of each participant.

Every speaker but the system is a participant. For each of them the dialogue is rendered with their turns as the
assistant's, others' turns as a named user's and the system's as its own; the loss mask covers what the assistant says,
its end marker included. The result has a row for each perspective and turn, with the turn's place in the rendered
dialogue, so that no dialogue need fit a row; the places come from sums over spans of turns and then within them, so
that a very long dialogue isn't summed up in one task.

``dialogues`` joins the turns of each perspective to the rendered text with its masks, in parts of a bounded size.

Defined cases: rows without conv_id belong to no dialogue and give nothing. A null or blank role is the participant
``unknown``. In roles control characters, line ends and white space become one space and are trimmed, so that no role can
open a line of its own; roles that are then alike are one participant. A null text is empty. A null turn comes last. Equal
turns are ordered by role and text, and repeated rows are turns of their own. Markers within a text or a role are broken up
by a space. A dialogue of system turns alone has no participant and gives nothing, nor does an empty table. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SPAN = "<|im_start|>", "<|im_end|>", 256
#: What a role can't hold: control characters, white space and line ends.
CONTROL = r"[\x00-\x20\x7F\x{85}\x{A0}\x{2028}\x{2029}]+"
#: Characters in a part of a rendered dialogue, about; a longer turn has a part of its own.
PART = 1 << 20


def unmarked(text: Column) -> Column:
    """Without markers, which are broken up by a space."""
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("|", " |", 1)))
    return text


def perspectives(turns: DataFrame) -> DataFrame:
    """Per participant and turn: conv_id, perspective, turn, speaker, chat_role, rendered, start, stop, mask_start,
    mask_stop (null where the turn isn't trained on). Places are in characters of the rendered dialogue."""
    role = unmarked(F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), CONTROL, " ")))
    text = unmarked(F.coalesce("text", F.lit("")))
    said = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.when(role == "", "unknown").otherwise(role).alias("speaker"), text.alias("said"))
    people = said.filter(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = said.join(people, "conv_id").withColumn("chat_role", F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user"))
    head = F.concat(F.lit(START), "chat_role", F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("\n"))
    both = both.withColumn("head", head).withColumn("rendered", F.concat("head", "said", F.lit(END + "\n"))).withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit((1 << 62) - 1)))
    spans = both.groupBy("conv_id", "perspective", "span").agg(F.sum(F.length("rendered")).alias("long"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.select("conv_id", "perspective", "span", F.coalesce(F.sum("long").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "perspective", "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "said").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.join(base, ["conv_id", "perspective", "span"]).withColumn("stop", F.col("base") + F.sum(F.length("rendered")).over(within)).withColumn("start", F.col("stop") - F.length("rendered"))
    trained = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "chat_role",
        "rendered",
        "start",
        "stop",
        F.when(trained, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(trained, F.col("stop") - 1).alias("mask_stop"),
    )


def dialogues(turns: DataFrame, part: int = PART) -> DataFrame:
    """The rendered dialogue of each perspective: conv_id, perspective, part (from 0), start, text, and masks, the (start,
    stop) of what is trained on; places are in characters of the whole dialogue, parts end with a turn."""
    rows = perspectives(turns).withColumn("part", F.floor(F.col("start") / part))
    mask = F.when(F.col("mask_start").isNotNull(), F.struct(F.col("mask_start").alias("start"), F.col("mask_stop").alias("stop")))
    whole = rows.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(F.struct("start", "rendered"))).alias("said"), F.sort_array(F.collect_list(mask)).alias("masks"))
    place = F.row_number().over(Window.partitionBy("conv_id", "perspective").orderBy("part")) - 1
    return whole.select("conv_id", "perspective", place.alias("part"), F.col("said")[0]["start"].alias("start"), F.concat_ws("", F.col("said")["rendered"]).alias("text"), "masks")
