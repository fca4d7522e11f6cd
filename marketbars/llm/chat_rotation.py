"""Multi-party perspective rotation: each participant's view of a dialogue, with that speaker as assistant.

For every participant (distinct role other than system) the dialogue is rendered with that participant's turns as
assistant, system turns as system and all other turns as users named by their role; the mask covers what the assistant
says. A dialogue is rendered in parts of `part_turns` consecutive turn numbers, and of `part_turns` turns at most, so a
conversation of any length, or of any number of equal turns, never meets in one row: (conv_id, speaker, part, piece)
names a part, and the parts in order are the dialogue. at tells where a part begins in the whole dialogue, in code
points: at + start and at + end are the mask over the whole, which is the same at every size of the parts. A system turn
stands once in the whole dialogue, where it was said.

Cases: null role is the participant "unknown"; null text is empty; null turn comes first, in parts of its own (part is
null); negative turn numbers come before zero; equal turn numbers are ordered by role and text, and repeated rows are
repeated turns; a conversation of system turns only has no participant and no rows; null conv_id is a conversation of
its own; an empty table gives an empty result.
Control marks inside texts and roles are broken up, so a text can't forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep

PART_TURNS = 64
END = "<|end|>\n"
#: Characters of a head: of the assistant, of a system turn, of a user without the name.
ASSISTANT, SYSTEM, USER = len("<|assistant|>\n"), len("<|system|>\n"), len("<|user name=|>\n")


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, piece, at, n_turns, n_assistant_turns, dialogue, mask_spans (start, end in code points of the part; end exclusive)."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _plain(F.coalesce("role", F.lit("unknown"))).alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
    t = t.withColumn("part", F.floor(F.col("turn") / part_turns))
    piece = F.floor((F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "role", "text")) - 1) / part_turns)
    parts = t.withColumn("piece", piece).groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    # what a part adds to the dialogue: with all others as users, and less for each turn of the speaker's own
    user = lambda role: F.length(role) + USER
    length = F.aggregate("said", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"]) + len(END) + F.when(m["role"] == "system", SYSTEM).otherwise(user(m["role"])))
    parts = keep(parts.withColumn("length", length).withColumn("roles", F.transform("said", lambda m: m["role"])), "parts")
    who = t.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    views = parts.select("conv_id", "part", "piece", "length", "roles").join(who, parts["conv_id"].eqNullSafe(who["c"]))  # no texts here
    own_turns = F.size(F.filter("roles", lambda r: r == F.col("speaker")))
    adds = views.select("conv_id", "speaker", "part", "piece", (F.col("length") - own_turns * (user(F.col("speaker")) - ASSISTANT)).alias("adds"))
    order = W.partitionBy("conv_id", "speaker").orderBy(F.col("part").asc_nulls_first(), "piece").rowsBetween(W.unboundedPreceding, -1)
    begin = adds.select(F.col("conv_id").alias("_conv_id"), "speaker", F.col("part").alias("_part"), F.col("piece").alias("_piece"), F.coalesce(F.sum("adds").over(order), F.lit(0).cast("long")).alias("at"))
    both = parts.join(begin, parts["conv_id"].eqNullSafe(begin["_conv_id"]) & parts["part"].eqNullSafe(begin["_part"]) & (parts["piece"] == begin["_piece"]))
    head = lambda m: F.when(m["role"] == F.col("speaker"), "<|assistant|>\n").when(m["role"] == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n")))
    both = both.select("conv_id", "speaker", "part", "piece", "at", F.transform("said", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == F.col("speaker")).alias("own"))).alias("m"))
    span = "struct<start:int,end:int>"
    marks = F.aggregate(
        "m",
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda s, m: F.struct(
            (s["at"] + F.length(m["head"]) + F.length(m["body"])).alias("at"),
            F.when(m["own"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(m["head"])).alias("start"), (s["at"] + F.length(m["head"]) + F.length(m["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return both.select(
        "conv_id", "speaker", F.col("part").cast("long").alias("part"), F.col("piece").cast("long").alias("piece"), "at",
        F.size("m").cast("long").alias("n_turns"),
        F.size(F.filter("m", lambda m: m["own"])).cast("long").alias("n_assistant_turns"),
        F.concat_ws("", F.transform("m", lambda m: F.concat(m["head"], m["body"]))).alias("dialogue"),
        marks.alias("mask_spans"),
    )


def op3(turns: DataFrame) -> DataFrame:
    spans = F.concat_ws(",", F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return rotate(turns).withColumn("mask_spans", spans)
