"""Chat training texts by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users. Spans of the speaker's own words are the training mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import staged

#: Turns of one part; longer conversations give several parts.
PART = 512
START, END = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame, part: int = PART, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation, speaker and part: conv_id, speaker, part, n_turns, n_own, text, mask.

    Every role but "system" is a speaker; system turns open no perspective and stay system turns.
    mask: "start-end" spans, joined by commas, in code points of the part's text, end excluded;
    they cover the speaker's words and the end mark. A part holds the turns at positions k * part up to
    (k + 1) * part of the conversation's order, so no part has more turns than that, however many tie, have
    no number or no conversation. Its texts are put together once and rotated then. A system turn stands only
    in the part it falls in.

    Turns are ordered by number, ties by role and text; repeated rows are one turn. Marks inside
    a text are broken by a backslash, so that no text can end its turn. Missing texts are empty,
    missing turn numbers come first, and missing roles are the speaker "unknown".
    Conversations without an id are one conversation. An empty table gives no rows.
    """
    clean = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), clean.alias("text")).alias("t"),
    )
    rows = _positions(rows.groupBy("conv", "t").agg(F.lit(1).alias("one")).drop("one")).withColumn("part", F.floor(F.col("pos") / part).cast("long"))
    speakers = rows.where("t.role <> 'system'").groupBy("conv", F.col("t.role").alias("speaker")).agg(F.lit(1).alias("one"))
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    met = parts.alias("p").join(speakers.alias("s"), F.expr("p.conv <=> s.conv")).select("p.conv", "p.part", "p.turns", "s.speaker")
    spoken = F.transform("turns", lambda t: F.struct(_head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    met = met.withColumn("spoken", spoken)
    whole = F.array_join(F.transform("spoken", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    start = F.aggregate(
        "spoken", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).cast("long").alias("at"),
            F.when(t["own"], F.array_append(a["spans"], F.concat_ws("-", (a["at"] + F.length(t["head"])).cast("string"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).cast("string"))))
            .otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return met.select(
        F.col("conv").alias(conversation), "speaker", "part", F.size("spoken").cast("long").alias("n_turns"),
        F.size(F.filter("spoken", lambda t: t["own"])).cast("long").alias("n_own"), whole.alias("text"), start.alias("mask"),
    )


def _positions(rows: DataFrame) -> DataFrame:
    """rows(conv, t) with pos, the number of the conversation's rows before each in the order of t.

    The table is sorted by ranges, so one conversation may lie in many tasks. Numbers of rows within
    tasks come from the sort; those of earlier tasks are added from one count a task and conversation.
    """
    line = F.monotonically_increasing_id()
    laid = staged(rows.sort("conv", "t").withColumn("line", line).withColumn("run", F.shiftright("line", 33)), "turns")
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = laid.groupBy("conv", "run").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    met = laid.alias("l").join(runs.alias("r"), F.expr("l.run = r.run AND l.conv <=> r.conv"))
    return met.select("l.conv", "l.t", (F.col("before") + F.col("line") - F.col("first")).alias("pos"))


def _head(t):
    """The opening of a turn as seen by the speaker of the row."""
    name = F.concat(F.lit("user name="), F.regexp_replace(t["role"], r"\s+", "_"))
    seen = F.when(t["role"] == "system", F.lit("system")).when(t["role"] == F.col("speaker"), F.lit("assistant")).otherwise(name)
    return F.concat(F.lit(START), seen, F.lit("\n"))
