"""Chat formatting by rotating the perspective over all participants of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.session import prepare

#: Fixed marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    narrators: tuple[str, ...] = ("system",),
    block_turns: int = 256,
) -> DataFrame:
    """Render every conversation once for each participant, with that speaker as the assistant.

    The other participants become ``user name=<speaker>``; narrators (the system prompt) keep their
    own role and have no perspective. A conversation of narrators only gives no row.

    Columns: the conversation, ``speaker``, ``block``, ``n_turns``, ``text``, ``start`` (characters
    before this block) and ``mask``: the spans ``(start, stop)`` within the whole rendering that the
    speaker is trained on, its texts and their closing marks. A block holds ``block_turns`` turn
    numbers, so a row stays bounded however long a conversation grows, unless very many of its turns share
    a number or have none: these share a block. The texts of its blocks, in order, are the rendering. Usual
    conversations have one block.

    Turns with the same number (or none; these come first, in block -1) are ordered by speaker and
    text, repeated rows are repeated turns, a null text is empty, a null speaker is called
    ``unknown``, rows with a null conversation form one conversation. An empty table gives an empty
    table; further columns are not read.
    """
    prepare(turns.sparkSession)
    said = turns.select(
        F.col(conv_col).alias("c"),
        F.col(turn_col).alias("t"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.coalesce(F.floor(F.col(turn_col) / F.lit(block_turns)), F.lit(-1)).cast("long").alias("block"),
    )
    people = (
        said.where(~F.col("name").isin(*narrators)).select(F.col("c").alias("pc"), F.col("name").alias("speaker")).distinct()
    )
    own = F.col("name") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("name").isin(*narrators), F.col("name"))
    head = F.concat(F.lit(OPEN), F.coalesce(role, F.concat(F.lit("user name="), "name")), F.lit("\n"))
    # A struct that is never null, so that blocks without a conversation are joined like others.
    seen = said.join(people, F.col("c").eqNullSafe(F.col("pc"))).withColumns({"k": F.struct("c"), "head": head})
    line = F.struct("t", "name", "body", "head", own.alias("own"))
    blocks = seen.groupBy("k", "speaker", "block").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def rendered(x: Column) -> Column:
        return F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))

    def walk(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["head"])
        stop = at + F.char_length(x["body"]) + F.lit(len(CLOSE))
        span = F.array(F.struct(at.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + F.lit(1)).cast("long").alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    nothing = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")
    )
    walked = blocks.select(
        "k",
        "speaker",
        "block",
        F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", rendered), "").alias("text"),
        F.aggregate("lines", nothing, walk).alias("end"),
    )
    # The blocks of a conversation meet as numbers only; their texts stay where they were rendered.
    size = F.char_length("head") + F.char_length("body") + F.lit(len(CLOSE) + 1)
    sizes = seen.groupBy("k", "speaker", "block").agg(F.sum(size).alias("size"))
    order = Window.partitionBy("k", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("k", "speaker", "block", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")).alias("start"))
    placed = walked.join(starts.hint("merge"), ["k", "speaker", "block"])
    moved = F.transform(
        "end.spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["stop"] + F.col("start")).alias("stop"))
    )
    return placed.select(F.col("k.c").alias(conv_col), "speaker", "block", "n_turns", "text", "start", moved.alias("mask"))
