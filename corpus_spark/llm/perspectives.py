"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant, all others
as named users, and a mask over what the assistant says. Turns are numbered without a task per conversation, and
a dialogue is a row per PART_TURNS turns, so that no row grows with the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.ordered import numbered

PART_TURNS = 256
SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>\n"


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, perspective, part, n_turns, text, mask) for every participant of every dialogue.

    `mask` lists start:end of what the perspective's speaker says, its end marker included, in code points of
    `text`. Turns stand by number (null first), then role, then text; repeated rows stay repeated. A null or empty role is
    the speaker "unknown", a null text is empty, rows of a null conversation are one dialogue. The system
    is no participant, so a dialogue of it alone gives no row. Other columns are ignored; an empty table
    gives an empty one.
    """
    name = F.coalesce(F.nullif(F.col(role).cast("string"), F.lit("")), F.lit(UNNAMED))
    # A null conversation gets a key of its own, since numbering and joins need one.
    turns = df.select(
        F.coalesce(F.to_json(F.struct(F.col(conversation).alias("c"))), F.lit("{}")).alias("key"),
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        name.alias("speaker"),
        _plain(F.col(text)).alias("said"),
    )
    placed = numbered(turns, ["key"], ["turn", "speaker", "said"], "place")
    participants = turns.filter(F.col("speaker") != SYSTEM).select("key", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _plain(F.col("speaker")), F.lit("|>\n")))
    )
    rendered = placed.join(participants, "key").select(
        "key", "conversation", "perspective", "place",
        F.floor((F.col("place") - 1) / PART_TURNS).alias("part"),
        F.struct("place", own.alias("own"), head.alias("head"), F.concat("said", F.lit(END)).alias("body")).alias("turn"),
    )
    parts = rendered.groupBy("key", "conversation", "perspective", "part").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")  # PART_TURNS at most
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.char_length(t["head"])
        end = begin + F.char_length(t["body"])
        span = F.when(t["own"], F.array(F.concat_ws(":", begin, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(done["spans"], span).alias("spans"))

    mask = F.aggregate("turns", start, step, lambda done: F.array_join(done["spans"], ","))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    return parts.select(
        F.col("conversation").alias(conversation),
        "perspective",
        F.col("part").cast("bigint").alias("part"),
        F.size("turns").cast("bigint").alias("n_turns"),
        whole.alias("text"),
        mask.alias("mask"),
    )
