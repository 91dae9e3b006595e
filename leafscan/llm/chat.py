"""Chat formatting: each dialogue once from the side of every one of its participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import SALTS, attach, running_total, stored

SYSTEM = "system"
UNNAMED = "unknown"
# A rendered dialogue comes in parts of about so many characters; nearly all have one.
PART_CHARS = 1 << 18


def safe(text: Column) -> Column:
    """A text that cannot hold a marker of the template."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def heading(speaker: Column, me: Column) -> Column:
    """Opening of a message: the system's, the participant's own, or another's by name."""
    name = F.concat(F.lit("<|user name="), F.replace(safe(speaker), F.lit("|>"), F.lit("| >")), F.lit("|>\n"))
    own = F.when(speaker == me, F.lit("<|assistant|>\n")).otherwise(name)
    return F.when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(own)


def perspectives(messages: DataFrame) -> DataFrame:
    """One row for each message of ``(conv_id, turn, role, text)`` and participant.

    Participants are the distinct roles of a conversation other than ``system``; a null role
    is one called ``unknown``. Returns ``(conv_id, speaker, turn, role, head, body, trained,
    start)``: the message as ``speaker`` sees it, and where it begins, in characters, in the
    dialogue rendered for that speaker. ``trained`` marks the speaker's own messages, whose
    body alone is learned from. Messages stand by turn (nulls first), then role and the
    text's md5; equal rows follow one another.

    A conversation with very many messages fills several partitions throughout.
    """
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), "text")
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    turns = turns.withColumn("_salt", F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int"))
    salted = speakers.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.withColumnRenamed("conv_id", "_conv")
    same = turns["conv_id"].eqNullSafe(salted["_conv"]) & (turns["_salt"] == salted["_other"])
    seen = turns.join(salted, same).drop("_conv", "_other", "_salt")
    head = heading(F.col("role"), F.col("speaker"))
    body = F.concat(safe(F.col("text")), F.lit("<|end|>\n"))
    shown = seen.select(
        "conv_id",
        "speaker",
        "turn",
        "role",
        head.alias("head"),
        body.alias("body"),
        (F.col("role") == F.col("speaker")).alias("trained"),
        F.md5(F.coalesce("text", F.lit(""))).alias("_digest"),
        (F.char_length(head) + F.char_length(body)).cast("long").alias("_chars"),
    )
    keys, order = ["conv_id", "speaker"], ["turn", "role", "_digest"]
    return running_total(shown, keys, order, "_chars", "start").drop("_chars")


def render(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, speaker, part, n_messages, text, mask)``: the dialogues, ready to train on.

    ``mask`` holds the spans ``[start, end)`` of the part's characters that are learned from.
    A dialogue longer than ``part_chars`` comes in parts, each of whole messages that begin
    in its stretch, so that no row grows with a conversation. A conversation of system
    messages alone has no participant and gives no row.
    """
    part = F.floor(F.col("start") / part_chars).cast("long")
    message = F.struct("start", "turn", "role", "_digest", "head", "body", "trained")
    grouped = perspectives(messages).withColumn("part", part)
    parts = grouped.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    texts = F.transform("m", lambda x: F.concat(x["head"], x["body"]))
    first = F.element_at("m", 1)["start"]

    def span(x: Column) -> Column:
        begin = x["start"] - first + F.char_length(x["head"])
        return F.struct(begin.alias("start"), (begin + F.char_length(x["body"]) - 1).alias("end"))

    own = F.filter("m", lambda x: x["trained"])
    return parts.select(
        "conv_id",
        "speaker",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        F.array_join(texts, "").alias("text"),
        F.transform(own, span).alias("mask"),
    )


def dialogues(messages: DataFrame) -> DataFrame:
    """The rendered dialogues with their masks spelt ``start-end`` and joined by commas."""
    spelt = F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return render(messages).select(
        "conv_id", "speaker", "part", "n_messages", "text", F.array_join(spelt, ",").alias("mask")
    )
