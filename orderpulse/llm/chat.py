"""Preference formatting: the common first turns of a chosen and a rejected conversation become one prompt.

DataFrame functions only. A turn is rendered as `<|role|>`, a line break, its text, `<|end|>` and a line break; a `<|`
in a role or text is written `<\\|`, so that no text can end a turn. Of each completion, only what assistants say, with
the end mark, is learnt from: its character ranges are the mask.

Defined cases: a null role or text is rendered as empty but differs from an empty one when turns are compared; turns
are ordered by turn, role and text, nulls first, so ties and repeated rows have one order; rows without conversation
id belong to no conversation; a conversation without partner has an empty one as partner; conversations that are equal
have empty completions and are not usable; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def _safe(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, turns (role, text, as rendered: head, body). Its turns are one row of output."""
    said = F.concat(_safe(F.col("text")), F.lit("<|end|>\n"))
    turn = F.struct("turn", "role", "text", F.concat(F.lit("<|"), _safe(F.col("role")), F.lit("|>\n")).alias("head"), said.alias("body"))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _mask(turns: Column) -> Column:
    """Character ranges [a, z) of what assistants say in the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        a = done["at"] + F.char_length(t["head"])
        z = a + F.char_length(t["body"])
        span = F.array(F.struct(a.cast("long").alias("a"), (z - 1).cast("long").alias("z")))
        return F.struct(z.cast("long").alias("at"), F.when(F.coalesce(t["role"] == ASSISTANT, F.lit(False)), F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda done: done["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, prompt, chosen, rejected, their masks, turn counts, usable; from rows (key, turn, role, text) of both sides."""
    a = conversations(chosen, key).withColumnRenamed("turns", "c")
    b = conversations(rejected, key).withColumnRenamed("turns", "r")
    none = F.array().cast(dict(a.dtypes)["c"])
    both = a.join(b, key, "full").withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)})
    shared = F.zip_with(
        F.slice("c", F.lit(1), F.least(F.size("c"), F.size("r"))), F.slice("r", F.lit(1), F.least(F.size("c"), F.size("r"))),
        lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]),
    )
    first = F.array_position(shared, F.lit(False)).cast("int")
    cut = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(shared)))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    sides = cut.select(key, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    answers = lambda x: F.exists(x, lambda t: F.coalesce(t["role"] == ASSISTANT, F.lit(False)))
    return sides.select(
        key, _text(F.col("p")).alias("prompt"), _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
        F.col("n").cast("long").alias("prompt_turns"), F.size("c").cast("long").alias("chosen_turns"), F.size("r").cast("long").alias("rejected_turns"),
        ((F.col("n") > 0) & answers(F.col("c")) & answers(F.col("r"))).alias("usable"),
    )
