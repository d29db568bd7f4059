"""Preference formatting of conversation pairs.

The longest common turn prefix of the chosen and the rejected conversation is rendered once
as the prompt; what follows on either side is rendered as a completion, with the character
spans that are learned from (the assistant's own text and its end mark); the rest of a
completion is masked. All of it is DataFrame expressions over one shuffle by pair.

Tables that hold conversations but no pairs are branched first: at one of its assistant
turns, a conversation is followed by a worse answer, and that branch is the rejected side.

Defined results: a null role or text counts as empty; turns are ordered by turn, role and
text, nulls first, and repeated turns stay; each row without a conversation id is a
conversation of its own; a conversation without an assistant turn has no branch, so its
rejected side is empty and ``complete`` false; equal sides give two empty completions; marks
inside a text are broken up so that they can't open or close a turn; other columns, whatever
their names, are ignored; an empty table gives no rows. A conversation is one output row, so
a single one must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn, as in ChatML.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), clean(turn["role"]), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(clean(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")


def learned_spans(turns: Column) -> Column:
    """[start, end) in characters of the rendered turns, of what the learned role says."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(body(t))
        own = F.when(t["role"] == LEARNED_ROLE, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns with role and text). Gives pair_id,
    complete, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    alike = lambda x, y: F.coalesce(x["role"], F.lit("")).eqNullSafe(F.coalesce(y["role"], F.lit(""))) & F.coalesce(x["text"], F.lit("")).eqNullSafe(F.coalesce(y["text"], F.lit("")))
    differs = F.array_position(F.zip_with(F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter), alike), False)
    df = pairs.select("pair_id", "chosen", "rejected", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int").alias("n_common"))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1)))
    return df.select(
        "pair_id",
        ((F.size("chosen") > 0) & (F.size("rejected") > 0)).alias("complete"),
        F.col("n_common").cast("long").alias("n_common"),
        render(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"),
        render(rest("rejected")).alias("rejected"),
        learned_spans(rest("chosen")).alias("chosen_spans"),
        learned_spans(rest("rejected")).alias("rejected_spans"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array in order): one shuffle by id; rows without id are not shuffled."""
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    whole = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.union(turns.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))


def branch_conversations(held: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: each conversation, and its branch with a worse answer.

    held: conv_id, turns. The branch leaves at the assistant turn whose number is the id modulo
    their count. The worse answer is that of the next assistant turn (of the first after the
    last), which answers something else; if there is none, or it is the same, the first half.
    """
    numbers = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED_ROLE, i + 1)), lambda i: i.isNotNull())
    n = F.size("spots")
    df = held.select("conv_id", "turns", numbers.alias("spots"))
    which = F.pmod(F.coalesce("conv_id", F.lit(0)), F.greatest(n, F.lit(1))).cast("int")
    at = F.get("spots", which)
    next_at = F.get("spots", F.pmod(which + 1, F.greatest(n, F.lit(1))).cast("int"))
    df = df.select("conv_id", "turns", at.alias("at"), F.get("turns", at - 1).alias("answer"), F.get("turns", next_at - 1)["text"].alias("other"))
    text = F.coalesce(F.col("answer.text"), F.lit(""))
    worse = F.when(F.coalesce("other", F.lit("")) != text, F.col("other")).otherwise(F.left(text, F.floor(F.length(text) / 2).cast("int")))
    branch = F.concat(F.slice("turns", 1, F.col("at") - 1), F.array(F.struct(F.col("answer.turn").alias("turn"), F.col("answer.role").alias("role"), worse.alias("text"))))
    none = F.slice("turns", 1, 0)
    return df.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("at").isNull(), none).otherwise(branch).alias("rejected"))


def spans_text(spans: Column) -> Column:
    """Spans as ``start:end`` with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
