"""Checks of serialised chats and of their tokens: an acceptor of texts, and where two encodings part."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorvia.functions.distributions import col, let
from quorvia.functions.prompts import strip_ends

ROLES = ("system", "user", "assistant")


class Style(NamedTuple):
    """Marks of a serialisation. opening: what may, or must, stand once at its start; suffix: where the answer begins."""

    opening: str
    needs_opening: bool
    suffix: str


#: The marks of the four serialisations.
STYLES = {
    "chatml": Style("", False, "<|im_start|>assistant\n"),
    "header": Style("<|begin_of_text|>", False, "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "turns": Style("<bos>", False, "<start_of_turn>model\n"),
    "inst": Style("<s>", True, ""),
}


def turn_parts(turn: Column, style: str) -> tuple[Column, Column, Column]:
    """What opens a turn, its content, and what ends it."""
    role, text = turn["role"], turn["content"]
    if style == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), text, F.lit("<|im_end|>")
    if style == "header":
        return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n")), strip_ends(text), F.lit("<|eot_id|>")
    if style == "turns":
        return F.concat(F.lit("<start_of_turn>"), F.when(role == "assistant", "model").otherwise(role), F.lit("\n")), strip_ends(text), F.lit("<end_of_turn>")
    user = role == "user"
    return F.when(user, "[INST] ").otherwise(" "), text, F.when(user, "[/INST]").otherwise("</s>")


def own_turns(messages: Column, style: str) -> Column:
    """The turns that a style writes: one joins the system text to the first of the others."""
    if style != "inst":
        return messages
    system = F.get(F.filter(messages, lambda t: t["role"] == "system"), F.lit(0))["content"]
    lead = F.coalesce(F.concat(system, F.lit("\n\n")), F.lit(""))
    rest = F.filter(messages, lambda t: t["role"] != "system")
    return F.transform(rest, lambda t, i: F.struct(t["role"].alias("role"), F.concat(F.when((i == 0) & (t["role"] == "user"), lead).otherwise(""), t["content"]).alias("content")))


def serialization_fault(text: Column | str, messages: Column | str, style: str = "chatml", answer: bool = True) -> Column:
    """The first fault of a text as the serialisation of messages (arrays of role, content), or null.

    A cursor goes over the messages: from where it stands, each turn's opening, its content and
    its end must follow in this order, and the last end may not reach into the answer's suffix.
    The fault names the turn, from 0, where it lies in one.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")
    t, m, marks = col(text), col(messages), STYLES[style]
    suffix = marks.suffix if answer else ""
    opened = t.startswith(marks.opening) if marks.opening else F.lit(False)
    count = ((F.length(t) - F.length(F.replace(t, F.lit(marks.opening), F.lit("")))) / len(marks.opening)).cast("int") if marks.opening else F.lit(0)
    start = F.when(opened, len(marks.opening)).otherwise(0) + 1

    def step(state: Column, turn: Column) -> Column:
        head, content, end = turn_parts(turn, style)
        begins = F.position(head, t, state["cursor"])
        # a content of white space alone may leave nothing to look for
        inner = F.when(F.length(content) == 0, begins + F.length(head)).otherwise(F.position(content, t, begins + F.length(head)))
        ends = F.position(end, t, inner + F.length(content))
        fault = (
            F.when(F.coalesce(~turn["role"].isin(*ROLES), F.lit(True)), "role")
            .when(F.coalesce(F.length(turn["content"]) == 0, F.lit(True)), "empty content")
            .when(begins == 0, "opening")
            .when(inner == 0, "content")
            .when(ends == 0, "end")
        )
        named = F.when(fault.isNotNull(), F.concat(F.lit("turn "), state["number"].cast("string"), F.lit(": "), fault))
        moved = F.struct((ends + F.length(end)).cast("int").alias("cursor"), (state["number"] + 1).cast("int").alias("number"), named.alias("fault"))
        return F.when(state["fault"].isNotNull(), state).otherwise(moved)

    first = F.struct(start.cast("int").alias("cursor"), F.lit(0).alias("number"), F.lit(None).cast("string").alias("fault"))
    walked = F.aggregate(own_turns(m, style), first, step)
    last = lambda s: F.coalesce(s["fault"], F.when(s["cursor"] > F.length(t) - len(suffix) + 1, "answer boundary inside the last turn"))
    return (
        F.when(F.coalesce(F.length(t) == 0, F.lit(True)), "empty text")
        .when(m.isNull() | (F.size(m) == 0), "no messages")
        .when(F.lit(marks.needs_opening) & ~opened, "opening mark lacks")
        .when(count > F.when(opened, 1).otherwise(0), "opening mark repeats")
        .when(F.lit(bool(suffix)) & ~t.endswith(suffix), "answer boundary")
        .otherwise(let(walked, last))
    )


def first_differing_byte(actual: Column | str, expected: Column | str) -> Column:
    """offset (in UTF-8, from 0), actual and expected (values of the byte; null past a text's end); null for equal texts."""
    a, b = (F.hex(F.encode(col(x), "UTF-8")) for x in (actual, expected))

    def found(h: Column) -> Column:
        x, y = h["x"], h["y"]
        # halve the stretch in which the texts part: thirty-two steps reach any length
        start = F.struct(F.lit(0).alias("low"), (F.greatest(F.length(x), F.length(y)) / 2).cast("int").alias("high"))

        def narrow(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
            same = F.left(x, middle * 2) == F.left(y, middle * 2)
            alike = same & (F.length(x) >= middle * 2) & (F.length(y) >= middle * 2)
            return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(alike, middle).otherwise(s["low"]).alias("low"), F.when(alike, s["high"]).otherwise(middle - 1).alias("high")))

        value = lambda text, at: F.conv(F.substring(text, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
        byte = lambda text, at: F.when(at * 2 < F.length(text), value(text, at))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, narrow)["low"], lambda at: F.struct(at.cast("long").alias("offset"), byte(x, at).alias("actual"), byte(y, at).alias("expected")))

    return F.when(col(actual) != col(expected), let(F.struct(a.alias("x"), b.alias("y")), found))


def token_diagnostics(actual: Column | str, expected: Column | str, opening_id: int) -> Column:
    """Two encodings compared: equal, lengths, the first differing place with both values (null past
    an end), how often and whether first the opening id stands in each, and whether they are accepted:
    equal, with one opening id each, at the start."""
    a, b = col(actual), col(expected)
    place = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    count = lambda x: F.size(F.filter(x, lambda t: t == opening_id))
    leads = lambda x: F.coalesce(F.get(x, F.lit(0)) == opening_id, F.lit(False))
    differs = F.when(a != b, (place - 1).cast("int"))
    one = lambda x: leads(x) & (count(x) == 1)
    return let(
        differs,
        lambda d: F.struct(
            (a == b).alias("equal"), F.size(a).alias("n_actual"), F.size(b).alias("n_expected"),
            d.alias("differs_at"), F.get(a, d).alias("actual_id"), F.get(b, d).alias("expected_id"),
            count(a).alias("openings_actual"), count(b).alias("openings_expected"), leads(a).alias("leads_actual"), leads(b).alias("leads_expected"),
            ((a == b) & one(a) & one(b)).alias("accepted"),
        ),
    )
