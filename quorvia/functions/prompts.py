"""Prompt texts as Column expressions: conditions, evidence lines, chat serialisation, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorvia.functions.distributions import col, largest_remainder, option_labels

CONDITIONS = ("baseline", "country_label", "population_evidence", "conflict")

#: Opening sentences by condition; the core conditions share one.
CORE_OPENING = "You are a social science researcher. A single respondent is selected at random from the target population. Predict which option this one respondent selected."
OPENINGS = {
    "persona": "You are a social science researcher. Imagine a single citizen selected at random from {country}. Predict which option this one citizen selected.",
    "evidence_numeric": "You are a social science researcher. A single respondent is selected at random from the population described by the numeric survey evidence below. Predict which option this one respondent selected.",
    "evidence_incomplete": "You are a social science researcher. A single respondent is selected at random from the population described by the related survey information below. Predict which option this one respondent selected.",
    "baseline_v2": "You are a social scientist. One adult is drawn at random from this society. Predict the option selected by that adult.",
    "baseline_v3": "As a researcher studying public opinion, consider one randomly selected member of this population. Predict that person's selected option.",
    "evidence_v2": "According to survey data from this population, the response distribution is shown below. One respondent is then selected at random from this population. Predict that respondent's selected option.",
}
#: Cue lines and the answer's instruction.
COUNTRY_CUE, EVIDENCE_CUE = "Target Country: ", "Survey Response Statistics: "
NUMERIC_CUE, RELATED_CUE = "Survey Evidence: ", "Related Information: "
INSTRUCTION = ("Reply with exactly one of these option labels: ", ". Do not output anything else.\nAnswer:")


def option_lines(options: Column | str) -> Column:
    o = col(options)
    return F.array_join(F.zip_with(option_labels(F.size(o)), o, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def format_evidence(p: Column | str, options: Column | str, decimals: int = 6) -> Column:
    """``A (Yes): 60.000000%, B (No): 40.000000%`` from the rounded distribution."""
    o = col(options)
    parts = F.arrays_zip(option_labels(F.size(o)).alias("label"), o.alias("option"), largest_remainder(p, decimals).alias("ticks"))
    # integer arithmetic: no second rounding
    percent = lambda t: F.format_string(f"%d.%0{decimals}d", F.expr("0") + F.floor(t / 10**decimals), F.pmod(t, F.lit(10**decimals).cast("long")))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["label"], F.lit(" ("), x["option"], F.lit("): "), percent(x["ticks"]), F.lit("%"))), ", ")


def incomplete_evidence(evidence: Column | str) -> Column:
    """The first two pieces of an evidence line, cut at comma and space."""
    return F.array_join(F.slice(F.split(col(evidence), ", "), 1, 2), ", ")


def instruction(options: Column | str) -> Column:
    return F.concat(F.lit(INSTRUCTION[0]), F.array_join(option_labels(F.size(col(options))), ", "), F.lit(INSTRUCTION[1]))


def prompt(condition: str, question: Column | str, options: Column | str, *, country: Column | str | None = None, evidence: Column | str | None = None) -> Column:
    """The prompt of one condition. country: for labels and persona; evidence: a formatted line."""
    needs = {"country": condition in ("country_label", "conflict", "persona"), "evidence": "evidence" in condition or condition == "conflict"}
    if condition not in CONDITIONS and condition not in OPENINGS:
        raise ValueError(f"unknown condition: {condition}")
    if needs["country"] and country is None or needs["evidence"] and evidence is None:
        raise ValueError(f"{condition} lacks its cue")
    ask = [F.lit("Question: "), col(question), F.lit("\nOptions:\n"), option_lines(options), F.lit("\n\n"), instruction(options)]
    if condition in CONDITIONS:
        cues = []
        if needs["country"]:
            cues.append(F.concat(F.lit(COUNTRY_CUE), col(country)))
        if needs["evidence"]:
            cues.append(F.concat(F.lit(EVIDENCE_CUE), col(evidence)))
        return F.concat(F.lit(CORE_OPENING + "\n"), F.array_join(F.array(*cues), "\n") if cues else F.lit(""), F.lit("\n"), *ask)
    before, _, after = OPENINGS[condition].partition("{country}")
    opening = [F.lit(before), col(country), F.lit(after)] if after else [F.lit(before)]
    cue = {"evidence_numeric": NUMERIC_CUE, "evidence_v2": NUMERIC_CUE, "evidence_incomplete": RELATED_CUE}.get(condition)
    middle = [F.lit("\n\n")] if cue is None else [F.lit("\n\n" + cue), incomplete_evidence(evidence) if condition == "evidence_incomplete" else col(evidence), F.lit("\n")]
    return F.concat(*opening, *middle, *ask)


def condition_prompt(condition: Column | str, question: Column | str, options: Column | str, country: Column | str, evidence: Column | str) -> Column:
    """The prompt of the row's own condition, among the four core ones."""
    made = [(c, prompt(c, question, options, country=country, evidence=evidence)) for c in CONDITIONS]
    out = F.when(col(condition) == made[0][0], made[0][1])
    for c, p in made[1:]:
        out = out.when(col(condition) == c, p)
    return out


def serialize_messages(messages: Column | str, style: str = "chatml", answer: bool = True) -> Column:
    """An array of (role, content) as one text. answer: end with the opening of the model's turn.

    chatml: marked turns; header: turns with role headers; inst: instruction brackets around
    user turns, a system text joined to the first; turns: user and model turns only.
    """
    m = col(messages)
    body = F.concat
    if style == "chatml":
        out = F.transform(m, lambda t: body(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n")))
        tail = "<|im_start|>assistant\n"
    elif style == "header":
        out = F.transform(m, lambda t: body(F.lit("<|start_header_id|>"), t["role"], F.lit("<|end_header_id|>\n\n"), strip_ends(t["content"]), F.lit("<|eot_id|>")))
        tail = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    elif style == "inst":
        system = F.get(F.filter(m, lambda t: t["role"] == "system"), F.lit(0))["content"]
        lead = F.coalesce(F.concat(system, F.lit("\n\n")), F.lit(""))
        rest = F.filter(m, lambda t: t["role"] != "system")
        turn = lambda t, i: F.when(t["role"] == "user", body(F.lit("[INST] "), F.when(i == 0, lead).otherwise(""), t["content"], F.lit("[/INST]"))).otherwise(body(F.lit(" "), t["content"], F.lit("</s>")))
        return F.concat(F.lit("<s>"), F.array_join(F.transform(rest, turn), ""))
    elif style == "turns":
        role = lambda t: F.when(t["role"] == "assistant", "model").otherwise(t["role"])
        out = F.transform(m, lambda t: body(F.lit("<start_of_turn>"), role(t), F.lit("\n"), strip_ends(t["content"]), F.lit("<end_of_turn>\n")))
        tail = "<start_of_turn>model\n"
    else:
        raise ValueError(f"unknown style: {style}")
    return F.concat(F.array_join(out, ""), F.lit(tail if answer else ""))


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def synthetic_score(seed: int, text: Column | str, label: Column | str) -> Column:
    """A label score without a model: -4 to 0 by the first eight bytes of SHA-256 over seed, prompt and label."""
    key = F.concat(F.lit(f"{seed}\0"), col(text), F.lit("\0"), col(label))
    number = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return -4.0 + 4.0 * (number / float(2**64 - 1))


def first_difference(a: Column | str, b: Column | str) -> Column:
    """Of the first character in which two texts differ: its place ``at`` and its ``byte`` in UTF-8,
    both from 0; null for equal ones. The end of the shorter text counts as a difference."""
    x, y = col(a), col(b)
    pieces = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p.eqNullSafe(q))
    at = (F.array_position(pieces, False) - 1).cast("int")
    return F.when(x != y, F.struct(at.alias("at"), F.octet_length(F.left(x, at)).alias("byte")))


def marker_count(text: Column | str, marker: str) -> Column:
    """How often a marker, as that of a text's beginning, stands in a text."""
    whole = col(text)
    return ((F.length(whole) - F.length(F.replace(whole, F.lit(marker), F.lit("")))) / len(marker)).cast("int")
