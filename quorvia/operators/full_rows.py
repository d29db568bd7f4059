"""The contract of a full run's result rows: answer positions, token paths, stored divergences.

Rows of one unit are brought together once to work out its divergences; everything else is
looked at row by row, in one pass. Token paths are sorted, so that a path that repeats or
begins another stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.functions.distributions import classify_conflict, js_divergence, override_normalized
from quorvia.functions.prompts import CONDITIONS
from quorvia.operators.metrics import UNIT
from quorvia.operators.validation import failing, gather

#: The stored divergences, as prediction and reference; the first two are of the row's own prediction.
COMPONENTS = {
    "prediction_to_label_country": ("p", "label_reference"),
    "prediction_to_evidence_country": ("p", "evidence_reference"),
    "baseline_to_label_country": ("baseline", "label_reference"),
    "country_label_to_label_country": ("country_label", "label_reference"),
    "evidence_to_label_country": ("population_evidence", "label_reference"),
    "conflict_to_label_country": ("conflict", "label_reference"),
    "conflict_to_evidence_country": ("conflict", "evidence_reference"),
}
CANDIDATE = "struct<token_ids:array<int>,token_count:int,targets:array<int>,predictive:array<int>,log_probabilities:array<double>,score:double>"


def inside_another(paths: Column) -> Column:
    """Whether a path begins another one. Sorted, it stands right before one that it begins."""
    ordered = F.array_sort(F.array_distinct(paths))
    later = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    begins = F.zip_with(ordered, later, lambda a, b: F.coalesce(F.slice(b, F.lit(1), F.size(a)) == a, F.lit(False)))
    return F.exists(begins, lambda x: x)


def trace_rules(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Violations (rule, key) in the scoring traces of single rows.

    rows: the unit's key, condition, labels, prompt_tokens, answer_target, answer_predictive,
    candidates (map of label to ``CANDIDATE``), token_aliases and raw_scores (maps by label).

    Every label is scored, by a path of its own that begins no other; its targets are the
    places after the prompt and each is predicted from the place before; the path's log
    probabilities add up to its score, which is the label's raw score.
    """
    labels = F.col("labels")
    at = lambda m, x: F.try_element_at(F.col(m), x)
    each = lambda bad: F.exists(labels, lambda x: F.coalesce(bad(x, at("candidates", x)), F.lit(True)))
    own = lambda m: (F.size(m) == F.size(labels)) & (F.size(F.array_except(labels, F.map_keys(m))) == 0)
    complete = F.coalesce(own("candidates"), F.lit(False))
    prompt = F.coalesce(F.col("prompt_tokens") > 0, F.lit(False))
    sound = complete & ~each(lambda x, c: (F.size(c["token_ids"]) < 1) | F.exists(c["token_ids"], lambda t: t.isNull() | (t < 0)))
    paths = F.transform(labels, lambda x: at("candidates", x)["token_ids"])
    start = F.col("prompt_tokens").cast("int")
    targets = lambda c: F.sequence(start, start + F.size(c["token_ids"]) - 1)
    total = lambda c: F.aggregate(c["log_probabilities"], F.lit(0.0), lambda a, v: a + v)
    # what builds on a broken part is not looked at
    after = lambda ok, bad: F.when(ok, bad).otherwise(F.lit(False))
    rules = {
        "candidate labels": ~complete,
        "prompt tokens": ~prompt,
        "answer position": after(prompt, (F.col("answer_target") != start) | (F.col("answer_predictive") != start - 1)),
        "token ids": after(complete, ~sound),
        "token paths repeat": after(sound, F.size(F.array_distinct(paths)) != F.size(paths)),
        "token path inside another": after(sound, inside_another(paths)),
        "token count": after(sound, each(lambda x, c: c["token_count"] != F.size(c["token_ids"]))),
        "token alias": after(sound, ~F.coalesce(own("token_aliases"), F.lit(False)) | each(lambda x, c: at("token_aliases", x) != c["token_ids"])),
        "target positions": after(sound & prompt, each(lambda x, c: c["targets"] != targets(c))),
        "predictive positions": after(sound & prompt, each(lambda x, c: c["predictive"] != F.transform(targets(c), lambda t: t - 1))),
        "path score": after(sound, each(lambda x, c: (F.size(c["log_probabilities"]) != F.size(c["token_ids"])) | ~(F.abs(total(c) - c["score"]) <= tolerance))),
        "raw score": after(sound, each(lambda x, c: ~(F.abs(c["score"] - at("raw_scores", x)) <= tolerance))),
    }
    return failing(rows, rules, *UNIT, "condition")


def component_rules(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Stored divergences, metrics and classes that differ from those of the unit's own predictions.

    rows: the unit's key, condition, p, label_reference, evidence_reference (arrays),
    divergences and metrics (maps by name), classification. A unit without all conditions is a
    violation of its own, and its components are not looked at.
    """
    pivot = [F.max(F.when(F.col("condition") == c, F.col("p"))).alias(c) for c in CONDITIONS]
    unit = rows.groupBy(*UNIT).agg(*pivot, F.count("*").alias("n"), F.count_distinct("condition", "label_reference", "evidence_reference").alias("kinds"))
    df = rows.join(unit, UNIT)
    whole = (F.col("n") == len(CONDITIONS)) & (F.col("kinds") == len(CONDITIONS))
    for c in CONDITIONS:
        whole = whole & F.col(c).isNotNull()
    values = {name: js_divergence(a, b) for name, (a, b) in COMPONENTS.items()}
    df = df.select("*", whole.alias("whole"), *[v.alias(f"own_{name}") for name, v in values.items()], js_divergence("label_reference", "evidence_reference").alias("own_apart"))
    own = lambda name: F.col(f"own_{name}")
    base, to_label, to_evidence = own("baseline_to_label_country"), own("conflict_to_label_country"), own("conflict_to_evidence_country")
    metrics = {
        "country_influence": base - own("country_label_to_label_country"),
        "evidence_influence": base - own("evidence_to_label_country"),
        "EO_raw": to_label - to_evidence,
        "EO_normalized": override_normalized(to_label, to_evidence, F.col("own_apart")),
    }
    # a metric that isn't defined is stored as null
    apart = lambda stored, value: ~((stored.isNull() & value.isNull()) | F.coalesce(F.abs(stored - value) <= tolerance, F.lit(False)))
    wanted = F.when(F.col("condition") == "conflict", classify_conflict(metrics["EO_raw"]))
    after = lambda bad: F.when(F.col("whole"), bad).otherwise(F.lit(False))
    rules = {
        "conditions of the unit": ~F.col("whole"),
        "component names": after(F.size("divergences") != len(COMPONENTS)),
        **{f"component {name}": after(apart(F.try_element_at("divergences", F.lit(name)), own(name))) for name in COMPONENTS},
        **{f"metric {name}": after(apart(F.try_element_at("metrics", F.lit(name)), value)) for name, value in metrics.items()},
        "classification": after(~F.col("classification").eqNullSafe(wanted)),
    }
    return failing(df, rules, *UNIT, "condition")


def full_row_rules(rows: DataFrame) -> DataFrame:
    """Both contracts."""
    return gather(trace_rules(rows), component_rules(rows))
