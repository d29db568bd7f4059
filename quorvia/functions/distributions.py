"""Distributions as arrays of doubles aligned to an option list, and what is computed on them.

At the edges a distribution is a map from option to probability; inside, it is an array in
the order of ``options``. Everything here is a Column expression. Checks come in two forms:
``..._fault`` gives a text or null, and strict functions raise at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of a divergence outside [0, 1], and of a tie between two references.
BOUND_TOLERANCE = 1e-12
TIE_TOLERANCE = 1e-12
EVIDENCE_SIDE, LABEL_SIDE, TIE = "evidence-side", "label-side", "tie"
CLASSES = (EVIDENCE_SIDE, LABEL_SIDE, TIE)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(p: Column | str) -> Column:
    return F.aggregate(col(p), F.lit(0.0), lambda a, x: a + x)


def aligned(distribution: Column | str, options: Column | str) -> Column:
    """A map as an array in option order; options it lacks are null."""
    return F.transform(col(options), lambda o: F.try_element_at(col(distribution), o))


def distribution_fault(distribution: Column | str, options: Column | str, sum_tolerance: float | None = None) -> Column:
    """Why a map is no distribution over the options, or null. With ``sum_tolerance`` it must also sum to 1."""
    d, o = col(distribution), col(options)
    p = F.map_values(d)
    fault = (
        F.when(d.isNull() | o.isNull(), "missing")
        .when(F.size(d) == 0, "empty")
        .when((F.size(d) != F.size(o)) | (F.size(F.array_except(o, F.map_keys(d))) > 0), "keys")
        .when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(F.exists(p, lambda x: x < 0), "negative")
        .when(total(p) <= 0, "no mass")
    )
    if sum_tolerance is not None:
        fault = fault.when(F.abs(total(p) - 1.0) > sum_tolerance, "sum")
    return fault


def normalized(p: Column | str) -> Column:
    """An array over its sum; null where that is not above 0."""
    return let(col(p), lambda v: let(total(v), lambda mass: F.when(mass > 0, F.transform(v, lambda x: x / mass))))


def normalize_distribution(distribution: Column | str, options: Column | str | None = None) -> Column:
    """A map as a normalised array; without options, in the order of its sorted keys. Raises on a fault."""
    d = col(distribution)
    o = F.array_sort(F.map_keys(d)) if options is None else col(options)
    fault = distribution_fault(d, o)
    return F.when(fault.isNull(), normalized(aligned(d, o))).otherwise(F.raise_error(F.concat(F.lit("invalid distribution: "), fault)))


def js_divergence(p: Column | str, q: Column | str, strict: bool = False) -> Column:
    """Base-2 Jensen-Shannon divergence of two arrays, normalised first; terms without mass add nothing.

    strict: raise where rounding leaves [0, 1] by more than the tolerance; else only clamp.
    """
    a, b = normalized(p), normalized(q)
    # log2(0) is null here, so each term is guarded
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))

    def bounded(value: Column) -> Column:
        # least and greatest skip nulls
        clamped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
        if not strict:
            return clamped
        outside = (value < -BOUND_TOLERANCE) | (value > 1 + BOUND_TOLERANCE)
        return F.when(outside, F.raise_error(F.lit("divergence outside [0, 1]"))).otherwise(clamped)

    return let(0.5 * total(terms), bounded)


def country_influence(baseline: Column | str, label: Column | str, target: Column | str) -> Column:
    """How much closer to the target the country label brings the prediction."""
    return js_divergence(baseline, target) - js_divergence(label, target)


def evidence_influence(baseline: Column | str, evidence: Column | str, target: Column | str) -> Column:
    return js_divergence(baseline, target) - js_divergence(evidence, target)


def evidence_override_raw(conflict: Column | str, *, label: Column | str, evidence: Column | str) -> Column:
    """Above 0 where the prediction lies nearer to the evidence's reference than to the label's."""
    return js_divergence(conflict, label) - js_divergence(conflict, evidence)


def override_normalized(to_label: Column, to_evidence: Column, apart: Column, clamp: bool = True, strict: bool = False) -> Column:
    """From the three divergences: difference of distances over the distance of the references.

    Null where the references are equal, an error if strict; clamp: keep within [-1, 1].
    """
    value = (F.sqrt(to_label) - F.sqrt(to_evidence)) / F.sqrt(apart)
    if clamp:
        value = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))
    undefined = F.raise_error(F.lit("undefined for equal references")) if strict else F.lit(None).cast("double")
    return F.when(apart > 0, value).otherwise(undefined)


def evidence_override_normalized(conflict: Column | str, *, label: Column | str, evidence: Column | str, clamp: bool = True, strict: bool = False) -> Column:
    return override_normalized(js_divergence(conflict, label), js_divergence(conflict, evidence), js_divergence(label, evidence), clamp, strict)


def all_metrics(baseline, label_prediction, evidence_prediction, conflict, *, label, evidence) -> Column:
    """One struct of the five metrics."""
    return F.struct(
        country_influence(baseline, label_prediction, label).alias("country_influence"),
        evidence_influence(baseline, evidence_prediction, label).alias("evidence_influence"),
        (evidence_influence(baseline, evidence_prediction, label) - country_influence(baseline, label_prediction, label)).alias("evidence_advantage"),
        evidence_override_raw(conflict, label=label, evidence=evidence).alias("EO_raw"),
        evidence_override_normalized(conflict, label=label, evidence=evidence).alias("EO_normalized"),
    )


def classify_conflict(eo: Column | str, tolerance: float = TIE_TOLERANCE) -> Column:
    e = col(eo)
    return F.when(e > tolerance, EVIDENCE_SIDE).when(e < -tolerance, LABEL_SIDE).when(e.isNotNull(), TIE)


def close(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """Both null, or apart by no more than the tolerance."""
    x, y = col(a), col(b)
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= tolerance)


def distributions_close(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """Maps with the same keys and values that are close."""
    x, y = col(a), col(b)
    same = (F.size(x) == F.size(y)) & (F.size(F.array_except(F.map_keys(x), F.map_keys(y))) == 0)
    return same & F.forall(F.map_keys(x), lambda k: F.abs(F.try_element_at(x, k) - F.try_element_at(y, k)) <= tolerance)


def largest_remainder(p: Column | str, decimals: int = 6) -> Column:
    """Ticks of 10^-decimals percent that add up to exactly 100 percent.

    Every share is cut down to a tick; what is missing goes, a tick each, to the largest
    rests, ties to the earlier position.
    """
    ticks = 100 * 10**decimals
    # the rest is negated, so that sorting puts the largest first
    rows = F.transform(normalized(p), lambda x, i: F.struct((F.floor(x * ticks) - x * ticks).alias("rest"), i.alias("at"), F.floor(x * ticks).alias("ticks")))

    def dealt(rows: Column) -> Column:
        missing = F.lit(ticks).cast("long") - F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["ticks"])
        raised = F.transform(F.slice(F.array_sort(rows), 1, F.greatest(missing.cast("int"), F.lit(0))), lambda r: r["at"])
        return let(raised, lambda up: F.transform(rows, lambda r: r["ticks"] + F.when(F.array_contains(up, r["at"]), 1).otherwise(0)))

    return let(rows, dealt)


def presented_evidence(p: Column | str, decimals: int = 6) -> Column:
    """The rounded distribution as shares."""
    return F.transform(largest_remainder(p, decimals), lambda t: t / float(100 * 10**decimals))


def reorder(p: Column | str, options: Column | str, displayed: Column | str) -> Column:
    """An array over ``options`` as a normalised array in displayed order."""
    return normalized(F.transform(col(displayed), lambda o: F.get(col(p), (F.array_position(col(options), o) - 1).cast("int"))))


def option_labels(n: Column | int) -> Column:
    """A, B, C, ... (1 to 26 of them; else an error)."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    size = F.lit(n) if isinstance(n, int) else n
    return F.when((size >= 1) & (size <= 26), F.slice(letters, 1, size)).otherwise(F.raise_error(F.lit("between 1 and 26 options are needed")))


def label_map(options: Column | str) -> Column:
    """Displayed label to option text."""
    o = col(options)
    return F.map_from_arrays(option_labels(F.size(o)), o)


def normalize_log_scores(scores: Column | str, temperature: float = 1.0) -> Column:
    """Softmax of an array of log scores, stable for large ones; temperature 0 means 1."""
    s = col(scores)
    if temperature not in (0, 1):
        s = F.transform(s, lambda x: x / temperature)
    return normalized(let(s, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))))


def map_label_probabilities(labels: Column | str, probabilities: Column | str, label_to_option: Column | str) -> Column:
    """Option text to probability, renormalised."""
    texts = F.transform(col(labels), lambda name: F.try_element_at(col(label_to_option), name))
    return F.map_from_arrays(texts, normalized(probabilities))


def recover_canonical(option_probabilities: Column | str, options: Column | str) -> Column:
    """A map by option text as an array in canonical order."""
    return aligned(option_probabilities, options)


def path_score(token_log_probabilities: Column | str) -> Column:
    """Log probability of a label's token sequence."""
    return total(token_log_probabilities)


def agreement_predicates(evidence_side: Column, label_side: Column, n_models: int, lone: Column | None = None) -> dict[str, Column]:
    """The agreement statistics by name, in their order. lone: one given model alone on the label's side."""
    found = {
        "all_evidence_side": evidence_side == n_models,
        "all_but_one_evidence_side": evidence_side >= n_models - 1,
        "all_label_side": label_side == n_models,
        "any_cross_model_disagreement": (evidence_side > 0) & (label_side > 0),
        "one_label_otherwise_evidence": evidence_side == n_models - 1,
        "one_evidence_otherwise_label": label_side == n_models - 1,
        "splits_of_one_total": (evidence_side == n_models - 1) | (label_side == n_models - 1),
        "even_splits": (evidence_side == n_models // 2) & (label_side == n_models // 2),
    }
    return found if lone is None else found | {"lone_label_side": lone}
