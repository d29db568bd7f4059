"""Short runs: what must hold before and after them, as rows of named booleans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.functions.prompts import CONDITIONS
from quorvia.operators.metrics import UNIT
from quorvia.operators.validation import BACKEND

#: Rules of a run's rows by the assertion that they break.
BROKEN_BY = {
    "candidate_tokenization_valid": ("token ids", "token paths repeat", "token path inside another", "token count", "token alias"),
    "correct_answer_position": ("prompt tokens", "answer position", "target positions", "predictive positions"),
    "all_labels_scored": ("candidate labels", "path score", "raw score"),
}
#: The backend that a short run without a model names, and how many records it declares.
SMOKE_BACKEND, SMOKE_RECORDS = "deterministic_smoke", 8


def smoke_contract(pairs: DataFrame, models: DataFrame, settings: Mapping, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """One row: whether a short run may start. pairs: a manifest; models: name, backend; settings: of the whole run."""
    smoke = settings.get("experiment", {}).get("smoke", {})
    units = pairs.agg(F.count("*").alias("n"), F.count_distinct("question_id", "label_country", "evidence_country").alias("d"))
    backends = models.agg(F.count("*").alias("m"), F.count_if(F.col("backend") == SMOKE_BACKEND).alias("own"))
    return units.crossJoin(backends).select(  # one row each
        ((F.col("n") == 2) & (F.col("d") == 2)).alias("two_unique_units"),
        ((F.col("m") == 1) & (F.col("own") == 1)).alias("one_synthetic_model"),
        F.lit(list(settings.get("conditions", [])) == list(conditions)).alias("conditions_in_order"),
        F.lit(smoke.get("synthetic_backend") is True and smoke.get("scientific_inference") is False).alias("marked_as_synthetic"),
        F.lit(smoke.get("expected_records") == SMOKE_RECORDS).alias("declares_eight_records"),
    )


def smoke_assertions(rows: DataFrame, violations: DataFrame, units: DataFrame, *, backend: str = BACKEND, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """model_key and a boolean for each assertion over its rows.

    rows: the unit's key, condition, backend, model_identifier, synthetic, generated_answer,
    template_verified; violations: (rule, key) of these rows, keys beginning with the model;
    units: the directed units that must be there, and no others.
    """
    known = units.select(*UNIT[1:], F.lit(True).alias("known"))
    n_units = units.count()
    joined = rows.join(F.broadcast(known), UNIT[1:], "left")
    by_unit = joined.groupBy(*UNIT).agg(F.count("*").alias("n"), F.count_distinct("condition").alias("d"), F.count_if(~F.col("condition").isin(*conditions)).alias("other"), F.count_if(F.col("known").isNull()).alias("unknown"))
    k = len(conditions)
    counted = by_unit.groupBy("model_key").agg(
        F.count("*").alias("units"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("unknown").alias("unknown"), F.count_if((F.col("n") != k) | (F.col("d") != k) | (F.col("other") > 0)).alias("incomplete")
    )
    every = lambda ok: F.every(F.coalesce(ok, F.lit(False)))
    flags = rows.groupBy("model_key").agg(
        every((F.col("backend") == backend) & (F.col("model_identifier") == F.col("model_key")) & ~F.col("synthetic")).alias("genuine_backend_only"),
        every(F.col("template_verified")).alias("template_verified"),
        every(F.col("generated_answer").isNull()).alias("no_generation"),
    )
    hit = lambda names: F.count_if(F.col("rule").isin(*names))
    broken = violations.groupBy(F.split_part("key", F.lit("|"), F.lit(1)).alias("model_key")).agg(*[hit(names).alias(f"broken_{name}") for name, names in BROKEN_BY.items()])
    whole: Column = F.col("n") == k * n_units
    return counted.join(flags, "model_key").join(broken, "model_key", "left").select(
        "model_key", "genuine_backend_only", whole.alias("exactly_all_rows"), (F.col("n") == F.col("d")).alias("unique_keys"), ((F.col("units") == n_units) & (F.col("unknown") == 0)).alias("reciprocal_units"),
        ((F.col("incomplete") == 0) & (F.col("units") == n_units)).alias("all_conditions_per_unit"), "template_verified",
        *[(F.coalesce(f"broken_{name}", F.lit(0)) == 0).alias(name) for name in BROKEN_BY], "no_generation",
    )
