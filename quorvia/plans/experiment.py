"""A whole run over directed pairs: displayed order, prompts, label scores, predictions, metrics.

The scorer is either an expression or a Python function over batches; a model behind it is
an external matter. Units are independent rows, so a run is resumed by scoring the pairs
that have no finished rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.functions.distributions import label_map, map_label_probabilities, normalize_log_scores, option_labels, presented_evidence, recover_canonical, reorder
from quorvia.functions.prompts import CONDITIONS, condition_prompt, format_evidence, synthetic_score
from quorvia.functions.text import directed_unit_id, stable_seed, target_unit_id, text_hash
from quorvia.functions.udfs import shuffle_options
from quorvia.operators.bootstrap import bootstrap
from quorvia.operators.metrics import METRICS, UNIT, condition_pivot, conflict_classes, directed_units, long_metrics, metric_summary, target_units, unit_metrics, with_references
from quorvia.operators.resume import fingerprint
from quorvia.operators.summaries import agreement_by_unit, agreement_summary, extreme_cases, main_metrics, stratified_metrics
from quorvia.operators.validation import cluster_rules, distinct_reference_rules, domain_rules, gather, manifest_rules, prediction_rules, reference_rules, require, target_rules
from quorvia.sources.stored import stored


def native_scorer(seed: int) -> Callable[[DataFrame], DataFrame]:
    """Scores without a model, by hashes: deterministic, for tests and dry runs."""

    def score(prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("scores", F.transform("labels", lambda label: synthetic_score(seed, "prompt", label)))

    return score


def batch_scorer(function: Callable[[list[str], list[list[str]]], list[list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """Scores from a function of prompts and labels, called once per Arrow batch."""

    def score(prompts: DataFrame) -> DataFrame:
        schema = prompts.limit(0).withColumn("scores", F.array().cast("array<double>")).schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(scores=function(pdf["prompt"].tolist(), [list(x) for x in pdf["labels"]]))

        return prompts.mapInPandas(run, schema)

    return score


def prepare_units(cells: DataFrame, manifest: DataFrame, questions: DataFrame, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """One row per directed pair and condition with its prompt.

    cells: question_id, country, options, p; questions: question_id, question. The displayed
    order depends on the target alone, so all its prompts share it.
    """
    p = cells.select("question_id", "country", "options", "p")
    label = p.toDF("question_id", "label_country", "options", "label_reference")
    evidence = p.select("question_id", F.col("country").alias("evidence_country"), F.col("p").alias("evidence_reference"))
    df = manifest.select(*UNIT[1:]).join(label, ["question_id", "label_country"]).join(evidence, ["question_id", "evidence_country"]).join(questions.select("question_id", "question"), "question_id")
    df = df.withColumns({"unit_id": directed_unit_id(*UNIT[1:]), "target_unit_id": target_unit_id("question_id", "label_country")})
    df = df.withColumn("permutation_seed", stable_seed(seed, "target_unit_id"))
    df = df.withColumn("displayed", shuffle_options("options", "permutation_seed") if shuffle else F.col("options"))
    df = df.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    shown = F.when(F.col("condition") == "conflict", F.col("evidence_reference")).otherwise(F.col("label_reference"))
    presents = F.col("condition").isin("population_evidence", "conflict")
    df = df.withColumn("__shown", reorder(shown, "options", "displayed"))
    text = condition_prompt("condition", "question", "displayed", "label_country", format_evidence("__shown", "displayed"))
    return df.withColumns(
        {
            "labels": option_labels(F.size("displayed")),
            "label_to_option": label_map("displayed"),
            "prompt": text,
            "prompt_sha256": text_hash(text),
            "evidence_presented": presents,
            "presented_evidence": F.when(presents, F.map_from_arrays("displayed", presented_evidence("__shown"))),
        }
    ).drop("__shown")


def predict(prompts: DataFrame, scorer: Callable[[DataFrame], DataFrame], model_key: str, temperature: float = 1.0) -> DataFrame:
    """Scores to distributions: softmax over labels, labels to texts, texts to canonical order."""
    df = scorer(prompts)
    by_text = map_label_probabilities("labels", normalize_log_scores("scores", temperature), "label_to_option")
    df = df.withColumn("prediction", by_text)
    return df.withColumns({"model_key": F.lit(model_key), "p": recover_canonical("prediction", "options"), "raw_scores": F.map_from_arrays("labels", "scores")})


def analyse(predictions: DataFrame, cells: DataFrame, manifest: DataFrame, domains: DataFrame, models: list[str], *, lone_model: str | None = None, replicates: int = 10_000, seed: int = 42, draws: str = "pcg64", strict: bool = True) -> dict[str, DataFrame]:
    """All tables of the cross-model analysis. strict: raise on any violation; else they are a table.

    lone_model: the model of which the agreement summary says how often it is alone on the label's side.
    """
    units = stored(with_references(condition_pivot(predictions), cells), "units")
    metrics = stored(unit_metrics(units, strict=strict), "unit-metrics")
    targets, directed = stored(target_units(metrics), "targets"), directed_units(metrics)
    violations = gather(
        manifest_rules(manifest, cells),
        prediction_rules(predictions, manifest, models=models),
        target_rules(targets),
        reference_rules(units),
        distinct_reference_rules(metrics),
        domain_rules(manifest, domains),
        cluster_rules(targets, directed, models),
    )
    violations = stored(violations, "violations")
    if strict:
        require(violations)
    long = long_metrics(targets, directed)
    intervals = bootstrap(long, replicates=replicates, seed=seed, draws=draws)
    by_unit = agreement_by_unit(directed, models)
    return {
        "violations": violations,
        "target_unit_metrics": targets,
        "directed_unit_metrics": directed,
        "bootstrap_metrics_long": intervals,
        "main_metrics": main_metrics(intervals, METRICS),
        "conflict_classification": conflict_classes(directed),
        "metric_summary": metric_summary(long),
        "cross_model_agreement_by_unit": by_unit,
        "cross_model_agreement_summary": agreement_summary(by_unit, models, lone_model),
        "illustrative_cases": extreme_cases(by_unit),
        "source_stratified_metrics": stratified_metrics(targets, directed, domains),
    }


def run_signature(settings: dict, **identities: str) -> str:
    """What finished rows must carry to count for a run."""
    return fingerprint({"settings": settings, "identities": identities})


__all__ = ["analyse", "batch_scorer", "native_scorer", "predict", "prepare_units", "run_signature"]
