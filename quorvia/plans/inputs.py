"""Loading what an experiment starts from: a survey, its pairs and settings, checked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.distributions import normalize_distribution
from quorvia.functions.text import canonical_option
from quorvia.operators.resume import pair_limit
from quorvia.operators.validation import dataset_rules, pair_rules, require
from quorvia.sources.readers import load_settings, read_dataset, read_manifest
from quorvia.sources.stored import stored


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions with canonical options, and cells (question_id, country, options, p normalised).

    Raises if a question has unusable options, an odd distribution or fewer than two samples.
    """
    questions, samples = read_dataset(spark, path)
    questions, samples = stored(questions, "questions"), stored(samples, "samples")
    if questions.isEmpty():
        raise ValueError("the survey is empty")
    require(dataset_rules(questions, samples))
    canonical = questions.withColumn("options", F.transform("options", canonical_option))
    cells = samples.join(canonical.select("question_id", "options"), "question_id")
    return canonical, cells.select("question_id", "country", "options", normalize_distribution("distribution", "options").alias("p"))


def load_pairs(spark: SparkSession, path: str, questions: DataFrame, cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Directed pairs of known samples with their ``place`` in the file; raises on a faulty pair."""
    held = stored(read_manifest(spark, path).withColumn("place", F.monotonically_increasing_id()), "pairs")
    require(pair_rules(held, questions, cells))
    options = questions.select("question_id", F.col("options").alias("own"))
    pairs = held.join(options, "question_id").withColumn("options", F.col("own")).drop("own")
    return pairs if limit is None else pair_limit(pairs, limit)


def load_inputs(spark: SparkSession, settings: str, dataset: str, pairs: str, mode: str | None = None) -> dict:
    """settings, questions, cells and pairs of a run; mode: whose number of pairs the settings limit."""
    found = load_settings(settings)
    questions, cells = load_dataset(spark, dataset)
    limit = None if mode is None else int(found.get("experiment", {}).get(mode, {}).get("question_pairs", 0))
    return {"settings": found, "questions": questions, "cells": cells, "pairs": load_pairs(spark, pairs, questions, cells, limit)}
