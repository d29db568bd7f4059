"""Published and recomputed values of a small run with two reciprocal pairs."""

import pytest
from pyspark.sql import functions as F

from quorvia.functions.text import stable_seed
from quorvia.functions.udfs import shuffle_options
from quorvia.operators.metrics import condition_pivot, directed_units, target_units, unit_metrics, with_references

# fixed values: options, references and predictions of the run
OPTIONS = ["Strongly agree", "Agree", "Disagree", "Strongly disagree"]
REFERENCE = {"Maldives": [0.9358074222668004, 0.03811434302908726, 0.01805416248746239, 0.00802407221664995], "South Korea": [0.015, 0.2, 0.47600000000000003, 0.309]}
PREDICTED = {
    ("Maldives", "South Korea"): {
        "baseline": [0.13275574399151288, 0.2539090289816399, 0.0874653938487403, 0.5258698331781069],
        "country_label": [0.08908772927013692, 0.6247592161673746, 0.16783124377965042, 0.11832181078283806],
        "population_evidence": [0.029151524207432996, 0.09174125432902519, 0.5618808940812303, 0.31722632738231155],
        "conflict": [0.10624123944659206, 0.05094723151663824, 0.6627646950450929, 0.1800468339916767],
    },
    ("South Korea", "Maldives"): {
        "baseline": [0.7051529525464153, 0.12892425619744696, 0.0591684163714746, 0.10675437488466315],
        "country_label": [0.12999372029451595, 0.2421580931488699, 0.5122233670236325, 0.11562481953298179],
        "population_evidence": [0.5672393436379204, 0.3654602462463531, 0.028578694053205393, 0.03872171606252115],
        "conflict": [0.03578297548935832, 0.11581484128291028, 0.32995629438999186, 0.5184458888377396],
    },
}
# fixed values: divergence of the references, then CI, EI, raw and normalised override by pair
APART = 0.7859567365581546
EXPECTED = {
    "Maldives": (-0.04788012120559859, -0.19960264802522065, 0.5389913317904598, 0.5615159591487003, "evidence-side"),
    "South Korea": (0.41085916197153843, -0.034425577955976006, -0.7058512109951451, -0.7479492372156717, "label-side"),
}
SEEDS = {"Maldives": (5580898605228246702, ["Agree", "Disagree", "Strongly agree", "Strongly disagree"]), "South Korea": (9442680665696670868, ["Disagree", "Strongly disagree", "Strongly agree", "Agree"])}


def test_metrics(spark):
    rows = [("m", "Q1322", a, b, c, p) for (a, b), by in PREDICTED.items() for c, p in by.items()]
    predictions = spark.createDataFrame(rows, "model_key string, question_id string, label_country string, evidence_country string, condition string, p array<double>")
    cells = spark.createDataFrame([("Q1322", c, p) for c, p in REFERENCE.items()], "question_id string, country string, p array<double>")
    metrics = unit_metrics(with_references(condition_pivot(predictions), cells))
    assert {round(r.jsd_references, 12) for r in metrics.collect()} == {round(APART, 12)}
    found = {r.label_country: r for r in directed_units(metrics).collect()}
    targets = {r.label_country: r for r in target_units(metrics).collect()}
    for country, (ci, ei, raw, normal, side) in EXPECTED.items():
        assert targets[country].country_influence == pytest.approx(ci, abs=1e-12)
        assert targets[country].evidence_influence == pytest.approx(ei, abs=1e-12)
        assert targets[country].evidence_advantage == pytest.approx(ei - ci, abs=1e-12)
        assert found[country].EO_raw == pytest.approx(raw, abs=1e-12)
        assert found[country].EO_normalized == pytest.approx(normal, abs=1e-12)
        assert found[country].classification == side and targets[country].invariant


def test_seeds_and_displayed_order(spark):
    df = spark.createDataFrame([(c, OPTIONS) for c in SEEDS], "country string, options array<string>")
    df = df.withColumn("seed", stable_seed(42, F.concat(F.lit("Q1322::"), "country")))
    for r in df.withColumn("shown", shuffle_options("options", "seed")).collect():
        assert (int(r.seed), r.shown) == SEEDS[r.country]
