"""Influence and override metrics at their two grains: targets and directed pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.functions.distributions import CLASSES, classify_conflict, js_divergence, override_normalized
from quorvia.functions.prompts import CONDITIONS

UNIT = ["model_key", "question_id", "label_country", "evidence_country"]
TARGET = UNIT[:3]
TARGET_METRICS = ("country_influence", "evidence_influence", "evidence_advantage")
DIRECTED_METRICS = ("EO_raw", "EO_normalized")
METRICS = (*TARGET_METRICS, *DIRECTED_METRICS)


#: Fixed value: the one override of analyses from before the repair.
LEGACY_METRIC = "evidence_override"


def directed_metrics(directed: DataFrame) -> tuple[str, ...]:
    """The override columns that a table of directed units has: both of today, or else the older one."""
    if set(DIRECTED_METRICS) <= set(directed.columns):
        return DIRECTED_METRICS
    if LEGACY_METRIC in directed.columns:
        return (LEGACY_METRIC,)
    raise ValueError(f"directed units need {' and '.join(DIRECTED_METRICS)}, or {LEGACY_METRIC}")


def condition_pivot(predictions: DataFrame, value: str = "p", keys: Sequence[str] = UNIT, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """One row per unit with a column for each condition: one shuffle, not a join per condition."""
    return predictions.groupBy(*keys).pivot("condition", list(conditions)).agg(F.first(value))


def with_references(units: DataFrame, cells: DataFrame) -> DataFrame:
    """Units with the reference distributions of their label and evidence populations."""
    ref = cells.select("question_id", "country", F.col("p").alias("ref"))
    label = ref.toDF("question_id", "label_country", "label_reference")
    evidence = ref.toDF("question_id", "evidence_country", "evidence_reference")
    return units.join(label, ["question_id", "label_country"]).join(evidence, ["question_id", "evidence_country"])


def unit_metrics(units: DataFrame, strict: bool = False) -> DataFrame:
    """The six divergences once, as columns, and from them all metrics and the class.

    units: keys, a column for each condition, label_reference, evidence_reference.
    strict: raise where rounding takes a divergence out of its range.
    """
    apart = {
        "jsd_baseline": ("baseline", "label_reference"),
        "jsd_label": ("country_label", "label_reference"),
        "jsd_evidence": ("population_evidence", "label_reference"),
        "jsd_conflict_label": ("conflict", "label_reference"),
        "jsd_conflict_evidence": ("conflict", "evidence_reference"),
        "jsd_references": ("label_reference", "evidence_reference"),
    }
    df = units.withColumns({name: js_divergence(a, b, strict) for name, (a, b) in apart.items()})
    df = df.withColumns(
        {
            "country_influence": F.col("jsd_baseline") - F.col("jsd_label"),
            "evidence_influence": F.col("jsd_baseline") - F.col("jsd_evidence"),
            "EO_raw": F.col("jsd_conflict_label") - F.col("jsd_conflict_evidence"),
            "EO_normalized": override_normalized(F.col("jsd_conflict_label"), F.col("jsd_conflict_evidence"), F.col("jsd_references")),
        }
    )
    return df.withColumns({"evidence_advantage": F.col("evidence_influence") - F.col("country_influence"), "classification": classify_conflict("EO_raw")})


def target_units(metrics: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row per target: metrics of the partner that comes first by name, and whether all agree."""
    chosen = F.min_by(F.struct(*TARGET_METRICS), "evidence_country").alias("m")
    spread = [(F.max(m) - F.min(m) <= tolerance).alias(f"__{m}") for m in TARGET_METRICS]
    df = metrics.groupBy(*TARGET).agg(chosen, *spread, F.count("*").alias("repetitions"), F.array_sort(F.collect_set("evidence_country")).alias("evidence_countries"))
    same = F.lit(True)
    for m in TARGET_METRICS:
        same = same & F.coalesce(f"__{m}", F.lit(True))
    return df.select(*TARGET, "m.*", "repetitions", "evidence_countries", same.alias("invariant"))


def directed_units(metrics: DataFrame) -> DataFrame:
    return metrics.select(*UNIT, *DIRECTED_METRICS, "classification")


def conflict_classes(directed: DataFrame, by: Sequence[str] = ("model_key",)) -> DataFrame:
    """Counts and percentages of the classes, as fixed columns, so zeros are there."""
    counts = [F.count_if(F.col("classification") == c).alias(c.replace("-", "_") + "_n") for c in CLASSES]
    df = directed.groupBy(*by).agg(*counts, F.count("*").alias("total"))
    percent = [(100 * F.col(c.replace("-", "_") + "_n") / F.col("total")).alias(c.replace("-", "_") + "_pct") for c in CLASSES]
    return df.select(*by, *[x for c, p in zip(CLASSES, percent, strict=True) for x in (c.replace("-", "_") + "_n", p)])


def class_proportions(directed: DataFrame, by: Sequence[str] = ("model_key",)) -> DataFrame:
    """Class, count and proportion in a fixed order of rows, zeros included."""
    wide = conflict_classes(directed, by)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("classification"), F.col(c.replace("-", "_") + "_n").alias("n"), (F.col(c.replace("-", "_") + "_pct") / 100).alias("proportion")) for i, c in enumerate(CLASSES)]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.*")


def long_metrics(targets: DataFrame, directed: DataFrame) -> DataFrame:
    """model_key, question_id, metric, value, each metric at its own grain. Older analyses have one override and no advantage."""

    def melt(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.select("model_key", "question_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x")).select("model_key", "question_id", "x.*")

    of_targets = [m for m in TARGET_METRICS if m in targets.columns or directed_metrics(directed) == DIRECTED_METRICS]
    return melt(targets, of_targets).unionByName(melt(directed, directed_metrics(directed)))


def metric_summary(long: DataFrame) -> DataFrame:
    """n, mean, population deviation, smallest and largest."""
    return long.groupBy("model_key", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("population_sd"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
