"""Summary tables across models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.functions.distributions import EVIDENCE_SIDE, LABEL_SIDE, TIE, agreement_predicates
from quorvia.functions.prompts import CONDITIONS
from quorvia.functions.text import clean_question, directed_unit_id, source_name
from quorvia.operators.metrics import DIRECTED_METRICS, METRICS, TARGET_METRICS
from quorvia.operators.pairs import RANK_DECIMALS
from quorvia.sources.stored import stored

PAIR = ["question_id", "label_country", "evidence_country"]
#: The names of the agreement statistics for four models, in order.
FOUR_MODEL_NAMES = (
    "all_four_evidence_side", "at_least_three_evidence_side", "all_four_label_side", "any_cross_model_disagreement", "three_evidence_one_label",
    "one_evidence_three_label", "three_to_one_splits_total", "two_to_two_splits",
)
#: Fixed value: how the row of one model alone on the label's side is named after it.
LONE_NAME = "{}_only_label_side"
#: The names of the rules that pick cases.
CASE_RULES = ("Largest mean EO", "Lowest mean EO", "Largest model disagreement")


def agreement_by_unit(directed: DataFrame, models: Sequence[str], keys: Sequence[str] = tuple(PAIR)) -> DataFrame:
    """A row per directed pair: each model's value and class as columns, counts of classes, mean and
    population variance over the models that have a value (computed before pivoting)."""
    per_model = [x for m in models for x in (F.max(F.when(F.col("model_key") == m, F.col("EO_normalized"))).alias(f"EO_normalized_{m}"), F.max(F.when(F.col("model_key") == m, F.col("classification"))).alias(f"classification_{m}"))]
    side = lambda c: F.count_if(F.col("classification") == c)
    df = directed.groupBy(*keys).agg(
        *per_model,
        side(EVIDENCE_SIDE).alias("evidence_side_models"),
        side(LABEL_SIDE).alias("label_side_models"),
        side(TIE).alias("tie_models"),
        F.avg("EO_normalized").alias("EO_normalized_mean"),
        F.var_pop("EO_normalized").alias("EO_normalized_variance"),
    )
    return df.withColumn("unit_id", directed_unit_id(*PAIR))


def agreement_summary(by_unit: DataFrame, models: Sequence[str], lone_model: str | None = None) -> DataFrame:
    """statistic, count, percent: all statistics in one aggregation, then laid out as rows.

    lone_model: adds how often that model, one of ``models``, is alone on the label's side.
    """
    if lone_model is not None and lone_model not in models:
        raise ValueError(f"no such model: {lone_model}")
    lone = None
    if lone_model is not None:
        lone = F.col(f"classification_{lone_model}") == LABEL_SIDE
        for m in models:
            if m != lone_model:
                lone = lone & (F.col(f"classification_{m}") == EVIDENCE_SIDE)
    made = agreement_predicates(F.col("evidence_side_models"), F.col("label_side_models"), len(models), lone)
    one = by_unit.agg(F.count("*").alias("__n"), *[F.count_if(p).alias(k) for k, p in made.items()])
    names = list(FOUR_MODEL_NAMES) if len(models) == 4 else [k for k in made if k != "lone_label_side"]
    names += [LONE_NAME.format(lone_model)] * (lone_model is not None)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("statistic"), F.col(k).alias("count"), F.try_divide(100.0 * F.col(k), "__n").alias("percent")) for i, (k, n) in enumerate(zip(made, names, strict=True))])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def extreme_cases(by_unit: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """The largest and the lowest mean and the largest variance; ties to the smaller unit id."""
    mean, variance = (F.round(c, RANK_DECIMALS) for c in ("EO_normalized_mean", "EO_normalized_variance"))
    row = F.struct(*[F.col(c) for c in by_unit.columns])
    # one pass: the smallest of a key in which nulls come last and the larger value first
    first = lambda value: F.min_by(row, F.struct(value.isNull(), value, F.col("unit_id")))
    picks = [F.struct(first(v).alias("row"), F.lit(name).alias("selection_rule")) for name, v in zip(CASE_RULES, (-mean, mean, -variance), strict=True)]
    found = by_unit.agg(F.array(*picks).alias("picks")).select(F.explode("picks").alias("p")).where("p.row IS NOT NULL").select("p.row.*", "p.selection_rule")
    if questions is not None:
        found = found.join(questions.select("question_id", clean_question("question").alias("question")), "question_id", "left")
    return found


def stratified_metrics(targets: DataFrame, directed: DataFrame, domains: DataFrame) -> DataFrame:
    """Means per model and domain, each metric at its own grain. domains: question_id, domain.

    Questions without a domain are in no row here; ``domain_rules`` finds them.
    """
    t = targets.join(domains, "question_id").groupBy("model_key", "domain").agg(F.count("*").alias("target_units"), *[F.avg(m).alias(m) for m in TARGET_METRICS])
    d = directed.join(domains, "question_id").groupBy("model_key", "domain").agg(
        F.count("*").alias("directed_units"), *[F.avg(m).alias(m) for m in DIRECTED_METRICS], (100 * F.count_if(F.col("classification") == EVIDENCE_SIDE) / F.count("*")).alias("evidence_side_pct")
    )
    return t.join(d, ["model_key", "domain"]).select("model_key", source_name("domain").alias("source"), "target_units", "directed_units", *METRICS, "evidence_side_pct")


def main_metrics(bootstrapped: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """A row per model with estimate and both bounds of each metric."""
    df = bootstrapped.groupBy("model_key").pivot("metric", list(metrics)).agg(F.first("estimate").alias("e"), F.first("ci_lower").alias("l"), F.first("ci_upper").alias("u"))
    return df.select("model_key", *[x for m in metrics for x in (F.col(f"{m}_e").alias(m), F.col(f"{m}_l").alias(f"{m}_ci_95_lower"), F.col(f"{m}_u").alias(f"{m}_ci_95_upper"))])


def place_in(order: Sequence[str], c: Column | str) -> Column:
    """Position of a value in a given order, from 1."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(c) if isinstance(c, str) else c)


def positions(df: DataFrame, parts: Sequence[Column], within: Sequence[Column | str]) -> DataFrame:
    """``position`` from 1 in the order of ``parts``, then ``within``.

    Rows are numbered inside their part; of the parts only the counts are put in one order.
    """
    keys = [f"part_{i}" for i in range(len(parts))]
    df = stored(df.withColumns(dict(zip(keys, parts, strict=True))), "to-order")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"of_{k}") for k in keys], before.alias("before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*within))
    found = df.withColumn("number", number).join(starts, same)
    return found.withColumn("position", (F.col("number") + F.col("before")).cast("long")).drop("number", "before", *keys, *[f"of_{k}" for k in keys])


def harmonized_order(predictions: DataFrame, models: Sequence[str], conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Predictions with their ``position`` by model and condition in their own orders."""
    return positions(predictions, [place_in(models, "model_key"), F.col("question_id")], [*PAIR[1:], place_in(conditions, "condition")])


def conflict_with_main(classes: DataFrame, main: DataFrame) -> DataFrame:
    """Class counts and percentages beside the two override estimates of the same model."""
    return classes.join(main.select("model_key", *[F.col(m) for m in DIRECTED_METRICS]), "model_key")
