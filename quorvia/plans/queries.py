"""The registered queries over the derived survey. Doubles are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.distributions import classify_conflict, label_map, largest_remainder, map_label_probabilities, normalize_log_scores, option_labels, recover_canonical
from quorvia.functions.json_text import json_string
from quorvia.functions.prompts import CONDITIONS, format_evidence, incomplete_evidence, prompt, serialize_messages, synthetic_score
from quorvia.functions.text import canonical_option, directed_unit_id, is_nonresponse, stable_seed, target_unit_id, text_hash
from quorvia.functions.udfs import shuffle_options as shuffled
from quorvia.operators import bootstrap as boot
from quorvia.operators.blocks import block_bootstrap
from quorvia.operators.farthest import farthest_pairs
from quorvia.operators.metrics import METRICS, UNIT, class_proportions, condition_pivot, conflict_classes, directed_units, long_metrics, metric_summary, target_units
from quorvia.operators.pairs import candidate_pairs, directed, missing_reciprocals, top_pairs
from quorvia.operators.repair import exclusion_summary, repair_survey, source_counts, support
from quorvia.operators.resume import pending_units, progress
from quorvia.operators.summaries import agreement_by_unit, agreement_summary, conflict_with_main, extreme_cases, harmonized_order, main_metrics, stratified_metrics
from quorvia.operators.validation import inconstant, prediction_rules
from quorvia.plans import survey as sv
from quorvia.plans.oracle import REPLICATES, SQL
from quorvia.sources.stored import stored

#: Another order of models than the alphabet's.
MODEL_ORDER = ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")
#: The orders' priorities.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Stands for what a run has finished.
DONE = "label_country < 'NATION_2'"


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Without a negative zero, which prints and hashes apart."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def long_form(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """One row per option with the arrays' values."""
    rows = F.explode(F.arrays_zip("options", *arrays))
    return df.select(*keys, rows.alias("x")).select(*keys, F.col("x.options").alias("option"), *[F.col(f"x.{a}") for a in arrays])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.survey(sv.cube(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.manifest(cells(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sv.cube(spark, sf_dir)
    return sv.predictions(counts, sv.manifest(sv.survey(counts)))


def repaired(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    questions, samples = sv.raw_export(spark, sf_dir)
    return repair_survey(stored(questions, "questions"), stored(samples, "samples"))


def grains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = sv.metrics(spark, sf_dir)
    return target_units(found), directed_units(found)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_metrics(*grains(spark, sf_dir))


def normalize_cells(spark, sf_dir):
    return rounded(long_form(cells(spark, sf_dir), ["question_id", "country"], "p"), "p")


def jsd_pairs(spark, sf_dir):
    return rounded(candidate_pairs(cells(spark, sf_dir)), "divergence")


def pairs_top(spark, sf_dir):
    df = top_pairs(candidate_pairs(cells(spark, sf_dir)), 3, 20)
    return rounded(df.select("question_id", "a", "b", "divergence", F.col("place").cast("long").alias("place")), "divergence")


def bounded_top(spark, sf_dir):
    """The same by bounds on the metric, over the 7 questions of the survey."""
    df = farthest_pairs(stored(cells(spark, sf_dir), "cells"), 3, 20)
    return rounded(df.select("question_id", "a", "b", "divergence", F.col("place").cast("long").alias("place")), "divergence")


def customer_shares(spark, sf_dir) -> DataFrame:
    """question_id, country, p: customers, in the place of populations, by their shares of order value over priorities.

    The question is the market segment, so a fifth of all customers are its populations.
    """
    orders = sv.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    customers = sv.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("question_id"))
    sums = orders.join(customers, "o_custkey").groupBy("question_id", "o_custkey").pivot("o_orderpriority", PRIORITIES).agg(F.sum(F.floor("o_totalprice")))
    held = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 20_000.0 for c in PRIORITIES])
    return sums.select("question_id", F.format_string("C%08d", "o_custkey").alias("country"), held.alias("p"))


def farthest_customers(spark, sf_dir):
    df = farthest_pairs(customer_shares(spark, sf_dir), 3)
    return rounded(df.select("question_id", "a", "b", "divergence", F.col("place").cast("long").alias("place")), "divergence")


def pairs_directed(spark, sf_dir):
    return rounded(manifest(spark, sf_dir).select("question_id", "label_country", "evidence_country", "unit_id", "divergence"), "divergence")


def reciprocal_check(spark, sf_dir):
    return missing_reciprocals(manifest(spark, sf_dir).where(DONE)).select("question_id", "label_country", "evidence_country")


def quarantine_reason(spark, sf_dir):
    return repaired(spark, sf_dir)["decisions"]


def nonresponse_filter(spark, sf_dir):
    questions, _ = sv.raw_export(spark, sf_dir)
    return questions.select(F.explode("options").alias("o")).select(canonical_option("o").alias("option")).distinct().select("option", is_nonresponse("option").alias("nonresponse"))


def mass_filter(spark, sf_dir):
    return rounded(repaired(spark, sf_dir)["samples"].select("question_id", "country", "substantive_mass", "status"), "substantive_mass")


def support_check(spark, sf_dir):
    df = repaired(spark, sf_dir)["samples"]
    kept = F.col("status") == "kept"
    held = F.when(kept, F.concat_ws(",", support(F.col("options"), F.col("p"))))
    return df.groupBy("question_id").agg(F.count_if(kept).alias("eligible"), F.count_distinct(held).alias("supports"))


def exclusions(spark, sf_dir):
    found = repaired(spark, sf_dir)
    return exclusion_summary(found["decisions"], found["samples"])


def repaired_cells(spark, sf_dir):
    df = repaired(spark, sf_dir)["cells"]
    return rounded(long_form(df, ["question_id", "country_display", "sample_status"], "p"), "p")


def export_counts(spark, sf_dir):
    """The first option of a question in seven is a number in the export's JSON."""
    questions, samples = sv.raw_export(spark, sf_dir)
    number = F.substring("question_id", 2, 4).cast("int") % 7 == 3
    texts = F.transform("options", lambda o, i: F.when(number & (i == 0), F.lit("2.50")).otherwise(json_string(o)))
    typed = questions.withColumn("options", F.from_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), "ARRAY<VARIANT>"))
    return source_counts(typed, samples)


def pivoted(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    df = condition_pivot(rows, "p", [*UNIT, "options"])
    return rounded(long_form(df, UNIT, *CONDITIONS), *CONDITIONS)


def unit_metrics_target(spark, sf_dir):
    df = target_units(sv.metrics(spark, sf_dir))
    return rounded(df.select("model_key", "question_id", "label_country", *METRICS[:3], "repetitions"), *METRICS[:3])


def unit_metrics_directed(spark, sf_dir):
    return rounded(directed_units(sv.metrics(spark, sf_dir)), "EO_raw", "EO_normalized")


def every_pair_metrics(spark, sf_dir):
    """The same over all pairs of populations, whose number grows with the square of theirs."""
    return rounded(directed_units(sv.metrics(spark, sf_dir, None)), "EO_raw", "EO_normalized")


def components(spark, sf_dir):
    names = ["jsd_baseline", "jsd_label", "jsd_evidence", "jsd_conflict_label", "jsd_conflict_evidence", "jsd_references"]
    return rounded(sv.metrics(spark, sf_dir).select(*UNIT, *names), *names)


def tied(directed: DataFrame) -> DataFrame:
    """Some overrides below the tolerance, on either side of 0."""
    near = directed.withColumn("EO_raw", F.when(F.expr(sv.TIES), F.signum("EO_raw") * 5e-13).otherwise(F.col("EO_raw")))
    return near.withColumn("classification", classify_conflict("EO_raw"))


def classes(spark, sf_dir):
    return conflict_classes(tied(directed_units(sv.metrics(spark, sf_dir)))).select("model_key", "evidence_side_n", "label_side_n", "tie_n")


def proportions(spark, sf_dir):
    return rounded(class_proportions(tied(directed_units(sv.metrics(spark, sf_dir)))).select("model_key", "classification", "n", "proportion"), "proportion")


def summary(spark, sf_dir):
    return rounded(metric_summary(long(spark, sf_dir)), "mean", "population_sd", "minimum", "maximum")


def sums(spark, sf_dir):
    return rounded(boot.cluster_sums(long(spark, sf_dir)), "total")


def intervals(spark, sf_dir, draws: str = "arithmetic", replicates: int = REPLICATES) -> DataFrame:
    return boot.bootstrap(long(spark, sf_dir), replicates=replicates, draws=draws)


def bootstrap_ci(spark, sf_dir):
    names = ["estimate", "mean", "se", "ci_lower", "ci_upper"]
    return rounded(intervals(spark, sf_dir).select("model_key", "metric", "n", *names), *names)


def bootstrap_ci_pcg64(spark, sf_dir):
    names = ["estimate", "mean", "se", "ci_lower", "ci_upper"]
    return rounded(intervals(spark, sf_dir, "pcg64", 10_000).select("model_key", "metric", "n", *names), *names)


def bootstrap_weights(spark, sf_dir):
    """In blocks of clusters, with counts that SQL can repeat."""
    names = ["estimate", "mean", "se", "ci_lower", "ci_upper"]
    return rounded(block_bootstrap(long(spark, sf_dir), draws="weights").select("model_key", "metric", "n", *names), *names)


def bootstrap_clusters(spark, sf_dir):
    """Mean order value by market segment and priority, where every customer is a cluster: counts split down a tree of blocks."""
    customers = sv.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model_key"))
    orders = sv.table(spark, sf_dir, "orders").join(customers, "o_custkey").select("model_key", F.col("o_orderpriority").alias("metric"), F.format_string("C%010d", "o_custkey").alias("question_id"), F.col("o_totalprice").cast("double").alias("value"))
    names = ["estimate", "mean", "se", "ci_lower", "ci_upper"]
    return rounded(block_bootstrap(orders, replicates=1000).select("model_key", "metric", "n", "clusters", *names), *names, digits=4)


def main_metrics_wide(spark, sf_dir):
    df = main_metrics(intervals(spark, sf_dir))
    return rounded(df, *[c for c in df.columns if c != "model_key"])


def by_unit(spark, sf_dir) -> DataFrame:
    return agreement_by_unit(directed_units(sv.metrics(spark, sf_dir)), sv.MODELS)


def agreement_units(spark, sf_dir):
    return rounded(by_unit(spark, sf_dir), *[f"EO_normalized_{m}" for m in sv.MODELS], "EO_normalized_mean", "EO_normalized_variance")


def agreement(spark, sf_dir):
    return rounded(agreement_summary(by_unit(spark, sf_dir), sv.MODELS, "MACHINERY").select("statistic", "count", "percent"), "percent", digits=6)


def extremes(spark, sf_dir):
    return rounded(extreme_cases(by_unit(spark, sf_dir)).select("selection_rule", "unit_id", "EO_normalized_mean", "EO_normalized_variance"), "EO_normalized_mean", "EO_normalized_variance")


def stratified(spark, sf_dir):
    found = sv.metrics(spark, sf_dir)
    df = stratified_metrics(target_units(found), directed_units(found), sv.domains(found))
    return rounded(rounded(df, *METRICS), "evidence_side_pct", digits=6)


def harmonized(spark, sf_dir):
    """The order as a number: a table of rows has none of its own."""
    df = predictions(spark, sf_dir).select(*UNIT, "condition")
    return harmonized_order(df, MODEL_ORDER)


def coverage_diff(spark, sf_dir):
    units = predictions(spark, sf_dir).where("condition = 'baseline'").select(*UNIT)
    one, other = units.where("model_key = 'AUTOMOBILE'").drop("model_key"), units.where("model_key = 'BUILDING'").where(DONE).drop("model_key")
    return one.exceptAll(other).select(F.lit("AUTOMOBILE").alias("model_key"), *UNIT[1:])


def permutation_constancy(spark, sf_dir):
    """Seeds that follow the directed pair instead of the target differ within targets of several partners."""
    df = predictions(spark, sf_dir).withColumn("seed", stable_seed(42, directed_unit_id("question_id", "label_country", "evidence_country")))
    return inconstant(df, ["question_id", "label_country"], ["seed"])


def pending(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return pending_units(df, df.where(DONE)).select("unit_id")


def run_progress(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return progress(df, df.where(DONE))


def scores(spark, sf_dir) -> DataFrame:
    """key, options, scores: log scores of each customer's order priorities."""
    df = sv.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("option")).agg((F.avg("o_totalprice") / 10000).alias("score"))
    rows = df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("option", "score"))).alias("r"))
    return rows.select("key", F.col("r.option").alias("options"), F.col("r.score").alias("scores"))


def label_softmax(spark, sf_dir):
    return rounded(long_form(scores(spark, sf_dir).withColumn("p", normalize_log_scores("scores")), ["key"], "p"), "p")


def recover_distribution(spark, sf_dir):
    every = sv.table(spark, sf_dir, "orders").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("all_options"))
    df = scores(spark, sf_dir).crossJoin(F.broadcast(every))  # one row on the right
    found = map_label_probabilities(option_labels(F.size("options")), normalize_log_scores("scores"), label_map("options"))
    # a new "options" beside expressions of the old one would be taken for it
    df = df.withColumn("p", recover_canonical(found, "all_options")).select("key", F.col("all_options").alias("options"), "p")
    return rounded(long_form(df, ["key"], "p"), "p")


def remainder(spark, sf_dir):
    return long_form(cells(spark, sf_dir).withColumn("ticks", largest_remainder("p")), ["question_id", "country"], "ticks")


def evidence_lines(spark, sf_dir):
    return cells(spark, sf_dir).select("question_id", "country", format_evidence("p", "options").alias("evidence")).withColumn("incomplete", incomplete_evidence("evidence"))


def prompt_hash(spark, sf_dir):
    df = cells(spark, sf_dir).withColumn("evidence", format_evidence("p", "options"))
    text = prompt("conflict", F.concat(F.lit("Which priority in "), "question_id", F.lit("?")), "options", country="country", evidence="evidence")
    return df.select("question_id", "country", text_hash(text).alias("prompt_sha256"))


def chat_serialize(spark, sf_dir):
    turns = sv.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", serialize_messages("m").alias("prompt"))


def violations_report(spark, sf_dir):
    """Rules against a manifest cut short and a list of models with one too many; some rows are twice there, lacking or no distribution."""
    counts = sv.cube(spark, sf_dir)
    pairs = sv.manifest(sv.survey(counts))
    rows = stored(sv.predictions(counts, pairs), "predictions").where("NOT (model_key = 'BUILDING' AND condition = 'conflict' AND label_country LIKE '%3')")
    rows = rows.union(rows.where("model_key = 'AUTOMOBILE' AND condition = 'baseline' AND label_country LIKE '%0'"))
    twice = F.when(F.expr("model_key = 'FURNITURE' AND condition = 'country_label' AND label_country LIKE '%5'"), 2.0).otherwise(1.0)
    rows = rows.withColumn("prediction", F.map_from_arrays("options", F.transform("p", lambda x: x * twice)))
    return prediction_rules(rows, pairs.where(DONE), models=(*sv.MODELS, "NONE"))


def synthetic_scores(spark, sf_dir):
    df = manifest(spark, sf_dir).select("unit_id", F.explode(option_labels(5)).alias("label"))
    return rounded(df.withColumn("score", synthetic_score(7, "unit_id", "label")), "score")


def unit_seeds(spark, sf_dir):
    return manifest(spark, sf_dir).select("unit_id", stable_seed(42, "unit_id").cast("string").alias("seed"))


def shuffle_options(spark, sf_dir):
    df = cells(spark, sf_dir).withColumn("seed", stable_seed(42, target_unit_id("question_id", "country")))
    return df.select("question_id", "country", F.col("seed").cast("string").alias("seed"), F.array_join(shuffled("options", "seed"), "|").alias("displayed"))


def props_json(spark, sf_dir):
    """Typed JSON: the schema is given, never inferred."""
    df = sv.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k BIGINT").alias("props"))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("props.k").alias("total"))


def first_word_pairs(spark, sf_dir):
    """Names within a brand that share their first word: counted by group, without making the pairs."""
    df = sv.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lower(F.split_part(F.trim("p_name"), F.lit(" "), F.lit(1))).alias("w")).dropna()
    groups = df.groupBy("p_brand", "w").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pairs_top": pairs_top,
    "pairs_bounded": bounded_top,
    "farthest_customers": farthest_customers,
    "pairs_directed": pairs_directed,
    "jsd_pairs": jsd_pairs,
    "normalize_cells": normalize_cells,
    "quarantine_reason": quarantine_reason,
    "nonresponse_filter": nonresponse_filter,
    "support_check": support_check,
    "mass_filter": mass_filter,
    "exclusion_summary": exclusions,
    "repaired_cells": repaired_cells,
    "source_counts": export_counts,
    "condition_pivot": pivoted,
    "unit_metrics_target": unit_metrics_target,
    "unit_metrics_directed": unit_metrics_directed,
    "every_pair_metrics": every_pair_metrics,
    "divergence_components": components,
    "conflict_classes": classes,
    "class_proportions": proportions,
    "metric_summary": summary,
    "cluster_sums": sums,
    "bootstrap_ci": bootstrap_ci,
    "bootstrap_weights": bootstrap_weights,
    "bootstrap_clusters": bootstrap_clusters,
    "main_metrics_wide": main_metrics_wide,
    "agreement_by_unit": agreement_units,
    "agreement_summary": agreement,
    "extreme_cases": extremes,
    "stratified_metrics": stratified,
    "harmonized_sort": harmonized,
    "reciprocal_check": reciprocal_check,
    "coverage_diff": coverage_diff,
    "permutation_constancy": permutation_constancy,
    "pending_units": pending,
    "run_progress": run_progress,
    "label_softmax": label_softmax,
    "recover_distribution": recover_distribution,
    "largest_remainder": remainder,
    "format_evidence": evidence_lines,
    "prompt_hash": prompt_hash,
    "chat_serialize": chat_serialize,
    "violations_report": violations_report,
    "synthetic_scores": synthetic_scores,
    "stable_seed": unit_seeds,
    "props_json": props_json,
    "first_word_pairs": first_word_pairs,
    "shuffle_options": shuffle_options,
    "bootstrap_ci_pcg64": bootstrap_ci_pcg64,
}

ORACLE_SQL = SQL
