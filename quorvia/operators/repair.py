"""Cleaning of a survey export: which questions and samples stay, and their distributions.

A question falls under the first reason that holds, in the order of ``REASONS``. All rules
are expressions on one row per question (options) or per sample (distributions); one
aggregation by question joins the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.functions.distributions import aligned, distribution_fault, normalized, total
from quorvia.functions.text import canonical_option, display_country, is_ineligible_sample, is_nonresponse, is_table_total, sample_status
from quorvia.functions.variants import is_text

#: Questions set aside by hand, by reason.
QUARANTINE = {
    "known_mixed_schema": (
        "Q0001", "Q0155", "Q0229", "Q0256", "Q0287", "Q0297", "Q0304", "Q0321", "Q0371", "Q0452", "Q0509", "Q0581",
        "Q0624", "Q0672", "Q0692", "Q0768", "Q0821", "Q0860", "Q0911", "Q0963", "Q1042", "Q1103", "Q1118",
    ),
    "alias_mapping_requires_review": ("Q0006", "Q0193", "Q0280", "Q0391", "Q0545", "Q0719", "Q1133"),
    "country_specific_placeholder_unresolved": ("Q0550",),
    "relative_time_without_survey_wave": ("Q0311", "Q0475", "Q1124"),
}
#: Question texts put into neutral wording.
QUESTION_TEXTS = {
    "Q0154": "Is it more important for the respondent's country to have strong economic ties with China or with the United States?",
    "Q0160": "How well does the statement ‘The military is under the control of civilian leaders’ describe the respondent's country?",
    "Q0268": "Do you think China's power and influence is a major threat, a minor threat, or not a threat to the respondent's country?",
    "Q0410": "Overall, do you think of China as more of a partner of the respondent's country, more of an enemy of the respondent's country, or neither?",
    "Q0595": "Overall, do you think of the U.S. as more of a partner of the respondent's country, more of an enemy of the respondent's country, or neither?",
    "Q0630": "Does the government of China respect the personal freedoms of its people?",
    "Q0710": "Is the respondent's country making progress in providing drug treatments to people with HIV, losing ground, or staying about the same?",
    "Q0914": "Does the government of Russia respect the personal freedoms of its people?",
    "Q1510": "How would you rate corruption in the respondent's country on a 10-point scale where 1 means there is no corruption and 10 means there is abundant corruption?",
}
#: What repaired questions carry.
REPAIR_STATUS, TEXT_REPAIR = "exact_shared_response_schema", "audited_deictic_or_placeholder_normalization"
#: The one option text that is rewritten.
OPTION_TEXT = ("Q1510", "my country", "the respondent's country")

MIN_MASS = 0.5
#: The reasons for which a question, and below a sample, is set aside, in order.
REASONS = (
    *QUARANTINE,
    "invalid_options",
    "table_total_parser_artifact",
    "fewer_than_two_substantive_options",
    "invalid_distribution_schema",
    "fewer_than_two_eligible_samples",
    "incompatible_positive_option_support",
)
INELIGIBLE, LOW_MASS = "explicit_non_national_or_old_removed", "insufficient_substantive_mass_removed"


def repaired_option(question_id: Column, option: Column) -> Column:
    found = canonical_option(option)
    return F.when(question_id == OPTION_TEXT[0], F.replace(found, F.lit(OPTION_TEXT[1]), F.lit(OPTION_TEXT[2]))).otherwise(found)


def quarantine_reason(question_id: Column) -> Column:
    reason = F.lit(None).cast("string")
    for name, ids in reversed(QUARANTINE.items()):
        reason = F.when(question_id.isin(*ids), name).otherwise(reason)
    return reason


def option_reason(options: Column) -> Column:
    """The first reason in the options themselves. Options are canonical; empty ones are null."""
    return (
        F.when((F.size(options) < 2) | F.exists(options, lambda o: o.isNull()) | (F.size(F.array_distinct(options)) != F.size(options)), "invalid_options")
        .when(F.exists(options, is_table_total), "table_total_parser_artifact")
        .when(F.size(substantive(options)) < 2, "fewer_than_two_substantive_options")
    )


def substantive(options: Column) -> Column:
    return F.filter(options, lambda o: ~is_nonresponse(o))


def question_rules(questions: DataFrame) -> DataFrame:
    """questions (question_id, domain, question, options) with canonical options and ``reason``."""
    q = F.col("question_id")
    df = questions.withColumn("options", F.transform("options", lambda o: repaired_option(q, o)))
    return df.withColumn("reason", F.coalesce(quarantine_reason(q), option_reason(F.col("options"))))


def sample_rules(samples: DataFrame, ruled: DataFrame, min_mass: float = MIN_MASS) -> DataFrame:
    """Samples (question_id, country, place, distribution) of questions that still stand, with
    ``status``: kept, ineligible, invalid, low mass, or unread (behind an invalid one, in source order).

    Keeps the aligned probabilities ``p`` over all options and the share of substantive mass.
    """
    q = F.col("question_id")
    standing = ruled.where("reason IS NULL").select("question_id", "options")
    keys = F.transform(F.map_entries("distribution"), lambda e: F.struct(repaired_option(q, e["key"]).alias("key"), e["value"].alias("value")))
    df = samples.join(standing, "question_id").withColumn("__entries", keys)
    # of keys that became equal the last one counts, in the place of the first
    texts = F.array_distinct(F.filter(F.transform("__entries", lambda e: e["key"]), lambda k: k.isNotNull()))
    last = lambda k: F.element_at(F.filter("__entries", lambda e: e["key"] == k), -1)["value"]
    df = df.withColumn("__map", F.map_from_arrays(texts, F.transform(texts, last)))
    fault = F.when(F.exists("__entries", lambda e: e["key"].isNull()), "keys").otherwise(distribution_fault("__map", "options"))
    df = df.withColumn("p", aligned("__map", "options")).withColumn("__ineligible", is_ineligible_sample("country")).withColumn("__fault", F.when(~F.col("__ineligible"), fault))
    broken = df.where("__fault IS NOT NULL").groupBy("question_id").agg(F.min("place").alias("__broken"))
    df = df.join(broken, "question_id", "left")
    mass = total(F.transform(F.arrays_zip("options", "p"), lambda x: F.when(is_nonresponse(x["options"]), 0.0).otherwise(x["p"])))
    df = df.withColumn("substantive_mass", F.when(F.col("__fault").isNull() & ~F.col("__ineligible"), mass / total("p")))
    status = (
        F.when(F.col("place") > F.col("__broken"), "unread")
        .when(F.col("__ineligible"), "ineligible")
        .when(F.col("__fault").isNotNull(), "invalid")
        .when(F.col("substantive_mass") <= min_mass, "low mass")
        .otherwise("kept")
    )
    return df.select("question_id", "country", "place", "options", "p", "substantive_mass", status.alias("status"))


def support(options: Column, p: Column) -> Column:
    """Sorted substantive options with positive mass."""
    pairs = F.filter(F.arrays_zip(options.alias("o"), p.alias("p")), lambda x: (x["p"] > 0) & ~is_nonresponse(x["o"]))
    return F.array_sort(F.transform(pairs, lambda x: x["o"]))


def decisions(ruled: DataFrame, judged: DataFrame) -> DataFrame:
    """question_id and reason (null: it stays) of every question."""
    kept = F.col("status") == "kept"
    # equal supports: the smallest and the largest are the same
    s = F.when(kept, support(F.col("options"), F.col("p")))
    by = judged.groupBy("question_id").agg(
        F.max((F.col("status") == "invalid").cast("int")).alias("broken"), F.count_if(kept).alias("eligible"), F.min(s).alias("low"), F.max(s).alias("high")
    )
    late = (
        F.when(F.col("broken") == 1, "invalid_distribution_schema")
        .when(F.coalesce("eligible", F.lit(0)) < 2, "fewer_than_two_eligible_samples")
        .when(F.col("low") != F.col("high"), "incompatible_positive_option_support")
    )
    return ruled.select("question_id", "reason").join(by, "question_id", "left").select("question_id", F.coalesce("reason", late).alias("reason"))


def repair_survey(questions: DataFrame, samples: DataFrame, min_mass: float = MIN_MASS) -> dict[str, DataFrame]:
    """The tables of a repaired survey:

    decisions (question_id, reason), samples (with status), questions (repaired texts and
    substantive options), cells (question_id, country, country_display, sample_status,
    substantive_mass, options, p normalised).
    """
    ruled = question_rules(questions)
    judged = sample_rules(samples, ruled, min_mass)
    found = decisions(ruled, judged)
    stays = found.where("reason IS NULL").select("question_id")
    texts = F.create_map(*[F.lit(x) for pair in QUESTION_TEXTS.items() for x in pair])
    new = F.try_element_at(texts, F.col("question_id"))
    repaired = ruled.drop("reason").join(stays, "question_id", "left_semi").withColumns(
        {
            "options": substantive(F.col("options")),
            "source_question": F.when(new.isNotNull(), F.col("question")),
            "question": F.coalesce(new, "question"),
            "text_repair": F.when(new.isNotNull(), TEXT_REPAIR),
            "repair_status": F.lit(REPAIR_STATUS),
        }
    )
    pairs = F.filter(F.arrays_zip("options", "p"), lambda x: ~is_nonresponse(x["options"]))
    cells = (
        judged.where("status = 'kept'")
        .join(stays, "question_id", "left_semi")
        .withColumn("__pairs", pairs)
        .select(
            "question_id",
            "country",
            display_country("country").alias("country_display"),
            sample_status("country").alias("sample_status"),
            "substantive_mass",
            F.col("__pairs.options").alias("options"),
            normalized(F.col("__pairs.p")).alias("p"),
        )
    )
    return {"decisions": found, "samples": judged, "questions": repaired, "cells": cells}


def exclusion_summary(found: DataFrame, judged: DataFrame) -> DataFrame:
    """kind (question or sample), reason, count."""
    questions = found.where("reason IS NOT NULL").groupBy("reason").count().select(F.lit("question").alias("kind"), "reason", "count")
    name = F.when(F.col("status") == "ineligible", INELIGIBLE).when(F.col("status") == "low mass", LOW_MASS)
    samples = judged.withColumn("reason", name).where("reason IS NOT NULL").groupBy("reason").count()
    return questions.unionByName(samples.select(F.lit("sample").alias("kind"), "reason", "count"))


def source_counts(questions: DataFrame, samples: DataFrame) -> DataFrame:
    """One row of counts of the export itself.

    Questions with options that aren't texts are counted where options are VARIANTs, or where
    ``numeric_options`` says so.
    """
    kinds = dict(questions.dtypes)
    numeric = F.lit(False)
    if kinds["options"] == "array<variant>":
        numeric = F.exists("options", lambda o: ~is_text(o))
    elif "numeric_options" in kinds:
        numeric = F.col("numeric_options")
    labels = samples.agg(
        F.count("*").alias("units"),
        F.count_if(F.col("country").contains("(Non-national sample)")).alias("non_national"),
        F.count_if(F.col("country").contains("(Old national sample)")).alias("old_national"),
        F.count_if(F.col("country").contains("(Current national sample)")).alias("current_national"),
    )
    return labels.crossJoin(questions.agg(F.count("*").alias("questions"), F.count_if(numeric).alias("numeric_option_questions")))  # one row each
