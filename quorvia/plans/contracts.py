"""Registered queries over rules: sound tables in which faults are planted by name, and their SQL.

Faults are planted by model and by the last character of a population's name, so that the SQL
can say which keys must be found without repeating the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.functions.distributions import distribution_fault, distributions_close, label_map, normalize_log_scores, option_labels, path_score, reorder
from quorvia.functions.prompts import (
    CONDITIONS, CORE_OPENING, COUNTRY_CUE, EVIDENCE_CUE, INSTRUCTION, NUMERIC_CUE, OPENINGS, RELATED_CUE, first_difference, format_evidence, marker_count, prompt, serialize_messages,
)
from quorvia.functions.text import directed_unit_id, target_unit_id, text_hash
from quorvia.operators.metrics import METRICS, TARGET, UNIT, conflict_classes, directed_units, long_metrics, metric_summary, target_units, with_references
from quorvia.operators.resume import order_rules, unexpected_units
from quorvia.operators.summaries import conflict_with_main, positions
from quorvia.operators.validation import (
    BACKEND, SCORING_METHOD, cluster_rules, dataset_rules, domain_rules, endpoint_orientation, gather, manifest_rules, origin_rules, pair_rules, recomputed_rules, reference_rules, row_rules, target_rules,
)
from quorvia.plans import oracle as o
from quorvia.plans import survey as sv
from quorvia.plans.experiment import analyse
from quorvia.plans.queries import tied
from quorvia.sources.stored import stored

#: Four models in an order in which the lone one is not the last.
FOUR, LONE = ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD"), "AUTOMOBILE"


def at(model: str, end: str, country: str = "label_country") -> Column:
    """Rows of a model whose population's name ends so."""
    return (F.col("model_key") == model) & F.col(country).endswith(end)


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, manifest and predictions."""
    counts = sv.cube(spark, sf_dir)
    cells = stored(sv.survey(counts), "cells")
    pairs = sv.manifest(cells)
    return cells, pairs, stored(sv.predictions(counts, pairs), "predictions")


def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, rows = base(spark, sf_dir)
    rows = with_references(rows, cells).withColumns({"displayed": F.reverse("options"), "scores": F.reverse(F.transform("p", lambda x: F.log(x + 0.001)))})
    shares, labels = normalize_log_scores("scores"), option_labels(F.size("options"))
    reference = lambda c: F.map_from_arrays("options", c)
    presents = F.col("condition").isin("population_evidence", "conflict")
    source = F.when(F.col("condition") == "conflict", reference("evidence_reference")).otherwise(reference("label_reference"))
    wrong = F.when(F.col("condition") == "conflict", reference("label_reference")).otherwise(reference("evidence_reference"))
    text = F.concat_ws(" ", F.lit("Which priority in"), "question_id", "condition")
    off = F.when(at("FURNITURE", "3"), 1.0).otherwise(0.0)
    df = rows.select(
        *UNIT, "condition", "options",
        F.concat(directed_unit_id(*UNIT[1:]), F.when(at("AUTOMOBILE", "0"), "x").otherwise("")).alias("unit_id"),
        target_unit_id("question_id", "label_country").alias("target_unit_id"),
        F.when(at("BUILDING", "8"), F.slice("displayed", 1, 2)).otherwise(F.col("displayed")).alias("displayed"),
        F.when(at("AUTOMOBILE", "7"), label_map("options")).otherwise(label_map("displayed")).alias("label_to_option"),
        F.map_from_arrays(labels, shares).alias("label_probabilities"),
        F.map_from_arrays(labels, F.transform("scores", lambda x, i: x + F.when(i == 0, off).otherwise(0.0))).alias("label_log_scores"),
        F.map_from_arrays("displayed", F.when(at("HOUSEHOLD", "4"), F.reverse(shares)).otherwise(shares)).alias("prediction"),
        reference("label_reference").alias("label_reference"), reference("evidence_reference").alias("evidence_reference"),
        F.when(presents, F.when(at("MACHINERY", "5"), wrong).otherwise(source)).when(at("MACHINERY", "6"), source).alias("presented_evidence"),
        (presents != (at("FURNITURE", "5") & (F.col("condition") == "baseline"))).alias("evidence_presented"),
        text.alias("prompt"),
        text_hash(F.concat(text, F.when(at("BUILDING", "4"), "?").otherwise(""))).alias("prompt_sha256"),
    )
    first = F.col("condition") == "baseline"
    twice = lambda m, where: F.when(where, F.transform_values(m, lambda _, x: 2 * x)).otherwise(F.col(m))
    no_prompt = at("MACHINERY", "0")
    same = at("BUILDING", "0") & first
    df = df.withColumns(
        {
            "condition": F.when(at("FURNITURE", "0") & first, "other").otherwise(F.col("condition")),
            "evidence_country": F.when(same, F.col("label_country")).otherwise(F.col("evidence_country")),
            "unit_id": F.when(same, directed_unit_id("question_id", "label_country", "label_country")).otherwise(F.col("unit_id")),
            "target_unit_id": F.concat("target_unit_id", F.when(at("HOUSEHOLD", "0"), "x").otherwise("")),
            "prompt": F.when(no_prompt, " ").otherwise(F.col("prompt")),
            "prompt_sha256": F.when(no_prompt, text_hash(F.lit(" "))).otherwise(F.col("prompt_sha256")),
            "options": F.when(at("AUTOMOBILE", "3"), F.concat("options", F.slice("options", 1, 1))).otherwise(F.col("options")),
            "label_log_scores": F.when(at("BUILDING", "3"), F.map_filter("label_log_scores", lambda k, _: k != "A")).otherwise(F.col("label_log_scores")),
            "label_probabilities": twice("label_probabilities", at("HOUSEHOLD", "3")),
            "prediction": twice("prediction", at("MACHINERY", "3")),
            "label_reference": twice("label_reference", at("FURNITURE", "4") & first),
            "evidence_reference": twice("evidence_reference", at("BUILDING", "5") & first),
        }
    )
    return row_rules(df)


def origin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = base(spark, sf_dir)
    df = rows.withColumns(
        {
            "synthetic": at("AUTOMOBILE", "0"),
            "backend": F.when(at("BUILDING", "4"), "other").otherwise(BACKEND),
            "scoring_method": F.when(at("FURNITURE", "3"), None).otherwise(SCORING_METHOD),
            "generated_answer": F.when(at("HOUSEHOLD", "4"), "A"),
        }
    )
    known = rows.select("question_id").distinct().where("question_id <> 'Y1995'")
    return origin_rules(df, known, rows_per_model=161)


def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sv.metrics(spark, sf_dir)
    targets = target_units(found).where(~at("FURNITURE", "0"))
    targets = targets.union(targets.where(at("AUTOMOBILE", "3"))).withColumn("country_influence", F.when(at("MACHINERY", "4"), float("nan")).otherwise(F.col("country_influence")))
    directed = directed_units(found).where(~at("BUILDING", "4"))
    return cluster_rules(stored(targets, "targets"), stored(directed, "directed"), sv.MODELS)


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, pairs, _ = base(spark, sf_dir)
    end = lambda x: F.col("label_country").endswith(x)
    df = pairs.where(~end("0")).union(pairs.where(end("4")))
    df = df.withColumn("unit_id", F.concat("unit_id", F.when(end("3"), "x").otherwise("")))
    return manifest_rules(df, cells.where(~F.col("country").endswith("8")), 40)


def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evidence reference that differs from its population's own; a target whose metrics vary; an endpoint without orientation."""
    cells, pairs, rows = base(spark, sf_dir)
    units = stored(with_references(rows.where("condition = 'baseline' AND model_key = 'BUILDING'"), cells), "units")
    changed = units.withColumn("evidence_reference", F.when(F.col("evidence_country").endswith("4"), F.reverse("evidence_reference")).otherwise(F.col("evidence_reference")))
    same = units.withColumn("evidence_reference", F.when(F.col("evidence_country").endswith("7"), F.col("label_reference")).otherwise(F.col("evidence_reference")))
    varied = stored(sv.unit_rows(rows, cells), "unit-metrics")
    first = F.min("evidence_country").over(Window.partitionBy(*TARGET))
    varied = varied.withColumn("country_influence", F.col("country_influence") + F.when(F.col("label_country").endswith("0") & (F.col("evidence_country") == first), 1).otherwise(0))
    return gather(reference_rules(changed), endpoint_orientation(same), target_rules(target_units(varied)))


def recomputed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = directed_units(sv.metrics(spark, sf_dir))
    kept = found.where(~at("FURNITURE", "0")).withColumn("EO_raw", F.col("EO_raw") + F.when(at("AUTOMOBILE", "4"), 1e-6).otherwise(1e-14))
    return recomputed_rules(kept, found.where(~at("BUILDING", "3")), UNIT, ["EO_raw", "EO_normalized"])


def order_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, _ = base(spark, sf_dir)
    place = F.col("position") - 1
    manifest = stored(positions(pairs, [F.col("question_id")], ["unit_id"]).select("unit_id", "label_country", place.alias("place")), "order")
    rows = manifest.select("unit_id", "label_country", F.posexplode(F.array(*map(F.lit, CONDITIONS))).alias("step", "condition"), "place")
    rows = rows.withColumn("place", F.col("place") * 4 + F.col("step") + F.when(F.col("label_country").endswith("4"), 1).otherwise(0))
    rows = rows.where(~(F.col("label_country").endswith("0") & (F.col("condition") == "conflict")))
    rows = rows.unionByName(rows.where("label_country LIKE '%3' AND condition = 'baseline'").withColumn("condition", F.lit("extra")))
    return order_rules(rows, manifest, CONDITIONS)


def survey_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repaired survey and its pairs with faults in both."""
    cells, pairs, _ = base(spark, sf_dir)
    questions = cells.select("question_id", "options").distinct()
    odd = questions.withColumn("options", F.when(F.col("question_id") == "Y1996", F.concat("options", F.array(F.lit("  1-URGENT ")))).otherwise(F.col("options")))
    whole = F.map_from_arrays("options", F.transform("p", lambda x: F.when(F.col("country").endswith("1"), -x).otherwise(x)))
    samples = cells.where("question_id <> 'Y1997' OR country = 'NATION_0'").select("question_id", "country", whole.alias("distribution"))
    listed = pairs.join(questions, "question_id").withColumn("options", F.when(F.col("label_country").endswith("4"), F.reverse("options")).otherwise(F.col("options")))
    listed = listed.withColumn("divergence", F.col("divergence") + F.when(F.col("label_country").endswith("5"), 1e-9).otherwise(1e-14))
    domains = sv.domains(cells).where("question_id <> 'Y1995'")
    sound = cells.select("question_id", "country", F.map_from_arrays("options", "p").alias("distribution"))
    return gather(dataset_rules(odd, samples), pair_rules(listed, questions, sound), domain_rules(pairs, domains))


def analysis_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement of four models through the whole analysis."""
    cells, pairs, rows = base(spark, sf_dir)
    rows = rows.where(F.col("model_key").isin(*FOUR)).withColumn("prediction", F.map_from_arrays("options", "p"))
    found = analyse(rows, cells, pairs, sv.domains(cells), list(FOUR), lone_model=LONE, replicates=10, draws="arithmetic", strict=False)
    return found["cross_model_agreement_summary"].select("statistic", "count", (F.round("percent", 6) + 0.0).alias("percent"))


def conflict_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sv.metrics(spark, sf_dir)
    directed = tied(directed_units(found))
    means = metric_summary(long_metrics(target_units(found), directed))
    main = means.groupBy("model_key").pivot("metric", list(METRICS)).agg(F.first("mean"))
    df = conflict_with_main(conflict_classes(directed), main)
    return df.select("model_key", "evidence_side_n", "label_side_n", "tie_n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("evidence_side_pct", "label_side_pct", "tie_pct", "EO_raw", "EO_normalized")])


def unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, _ = base(spark, sf_dir)
    return unexpected_units(pairs.where(~F.col("label_country").endswith("0")), pairs).select("unit_id")


def displayed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in another order of options; whether they are sound, close to others, and their sum of logs."""
    cells = sv.survey(sv.cube(spark, sf_dir))
    df = cells.withColumn("displayed", F.reverse("options")).withColumn("q", reorder("p", "options", "displayed"))
    a, b = F.map_from_arrays("options", "p"), F.map_from_arrays("displayed", F.transform("q", lambda x: x + F.when(F.col("country").endswith("1"), 1e-6).otherwise(1e-12)))
    fault = distribution_fault(F.map_from_arrays("options", F.transform("p", lambda x: F.when(F.col("country").endswith("2"), -x).when(F.col("country").endswith("3"), 2 * x).otherwise(x))), "options", 1e-8)
    rest = F.round(path_score(F.transform("p", lambda x: F.log(x + 1))), 9)
    return df.select("question_id", "country", F.round(F.get("q", F.lit(0)), 9).alias("first_share"), distributions_close(a, b, 1e-9).alias("alike"), fault.alias("fault"), rest.alias("path_score"))


def chat_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sv.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.concat(F.lit(" "), "text", F.lit("\n")).alias("content")))).alias("m"))
    shown = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), serialize_messages("m", s).alias("prompt")) for s in ("header", "inst", "turns")]))
    df = turns.select("conv_id", shown.alias("s"), serialize_messages("m").alias("other")).select("conv_id", "s.*", "other")
    apart = first_difference("prompt", "other")
    return df.select("conv_id", "style", text_hash("prompt").alias("prompt_sha256"), F.length("prompt").cast("long").alias("n"), apart["at"].cast("long").alias("differs_at"), apart["byte"].cast("long").alias("differs_at_byte"), marker_count("prompt", "[INST]").cast("long").alias("marks"))


def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of prompt but the one that has a query of its own."""
    cells = sv.survey(sv.cube(spark, sf_dir)).withColumn("evidence", format_evidence("p", "options"))
    question = F.concat(F.lit("Which priority in "), "question_id", F.lit("?"))
    made = {c: prompt(c, question, "options", country="country", evidence="evidence") for c in (*CONDITIONS[:3], *OPENINGS)}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), text_hash(t).alias("prompt_sha256")) for c, t in made.items()]))
    return cells.select("question_id", "country", rows.alias("r")).select("question_id", "country", "r.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "row_contract": row_contract,
    "origin_report": origin_report,
    "cluster_report": cluster_report,
    "manifest_report": manifest_report,
    "reference_report": reference_report,
    "recomputed_report": recomputed_report,
    "order_report": order_report,
    "survey_report": survey_report,
    "analysis_agreement": analysis_agreement,
    "conflict_main": conflict_main,
    "unexpected_units": unexpected,
    "displayed_shares": displayed_shares,
    "chat_styles": chat_styles,
    "prompt_hashes": prompt_hashes,
}

# the SQL: keys by what was planted

ROWS = (
    o.PREDICTIONS
    + """,
rw AS (SELECT DISTINCT model_key, question_id, label_country, evidence_country, condition FROM wide
  CROSS JOIN (VALUES ('baseline'), ('country_label'), ('population_evidence'), ('conflict')) c(condition)),
keyed AS (SELECT *, concat_ws('|', model_key, question_id, label_country, evidence_country, condition) AS key FROM rw)"""
)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def planted(rule: str, where: str, source: str = "keyed", key: str = "key") -> str:
    return f"SELECT '{rule}' AS rule, {key} AS key FROM {source} WHERE {where}"


def ends(model: str, end: str) -> str:
    return f"model_key = '{model}' AND label_country LIKE '%{end}'"


def text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SHOWN = "condition IN ('population_evidence', 'conflict')"
_UNIT_KEY = "concat_ws('|', model_key, question_id, label_country, evidence_country)"
_PAIR_KEY = "concat_ws('|', question_id, label_country, evidence_country)"
_TARGET_KEY = "concat_ws('|', model_key, question_id, label_country)"
_ASK = "'Question: Which priority in ' || question_id || '?' || chr(10) || 'Options:' || chr(10) || options || chr(10) || chr(10) || " + text(INSTRUCTION[0]) + " || labels || " + text(INSTRUCTION[1])
_CUES = {"baseline": "''", "country_label": f"{text(COUNTRY_CUE)} || country", "population_evidence": f"{text(EVIDENCE_CUE)} || evidence"}
_PIECES = "string_split(evidence, ', ')[1] || ', ' || string_split(evidence, ', ')[2]"
_MIDDLE = {
    "evidence_numeric": f"{text(NUMERIC_CUE)} || evidence || chr(10)",
    "evidence_v2": f"{text(NUMERIC_CUE)} || evidence || chr(10)",
    "evidence_incomplete": f"{text(RELATED_CUE)} || {_PIECES} || chr(10)",
}
_PROMPTS = {c: f"{text(CORE_OPENING)} || chr(10) || {cue} || chr(10) || {_ASK}" for c, cue in _CUES.items()} | {
    c: " || country || ".join(text(part) for part in opening.split("{country}")) + f" || chr(10) || chr(10) || {_MIDDLE.get(c, text(''))} || {_ASK}" for c, opening in OPENINGS.items()
}
_STRIPPED = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_AGREE = (
    ("all_four_evidence_side", "ev = 4"), ("at_least_three_evidence_side", "ev >= 3"), ("all_four_label_side", "lb = 4"), ("any_cross_model_disagreement", "ev > 0 AND lb > 0"),
    ("three_evidence_one_label", "ev = 3"), ("one_evidence_three_label", "lb = 3"), ("three_to_one_splits_total", "ev = 3 OR lb = 3"), ("two_to_two_splits", "ev = 2 AND lb = 2"),
    (f"{LONE}_only_label_side", "lone = 'label-side' AND ev = 3"),
)
_PERCENT = "100.0 * count(*) FILTER (classification = '{}') / count(*)"

ORACLE_SQL = {
    "row_contract": o.query(
        ROWS,
        union(
            planted("unit id", ends("AUTOMOBILE", "0")),
            planted("displayed options", ends("BUILDING", "8")),
            planted("label map", ends("AUTOMOBILE", "7")),
            planted("round trip", f"{ends('AUTOMOBILE', '7')} OR {ends('HOUSEHOLD', '4')}"),
            planted("softmax", ends("FURNITURE", "3")),
            planted("presented evidence", f"{ends('MACHINERY', '5')} AND {_SHOWN}"),
            planted("evidence without condition", f"{ends('MACHINERY', '6')} AND NOT {_SHOWN}"),
            planted("evidence flag", f"{ends('FURNITURE', '5')} AND condition = 'baseline'"),
            planted("prompt hash", ends("BUILDING", "4")),
            planted("unknown condition", f"{ends('FURNITURE', '0')} AND condition = 'baseline'", key=f"{_UNIT_KEY} || '|other'"),
            planted("self pair", f"{ends('BUILDING', '0')} AND condition = 'baseline'", key="concat_ws('|', model_key, question_id, label_country, label_country, condition)"),
            planted("target unit id", ends("HOUSEHOLD", "0")),
            planted("prompt missing", ends("MACHINERY", "0")),
            planted("options", ends("AUTOMOBILE", "3")),
            planted("log scores", ends("BUILDING", "3")),
            planted("label probabilities", ends("HOUSEHOLD", "3")),
            planted("prediction distribution", ends("MACHINERY", "3")),
            planted("label_reference distribution", f"{ends('FURNITURE', '4')} AND condition = 'baseline'"),
            planted("evidence_reference distribution", f"{ends('BUILDING', '5')} AND condition = 'baseline'"),
        ),
    ),
    "origin_report": o.query(
        ROWS,
        union(
            planted("synthetic", ends("AUTOMOBILE", "0")), planted("backend", ends("BUILDING", "4")), planted("scoring method", ends("FURNITURE", "3")), planted("generated answer", ends("HOUSEHOLD", "4")),
            "SELECT DISTINCT 'unknown question', question_id FROM rw WHERE question_id = 'Y1995'",
            "SELECT 'rows of model', model_key || '|' || CAST(count(*) AS VARCHAR) FROM rw GROUP BY model_key HAVING count(*) <> 161",
        ),
    ),
    "cluster_report": o.query(
        o.METRICS
        + f""",
t AS (SELECT model_key, question_id, label_country FROM targets WHERE NOT ({ends("FURNITURE", "0")})),
u AS (SELECT model_key, question_id, label_country, evidence_country FROM metrics WHERE NOT ({ends("BUILDING", "4")})),
ends AS (SELECT model_key, question_id, label_country FROM u UNION SELECT model_key, question_id, evidence_country FROM u)""",
        union(
            planted("country_influence not finite", ends("MACHINERY", "4"), "t", _TARGET_KEY),
            planted("duplicate target", ends("AUTOMOBILE", "3"), "t", _TARGET_KEY),
            "SELECT 'missing reciprocal', concat_ws('|', model_key, question_id, evidence_country, label_country) FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.model_key = a.model_key AND b.question_id = a.question_id AND b.label_country = a.evidence_country AND b.evidence_country = a.label_country)",
            f"SELECT 'endpoint without target', {_TARGET_KEY} FROM (SELECT * FROM ends EXCEPT SELECT * FROM t)",
            f"SELECT 'target without endpoint', {_TARGET_KEY} FROM (SELECT * FROM t EXCEPT SELECT * FROM ends)",
            "SELECT 'target not in all models', question_id || '|' || label_country FROM t GROUP BY question_id, label_country HAVING count(*) <> 5",
            f"SELECT 'unit not in all models', {_PAIR_KEY} FROM u GROUP BY question_id, label_country, evidence_country HAVING count(*) <> 5",
        ),
    ),
    "manifest_report": o.query(
        o.PAIRS + ",\nm AS (SELECT * FROM manifest WHERE label_country NOT LIKE '%0' UNION ALL SELECT * FROM manifest WHERE label_country LIKE '%4')",
        union(
            f"SELECT 'duplicate pair' AS rule, {_PAIR_KEY} AS key FROM manifest WHERE label_country LIKE '%4'",
            planted("missing reciprocal", "evidence_country LIKE '%0'", "m", _PAIR_KEY),
            planted("unit id", "label_country LIKE '%3'", "m", _PAIR_KEY),
            "SELECT DISTINCT 'unknown label_country', question_id || '|' || label_country FROM m WHERE label_country LIKE '%8'",
            "SELECT DISTINCT 'unknown evidence_country', question_id || '|' || evidence_country FROM m WHERE evidence_country LIKE '%8'",
            "SELECT 'size', CAST(count(*) AS VARCHAR) FROM m HAVING count(*) <> 40",
        ),
    ),
    "reference_report": o.query(
        o.METRICS,
        union(
            f"SELECT 'evidence reference differs' AS rule, {_PAIR_KEY} AS key FROM manifest WHERE evidence_country LIKE '%4'",
            planted("endpoint orientation", "evidence_country LIKE '%7'", "manifest", _PAIR_KEY),
            planted("target metric varies with its partner", "label_country LIKE '%0' AND repetitions > 1", "targets", _TARGET_KEY),
        ),
    ),
    "recomputed_report": o.query(
        o.METRICS,
        union(
            planted("stored EO_raw differs", ends("AUTOMOBILE", "4"), "metrics", _UNIT_KEY), planted("not derived", ends("BUILDING", "3"), "metrics", _UNIT_KEY), planted("not stored", ends("FURNITURE", "0"), "metrics", _UNIT_KEY)
        ),
    ),
    "order_report": o.query(
        o.PAIRS,
        union(
            "SELECT 'row out of order' AS rule, unit_id || '|' || c AS key FROM manifest CROSS JOIN (VALUES ('baseline'), ('country_label'), ('population_evidence'), ('conflict')) v(c) WHERE label_country LIKE '%4'",
            "SELECT 'missing row', unit_id || '|conflict' FROM manifest WHERE label_country LIKE '%0'",
            "SELECT 'unexpected row', unit_id || '|extra' FROM manifest WHERE label_country LIKE '%3'",
        ),
    ),
    "survey_report": o.query(
        o.PAIRS,
        union(
            "SELECT 'options' AS rule, 'Y1996' AS key",
            "SELECT DISTINCT 'distribution', question_id || '|' || country FROM survey WHERE (country LIKE '%1' OR question_id = 'Y1996') AND (question_id <> 'Y1997' OR country = 'NATION_0')",
            "SELECT 'fewer than two samples', 'Y1997'",
            f"SELECT 'other options', {_PAIR_KEY} FROM manifest WHERE label_country LIKE '%4'",
            f"SELECT 'divergence', {_PAIR_KEY} FROM manifest WHERE label_country LIKE '%5'",
            "SELECT DISTINCT 'question without domain', question_id FROM manifest WHERE question_id = 'Y1995'",
        ),
    ),
    "analysis_agreement": o.query(
        o.METRICS
        + f""",
four AS (SELECT question_id, label_country, evidence_country, count(*) FILTER (classification = 'evidence-side') AS ev, count(*) FILTER (classification = 'label-side') AS lb,
  max(classification) FILTER (model_key = '{LONE}') AS lone FROM metrics WHERE model_key IN {FOUR} GROUP BY ALL)""",
        union(*[f"SELECT '{name}' AS statistic, count(*) FILTER ({rule}) AS count, {o.r(f'100.0 * count(*) FILTER ({rule}) / count(*)', 6, 'percent')} FROM four" for name, rule in _AGREE]),
    ),
    "conflict_main": o.query(
        o.TIED,
        "SELECT model_key, "
        + ", ".join(f"count(*) FILTER (classification = '{c}') AS {c.replace('-', '_')}_n, {o.r(_PERCENT.format(c), 9, c.replace('-', '_') + '_pct')}" for c in ("evidence-side", "label-side", "tie"))
        + f", {o.r('avg(EO_raw)', 9, 'EO_raw')}, {o.r('avg(EO_normalized)', 9, 'EO_normalized')} FROM tied GROUP BY model_key",
    ),
    "unexpected_units": o.query(o.PAIRS, "SELECT unit_id FROM manifest WHERE label_country LIKE '%0'"),
    "displayed_shares": o.query(
        o.CUBE,
        "SELECT question_id, country, round(arg_max(p, option), 9) AS first_share, country NOT LIKE '%1' AS alike, CASE WHEN country LIKE '%2' THEN 'negative' WHEN country LIKE '%3' THEN 'sum' END AS fault, round(sum(ln(p + 1)), 9) AS path_score FROM survey GROUP BY question_id, country",
    ),
    "chat_styles": rf"""WITH c AS (SELECT conv_id, turn, role, ' ' || text || chr(10) AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c WHERE role <> 'system'),
lead AS (SELECT conv_id, arg_min(content, turn) || chr(10) || chr(10) AS lead FROM c WHERE role = 'system' GROUP BY conv_id),
p AS (SELECT conv_id, 'header' AS style, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_STRIPPED} || '<|eot_id|>', '' ORDER BY turn)
    || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, 'turns', string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) || {_STRIPPED} || '<end_of_turn>' || chr(10), '' ORDER BY turn)
    || '<start_of_turn>model' || chr(10) FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, 'inst', '<s>' || coalesce(string_agg(CASE role WHEN 'user' THEN '[INST] ' || CASE k WHEN 1 THEN coalesce(lead, '') ELSE '' END || content || '[/INST]' ELSE ' ' || content || '</s>' END, '' ORDER BY turn), '')
    FROM n LEFT JOIN lead USING (conv_id) GROUP BY conv_id),
other AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS other FROM c GROUP BY conv_id),
apart AS (SELECT *, list_filter(range(1, greatest(length(prompt), length(other)) + 1), lambda i: substr(prompt, i, 1) <> substr(other, i, 1))[1] AS spot FROM p JOIN other USING (conv_id))
SELECT conv_id, style, sha256(prompt) AS prompt_sha256, CAST(length(prompt) AS BIGINT) AS n, spot - 1 AS differs_at, CAST(octet_length(encode(left(prompt, spot - 1))) AS BIGINT) AS differs_at_byte,
  CAST(len(regexp_extract_all(prompt, '\[INST\]')) AS BIGINT) AS marks FROM apart""",
    "prompt_hashes": o.query(o.TICKS, union(*[f"SELECT question_id, country, '{c}' AS condition, sha256({sql}) AS prompt_sha256 FROM lines" for c, sql in _PROMPTS.items()])),
}
