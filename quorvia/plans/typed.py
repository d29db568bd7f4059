"""Registered queries over typed JSON: result files of unlike types, canonical texts, signatures."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.json_text import canonical_hash, canonical_json, json_string
from quorvia.functions.prompts import CONDITIONS
from quorvia.functions.text import directed_unit_id, stable_seed, target_unit_id, text_hash
from quorvia.functions.variants import kind, value_text
from quorvia.operators.metrics import UNIT
from quorvia.operators.validation import signature_rules
from quorvia.plans import oracle as o
from quorvia.plans import survey as sv
from quorvia.plans.contracts import ROWS, at, base, ends, planted
from quorvia.sources.readers import read_model_results
from quorvia.sources.stored import shared_dir

#: What each model's files say of its quantization, in JSON: a text, an object, a number, nothing.
QUANTIZATION = {"AUTOMOBILE": '"Q4_K_M"', "BUILDING": '{"name": "Q4", "bits": 4.0}', "FURNITURE": "4", "HOUSEHOLD": "null"}


def result_lines(rows: DataFrame) -> dict[str, DataFrame]:
    """Result rows of four models as JSON lines, each model with types of its own.

    One writes seeds as texts and short names of conditions, one has a number among its options,
    one a number with a fraction, and leaves out a field.
    """
    found = {}
    for model, quantization in QUANTIZATION.items():
        own = rows.where(F.col("model_key") == model)
        seed = stable_seed(42, target_unit_id("question_id", "label_country")).cast("string")
        options = F.transform("options", lambda x: json_string(x))
        if first := {"FURNITURE": "1", "HOUSEHOLD": "2.0"}.get(model):
            options = F.concat(F.array(F.lit(first)), F.slice(options, F.lit(2), F.size("options")))
        condition = F.when((F.col("condition") == "population_evidence") & F.lit(model == "BUILDING"), "evidence").otherwise(F.col("condition"))
        prediction = F.map_from_arrays("options", "p")
        fields = {
            "unit_id": json_string(directed_unit_id(*UNIT[1:])),
            "question_id": json_string("question_id"),
            "label_country": json_string("label_country"),
            "evidence_country": json_string("evidence_country"),
            "condition": json_string(condition),
            "quantization": F.lit(quantization),
            "permutation_seed": F.concat(F.lit('"'), seed, F.lit('"')) if model == "BUILDING" else seed,
            "original_options": F.concat(F.lit("["), F.array_join(options, ", "), F.lit("]")),
            "normalized_prediction": canonical_json(prediction, rows.select(prediction.alias("m")).schema["m"].dataType),
            "evidence_presented": None if model == "HOUSEHOLD" else F.col("condition").isin("population_evidence", "conflict").cast("string"),
        }
        parts = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items() if value is not None]
        found[model] = own.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))
    return found


def typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four models, written with unlike types and read as one table."""
    cells, pairs, rows = base(spark, sf_dir)
    paths = {}
    for model, lines in result_lines(rows).items():
        paths[model] = f"{shared_dir(spark)}/tables/results-{model}-{uuid.uuid4().hex}"
        lines.write.text(paths[model])
    read = read_model_results(spark, paths, rows_per_model=pairs.count() * len(CONDITIONS), domains=sv.domains(cells))
    last = F.try_element_at("normalized_prediction", F.element_at(F.array_sort(F.map_keys("normalized_prediction")), -1))
    return read.select(
        "model_key", "unit_id", "condition", "domain", F.coalesce(kind("quantization"), F.lit("none")).alias("quantization_type"), value_text("quantization").alias("quantization"),
        F.col("permutation_seed").cast("string").alias("permutation_seed"), F.array_join("original_options", "|").alias("options"), F.round(last, 9).alias("last_share"), "evidence_presented",
    )


def distribution_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations' distributions as canonical JSON, and its hash."""
    cells = sv.survey(sv.cube(spark, sf_dir)).select("question_id", "country", F.map_from_arrays("options", "p").alias("m"))
    text = canonical_json("m", cells.schema["m"].dataType)
    return cells.select("question_id", "country", text.alias("json"), text_hash(text).alias("sha256"))


def signed(rows: DataFrame) -> DataFrame:
    """Rows with the settings that they were made under and the hash of these."""
    settings = F.struct(
        F.col("model_key").alias("model"), F.lit(42).cast("long").alias("seed"), F.lit(1.0).alias("temperature"), F.lit(1e-12).alias("tolerance"),
        F.map_from_arrays("options", "p").alias("shares"), F.array(*map(F.lit, CONDITIONS)).alias("conditions"),
    )
    df = rows.select(*UNIT, "condition", settings.alias("signature"))
    return df.withColumn("run_fingerprint", canonical_hash("signature", df.schema["signature"].dataType))


def signature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures changed after they were hashed, hashes of other runs, and rows without one."""
    _, _, rows = base(spark, sf_dir)
    df = signed(rows)
    changed = lambda x: F.when(at("AUTOMOBILE", "4"), x + 1e-9).otherwise(x)
    lost: Column = F.when(at("FURNITURE", "0"), None).when(at("BUILDING", "3"), F.reverse("run_fingerprint")).otherwise(F.col("run_fingerprint"))
    return signature_rules(df.withColumn("signature", F.col("signature").withField("temperature", changed(F.col("signature.temperature")))).withColumn("run_fingerprint", lost))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "typed_results": typed_results,
    "distribution_json": distribution_json,
    "signature_report": signature_report,
}

_TYPES = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in {"AUTOMOBILE": "STRING", "BUILDING": "OBJECT<bits: DECIMAL(1,0), name: STRING>", "FURNITURE": "BIGINT", "HOUSEHOLD": "VOID"}.items())
_TEXTS = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in {"AUTOMOBILE": "Q4_K_M", "BUILDING": '{"bits":4,"name":"Q4"}', "FURNITURE": "4", "HOUSEHOLD": "None"}.items())

ORACLE_SQL = {
    "typed_results": o.query(
        o.PREDICTIONS,
        f"""SELECT model_key, question_id || '::' || label_country || '=>' || evidence_country AS unit_id, condition, CASE WHEN CAST(substr(question_id, 2) AS INT) < 1998 THEN 'GAS' ELSE 'WVS' END AS domain,
  CASE model_key {_TYPES} END AS quantization_type, CASE model_key {_TEXTS} END AS quantization,
  CAST(CAST('0x' || substr(sha256('42' || chr(0) || question_id || '::' || label_country), 1, 16) AS UBIGINT) AS VARCHAR) AS permutation_seed,
  string_agg(CASE WHEN option <> first_option THEN option WHEN model_key = 'FURNITURE' THEN '1' WHEN model_key = 'HOUSEHOLD' THEN '2.0' ELSE option END, '|' ORDER BY option) AS options,
  round(arg_max(p, option), 9) AS last_share, CASE WHEN model_key <> 'HOUSEHOLD' THEN condition IN ('population_evidence', 'conflict') END AS evidence_presented
FROM (SELECT *, min(option) OVER (PARTITION BY question_id) AS first_option FROM (UNPIVOT (SELECT model_key, question_id, label_country, evidence_country, option, baseline, country_label, population_evidence, conflict FROM wide)
  ON baseline, country_label, population_evidence, conflict INTO NAME condition VALUE p))
WHERE model_key IN {tuple(QUANTIZATION)} GROUP BY model_key, question_id, label_country, evidence_country, condition""",
    ),
    "distribution_json": o.query(
        o.CUBE,
        """SELECT question_id, country, json, sha256(json) AS sha256
FROM (SELECT question_id, country, '{' || string_agg('"' || option || '":' || CAST(CAST(p AS DOUBLE) AS VARCHAR), ',' ORDER BY option) || '}' AS json FROM survey GROUP BY question_id, country)""",
    ),
    "signature_report": o.query(
        ROWS,
        " UNION ALL ".join(
            (planted("signature hash", f"({ends('AUTOMOBILE', '4')}) OR ({ends('BUILDING', '3')})"), planted("signature missing", ends("FURNITURE", "0")))
        ),
    ),
}
