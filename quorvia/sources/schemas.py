"""Explicit schemas: distributions are maps, seeds are decimals, nothing is inferred.

Where files differ in type (options that are texts or numbers, a quantization that is a text
or an object) the field is a VARIANT, so that the scan keeps what was written.
"""

DISTRIBUTION = "MAP<STRING, DOUBLE>"

COUNTRY = f"STRUCT<distribution: {DISTRIBUTION}, source_country_label: STRING, sample_status: STRING, substantive_mass_original: DOUBLE>"
QUESTION = (
    f"STRUCT<question_id: STRING, domain: STRING, question: STRING, options: ARRAY<VARIANT>, countries: MAP<STRING, {COUNTRY}>, "
    "country_display_names: MAP<STRING, STRING>, repair_status: STRING, source_question: STRING, text_repair: STRING>"
)
#: One JSON object keyed by question id.
DATASET = f"MAP<STRING, {QUESTION}>"

MANIFEST = (
    "unit_id STRING, question_id STRING, country STRING, country_display STRING, conflict_country STRING, conflict_country_display STRING, "
    "options ARRAY<STRING>, divergence_bits DOUBLE, mapping_status STRING"
)

#: A harmonised prediction; ``quantization`` is text or an object, and here its text or JSON text.
PREDICTION = (
    "model_key STRING, model_name STRING, model_identifier STRING, model_repository STRING, model_revision STRING, schema_version STRING, run_fingerprint STRING, "
    "backend STRING, quantization STRING, scoring_method STRING, synthetic BOOLEAN, question_id STRING, domain STRING, unit_id STRING, target_unit_id STRING, "
    "label_country STRING, evidence_country STRING, condition STRING, original_options ARRAY<STRING>, displayed_option_order ARRAY<STRING>, "
    "displayed_option_labels ARRAY<STRING>, displayed_label_to_option MAP<STRING, STRING>, permutation_seed DECIMAL(20, 0), "
    f"normalized_prediction {DISTRIBUTION}, label_country_human_distribution {DISTRIBUTION}, evidence_country_human_distribution {DISTRIBUTION}, "
    f"presented_evidence_distribution {DISTRIBUTION}, evidence_presented BOOLEAN, raw_candidate_scores MAP<STRING, DOUBLE>, "
    "candidate_label_token_ids MAP<STRING, ARRAY<INT>>, serialized_prompt_sha256 STRING"
)

#: The same with ``quantization`` as it was written.
TYPED_PREDICTION = PREDICTION.replace("quantization STRING", "quantization VARIANT")

BOOTSTRAP = (
    "model_key STRING, model STRING, metric STRING, n BIGINT, estimate DOUBLE, ci_95_lower DOUBLE, ci_95_upper DOUBLE, "
    "bootstrap_replicates BIGINT, question_clusters BIGINT, seed BIGINT"
)

AGREEMENT_SUMMARY = "statistic STRING, count BIGINT, percent DOUBLE"
CONFLICT = "model_key STRING, model STRING, evidence_side_n BIGINT, evidence_side_pct DOUBLE, label_side_n BIGINT, label_side_pct DOUBLE, tie_n BIGINT, tie_pct DOUBLE"

#: A result file of one run.
SMOKE_ROW = (
    "STRUCT<model: STRING, question_id: STRING, country: STRING, conflict_country: STRING, condition: STRING, options: ARRAY<STRING>, "
    f"used_options: ARRAY<STRING>, permutation_seed: DECIMAL(20, 0), prediction: {DISTRIBUTION}, human_distribution: {DISTRIBUTION}>"
)
