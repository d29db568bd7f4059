"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations


def jsd(p: str, q: str) -> str:
    """Sum over the options of a group, in long form; shares are normalised already."""
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"least(greatest(0.5 * sum({half(p)} + {half(q)}), 0), 1)"


CUBE = """
seg AS (SELECT c_mktsegment AS model_key, 'Y' || year(o_orderdate) AS question_id, n_name AS country, n_regionkey AS region, o_orderpriority AS option, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
qo AS (SELECT DISTINCT question_id, option FROM seg),
cells AS (SELECT question_id, country, option, sum(n) AS n FROM seg GROUP BY ALL),
survey AS (SELECT question_id, country, option, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY question_id, country) AS p
  FROM (SELECT DISTINCT question_id, country FROM cells) JOIN qo USING (question_id) LEFT JOIN cells USING (question_id, country, option))"""

PAIRS = (
    CUBE
    + f""",
pairs AS (SELECT a.question_id, a.country AS a, b.country AS b, {jsd("a.p", "b.p")} AS divergence
  FROM survey a JOIN survey b ON a.question_id = b.question_id AND a.option = b.option AND a.country < b.country GROUP BY ALL),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(divergence, 12) DESC, a, b) AS place FROM pairs) WHERE place <= 3),
topn AS (SELECT * FROM top3 ORDER BY round(divergence, 12) DESC, question_id, a, b LIMIT 20),
manifest AS (SELECT question_id, a AS label_country, b AS evidence_country, divergence, question_id || '::' || a || '=>' || b AS unit_id FROM topn
  UNION ALL SELECT question_id, b, a, divergence, question_id || '::' || b || '=>' || a FROM topn)"""
)

PREDICTIONS = (
    PAIRS
    + """,
base AS (SELECT model_key, question_id, option, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY model_key, question_id) AS b
  FROM (SELECT DISTINCT model_key, question_id FROM seg) JOIN qo USING (question_id)
  LEFT JOIN (SELECT model_key, question_id, option, sum(n) AS n FROM seg GROUP BY ALL) USING (model_key, question_id, option)),
nat AS (SELECT model_key, question_id, country, option, sum(n) AS n FROM seg GROUP BY ALL),
reg AS (SELECT model_key, question_id, region, option, sum(n) AS n FROM seg GROUP BY ALL),
raw AS (SELECT base.model_key, m.question_id, m.label_country, m.evidence_country, base.option, base.b,
    coalesce(nl.n, 0) AS nl, coalesce(ne.n, 0) AS ne, coalesce(nr.n, 0) AS nr
  FROM manifest m JOIN base USING (question_id) JOIN (SELECT DISTINCT country, region FROM seg) cr ON cr.country = m.label_country
  LEFT JOIN nat nl ON nl.model_key = base.model_key AND nl.question_id = m.question_id AND nl.country = m.label_country AND nl.option = base.option
  LEFT JOIN nat ne ON ne.model_key = base.model_key AND ne.question_id = m.question_id AND ne.country = m.evidence_country AND ne.option = base.option
  LEFT JOIN reg nr ON nr.model_key = base.model_key AND nr.question_id = m.question_id AND nr.region = cr.region AND nr.option = base.option),
wide AS (SELECT raw.model_key, raw.question_id, raw.label_country, raw.evidence_country, raw.option, b AS baseline,
    (nr + b) / sum(nr + b) OVER u AS country_label, (nl + b) / sum(nl + b) OVER u AS population_evidence,
    (3 * ne + nl + b) / sum(3 * ne + nl + b) OVER u AS conflict, l.p AS lr, e.p AS er
  FROM raw JOIN survey l ON l.question_id = raw.question_id AND l.country = raw.label_country AND l.option = raw.option
  JOIN survey e ON e.question_id = raw.question_id AND e.country = raw.evidence_country AND e.option = raw.option
  WINDOW u AS (PARTITION BY raw.model_key, raw.question_id, raw.label_country, raw.evidence_country))"""
)

METRICS = (
    PREDICTIONS
    + f""",
d AS (SELECT model_key, question_id, label_country, evidence_country, {jsd("baseline", "lr")} AS jb, {jsd("country_label", "lr")} AS jc,
    {jsd("population_evidence", "lr")} AS je, {jsd("conflict", "lr")} AS jl, {jsd("conflict", "er")} AS jx, {jsd("lr", "er")} AS jr FROM wide GROUP BY ALL),
metrics AS (SELECT *, jb - jc AS country_influence, jb - je AS evidence_influence, (jb - je) - (jb - jc) AS evidence_advantage, jl - jx AS EO_raw,
    least(greatest((sqrt(jl) - sqrt(jx)) / sqrt(jr), -1), 1) AS EO_normalized,
    CASE WHEN jl - jx > 1e-12 THEN 'evidence-side' WHEN jl - jx < -1e-12 THEN 'label-side' ELSE 'tie' END AS classification FROM d WHERE jr > 0),
targets AS (SELECT * FROM (SELECT *, row_number() OVER t AS k, count(*) OVER (PARTITION BY model_key, question_id, label_country) AS repetitions FROM metrics
    WINDOW t AS (PARTITION BY model_key, question_id, label_country ORDER BY evidence_country)) WHERE k = 1),
long AS (SELECT model_key, question_id, 'country_influence' AS metric, country_influence AS value FROM targets
  UNION ALL SELECT model_key, question_id, 'evidence_influence', evidence_influence FROM targets
  UNION ALL SELECT model_key, question_id, 'evidence_advantage', evidence_advantage FROM targets
  UNION ALL SELECT model_key, question_id, 'EO_raw', EO_raw FROM metrics
  UNION ALL SELECT model_key, question_id, 'EO_normalized', EO_normalized FROM metrics),
sums AS (SELECT model_key, metric, question_id, sum(value) AS total, count(*) AS n FROM long GROUP BY ALL)"""
)

REPLICATES = 10_000
BOOTSTRAP = (
    METRICS
    + f""",
places AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS place, count(*) OVER () AS k FROM (SELECT DISTINCT question_id FROM sums)),
slots AS (SELECT r.range AS replicate, (r.range * 7919 + s.place * 104729 + 42) % 1000003 AS x, s.k FROM range({REPLICATES}) r, places s),
draws AS (SELECT replicate, x * x % 998244353 % k AS place FROM slots),
vals AS (SELECT model_key, metric, replicate, sum(total) / sum(n) AS value FROM draws JOIN places USING (place) JOIN sums USING (question_id) GROUP BY ALL),
boot AS (SELECT model_key, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS se FROM vals GROUP BY ALL),
point AS (SELECT model_key, metric, sum(total) / sum(n) AS estimate, CAST(sum(n) AS BIGINT) AS n FROM sums GROUP BY ALL)"""
)

#: Some overrides lie below the tolerance, on either side of 0.
TIED = (
    METRICS
    + """,
near AS (SELECT * REPLACE (CASE WHEN model_key = 'BUILDING' AND label_country LIKE '%8' THEN sign(EO_raw) * 5e-13 ELSE EO_raw END AS EO_raw) FROM metrics),
tied AS (SELECT * REPLACE (CASE WHEN EO_raw > 1e-12 THEN 'evidence-side' WHEN EO_raw < -1e-12 THEN 'label-side' ELSE 'tie' END AS classification) FROM near)"""
)

#: The same with counts of each cluster by a rule over its name.
WEIGHTS = (
    METRICS
    + f""",
own AS (SELECT DISTINCT question_id, CAST('0x' || substr(md5(question_id), 1, 8) AS BIGINT) AS own FROM sums),
xs AS (SELECT r.range AS replicate, question_id, (r.range * 7919 + own + 42) % 1000003 AS x FROM range({REPLICATES}) r, own),
counted AS (SELECT replicate, question_id, x * x % 998244353 % 3 AS times FROM xs),
vals AS (SELECT model_key, metric, replicate, CASE WHEN sum(times * n) > 0 THEN sum(times * total) / sum(times * n) END AS value FROM counted JOIN sums USING (question_id) GROUP BY ALL),
boot AS (SELECT model_key, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS se FROM vals GROUP BY ALL),
point AS (SELECT model_key, metric, sum(total) / sum(n) AS estimate, CAST(sum(n) AS BIGINT) AS n FROM sums GROUP BY ALL)"""
)

MODELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
AGREEMENT = (
    METRICS
    + """,
agree AS (SELECT question_id, label_country, evidence_country, """
    + ", ".join(f"max(EO_normalized) FILTER (model_key = '{m}') AS EO_normalized_{m}, max(classification) FILTER (model_key = '{m}') AS classification_{m}" for m in MODELS)
    + """, count(*) FILTER (classification = 'evidence-side') AS evidence_side_models, count(*) FILTER (classification = 'label-side') AS label_side_models,
  count(*) FILTER (classification = 'tie') AS tie_models, avg(EO_normalized) AS m, var_pop(EO_normalized) AS v,
  question_id || '::' || label_country || '=>' || evidence_country AS unit_id FROM metrics GROUP BY ALL)"""
)

NONRESPONSE = r"^(dk(\s*/\s*refused)?\b|don['’]?t know\b|refus(e|ed|al)\b|no answer\b|not answered?\b|missing\b|can['’]?t choose\b|not sure\b|no opinion\b)"
MIXED = "'Q0001','Q0155','Q0229','Q0256','Q0287','Q0297','Q0304','Q0321','Q0371','Q0452','Q0509','Q0581','Q0624','Q0672','Q0692','Q0768','Q0821','Q0860','Q0911','Q0963','Q1042','Q1103','Q1118'"
ALIAS = "'Q0006','Q0193','Q0280','Q0391','Q0545','Q0719','Q1133'"

EXPORT = rf"""
rawcell AS (SELECT printf('Q%04d', CASE o_custkey % 60 WHEN 50 THEN 311 WHEN 51 THEN 550 ELSE 1 + 5 * (o_custkey % 60) END) AS question_id,
    n_name || CASE WHEN o_custkey % 60 = 9 AND n_nationkey > 0 THEN ' (Old national sample)' ELSE CASE n_nationkey % 7 WHEN 1 THEN ' (Non-national sample)' WHEN 2 THEN ' (Old national sample)' WHEN 3 THEN ' (Current national sample)' ELSE '' END END AS country,
    n_nationkey AS place, CASE WHEN o_orderpriority LIKE '4%' THEN 'Don''t know' WHEN o_custkey % 60 = 7 THEN 'Only' WHEN o_custkey % 60 = 8 AND o_orderpriority LIKE '3%' THEN 'Low' WHEN o_orderpriority LIKE '5%' AND o_custkey % 60 % 17 = 0 THEN 'Total N='
      WHEN o_orderpriority LIKE '5%' THEN '  Low ' ELSE substr(o_orderpriority, 3) END AS option, CAST(count(*) AS DOUBLE) AS value
  FROM orders JOIN nation ON n_nationkey = o_orderkey % 9
  WHERE (CASE o_custkey % 60 WHEN 50 THEN 311 WHEN 51 THEN 550 ELSE 1 + 5 * (o_custkey % 60) END) % 11 <> 0 OR n_nationkey <> 4 OR o_orderpriority NOT LIKE '1%' GROUP BY ALL),
opts AS (SELECT DISTINCT question_id, option FROM rawcell),
samp AS (SELECT DISTINCT question_id, country, place FROM rawcell),
full_cell AS (SELECT s.question_id, s.country, s.place, trim(o.option) AS option,
    coalesce(r.value, 0) * CASE WHEN s.place = 5 AND o.option = 'Don''t know' THEN 6 WHEN s.place = 6 AND o.option = 'HIGH' THEN 3 ELSE 1 END AS value,
    regexp_matches(lower(trim(o.option)), '{NONRESPONSE.replace("'", "''")}') AS nonresponse
  FROM samp s JOIN opts o USING (question_id) LEFT JOIN rawcell r ON r.question_id = s.question_id AND r.country = s.country AND r.option = o.option
  WHERE r.value IS NOT NULL OR CAST(substr(s.question_id, 2, 4) AS INT) % 11 <> 0),
ruled AS (SELECT question_id, count(*) AS n_options, CASE
    WHEN question_id IN ({MIXED}) THEN 'known_mixed_schema' WHEN question_id IN ({ALIAS}) THEN 'alias_mapping_requires_review'
    WHEN question_id = 'Q0550' THEN 'country_specific_placeholder_unresolved' WHEN question_id IN ('Q0311', 'Q0475', 'Q1124') THEN 'relative_time_without_survey_wave'
    WHEN count(*) < 2 OR count(DISTINCT trim(option)) < count(*) THEN 'invalid_options'
    WHEN bool_or(regexp_matches(lower(trim(option)), '^total\s+n\s*=\s*$')) THEN 'table_total_parser_artifact'
    WHEN count(*) FILTER (NOT regexp_matches(lower(trim(option)), '{NONRESPONSE.replace("'", "''")}')) < 2 THEN 'fewer_than_two_substantive_options' END AS reason
  FROM opts GROUP BY question_id),
judged0 AS (SELECT f.question_id, f.country, f.place, regexp_matches(lower(f.country), '\((non-national|old national) sample\)') AS ineligible,
    count(*) <> max(r.n_options) OR sum(value) <= 0 AS fault, coalesce(sum(value) FILTER (NOT nonresponse), 0) / sum(value) AS mass,
    string_agg(option, ',' ORDER BY option) FILTER (NOT nonresponse AND value > 0) AS support
  FROM full_cell f JOIN ruled r USING (question_id) WHERE r.reason IS NULL GROUP BY ALL),
judged AS (SELECT *, CASE WHEN place > (SELECT min(place) FROM judged0 b WHERE b.question_id = j.question_id AND NOT b.ineligible AND b.fault) THEN 'unread'
    WHEN ineligible THEN 'ineligible' WHEN fault THEN 'invalid' WHEN mass <= 0.5 THEN 'low mass' ELSE 'kept' END AS status FROM judged0 j),
late AS (SELECT question_id, CASE WHEN bool_or(status = 'invalid') THEN 'invalid_distribution_schema' WHEN count(*) FILTER (status = 'kept') < 2 THEN 'fewer_than_two_eligible_samples'
    WHEN min(support) FILTER (status = 'kept') <> max(support) FILTER (status = 'kept') THEN 'incompatible_positive_option_support' END AS late FROM judged GROUP BY question_id),
decided AS (SELECT question_id, coalesce(reason, CASE WHEN l.question_id IS NULL THEN 'fewer_than_two_eligible_samples' ELSE late END) AS reason
  FROM ruled LEFT JOIN late l USING (question_id))"""

SCORES = """
scored AS (SELECT o_custkey AS key, o_orderpriority AS option, avg(o_totalprice) / 10000 AS score FROM orders GROUP BY ALL),
softmax AS (SELECT key, option, exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w AS p
  FROM (SELECT *, max(score) OVER (PARTITION BY key) AS mx FROM scored) WINDOW w AS (PARTITION BY key))"""

#: Ticks by largest remainder over the survey's populations.
TICKS = (
    CUBE
    + """,
quota AS (SELECT question_id, country, option, p * 100000000 AS q, floor(p * 100000000) AS f, row_number() OVER (PARTITION BY question_id, country ORDER BY option) AS pos FROM survey),
ticks AS (SELECT question_id, country, option, pos, CAST(f + CASE WHEN row_number() OVER (PARTITION BY question_id, country ORDER BY f - q, pos)
    <= 100000000 - sum(f) OVER (PARTITION BY question_id, country) THEN 1 ELSE 0 END AS BIGINT) AS ticks FROM quota),
lines AS (SELECT question_id, country, string_agg(chr(CAST(64 + pos AS INT)) || ' (' || option || '): ' || CAST(ticks // 1000000 AS VARCHAR) || '.' || lpad(CAST(ticks % 1000000 AS VARCHAR), 6, '0') || '%', ', ' ORDER BY pos) AS evidence,
    string_agg(chr(CAST(64 + pos AS INT)) || '. ' || option, chr(10) ORDER BY pos) AS options, string_agg(chr(CAST(64 + pos AS INT)), ', ' ORDER BY pos) AS labels FROM ticks GROUP BY ALL)"""
)


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def r(column: str, digits: int = 9, name: str | None = None) -> str:
    """Rounded, without a negative zero."""
    return f"round({column}, {digits}) + 0.0 AS {name or column}"


UNIT = "model_key, question_id, label_country, evidence_country"
_PROMPT = "'You are a social science researcher. A single respondent is selected at random from the target population. Predict which option this one respondent selected.' || chr(10) || 'Target Country: ' || country || chr(10) || 'Survey Response Statistics: ' || evidence || chr(10) || 'Question: Which priority in ' || question_id || '?' || chr(10) || 'Options:' || chr(10) || options || chr(10) || chr(10) || 'Reply with exactly one of these option labels: ' || labels || '. Do not output anything else.' || chr(10) || 'Answer:'"

SQL = {
    "normalize_cells": query(CUBE, f"SELECT question_id, country, option, {r('p')} FROM survey"),
    "jsd_pairs": query(PAIRS, f"SELECT question_id, a, b, {r('divergence')} FROM pairs"),
    "pairs_top": query(PAIRS, f"SELECT question_id, a, b, {r('divergence')}, place FROM topn"),
    "pairs_bounded": query(PAIRS, f"SELECT question_id, a, b, {r('divergence')}, place FROM topn"),
    "farthest_customers": query(
        f"""
sums AS (SELECT c_mktsegment AS question_id, o_custkey, o_orderpriority AS option, sum(floor(o_totalprice)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
shares AS (SELECT question_id, printf('C%08d', o_custkey) AS country, option, (coalesce(v, 0) + 20000) / sum(coalesce(v, 0) + 20000) OVER (PARTITION BY question_id, o_custkey) AS p
  FROM (SELECT DISTINCT question_id, o_custkey FROM sums) CROSS JOIN (SELECT DISTINCT o_orderpriority AS option FROM orders) LEFT JOIN sums USING (question_id, o_custkey, option)),
every AS (SELECT a.question_id, a.country AS a, b.country AS b, {jsd("a.p", "b.p")} AS divergence
  FROM shares a JOIN shares b ON a.question_id = b.question_id AND a.option = b.option AND a.country < b.country GROUP BY ALL)""",
        f"SELECT question_id, a, b, {r('divergence')}, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(divergence, 12) DESC, a, b) AS place FROM every) WHERE place <= 3",
    ),
    "pairs_directed": query(PAIRS, f"SELECT question_id, label_country, evidence_country, unit_id, {r('divergence')} FROM manifest"),
    "reciprocal_check": query(PAIRS, "SELECT m.question_id, m.label_country, m.evidence_country FROM manifest m WHERE m.label_country < 'NATION_2' AND NOT EXISTS (SELECT 1 FROM manifest o WHERE o.label_country < 'NATION_2' AND o.question_id = m.question_id AND o.label_country = m.evidence_country AND o.evidence_country = m.label_country)"),
    "quarantine_reason": query(EXPORT, "SELECT question_id, reason FROM decided"),
    "nonresponse_filter": query(EXPORT, f"SELECT DISTINCT trim(option) AS option, regexp_matches(lower(trim(option)), '{NONRESPONSE.replace(chr(39), chr(39) * 2)}') AS nonresponse FROM opts"),
    "mass_filter": query(EXPORT, f"SELECT question_id, country, {r('CASE WHEN ineligible OR fault THEN NULL ELSE mass END', 9, 'substantive_mass')}, status FROM judged"),
    "support_check": query(EXPORT, "SELECT question_id, CAST(count(*) FILTER (status = 'kept') AS BIGINT) AS eligible, CAST(count(DISTINCT support) FILTER (status = 'kept') AS BIGINT) AS supports FROM judged GROUP BY question_id"),
    "exclusion_summary": query(EXPORT, "SELECT 'question' AS kind, reason, count(*) AS count FROM decided WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'sample', CASE status WHEN 'ineligible' THEN 'explicit_non_national_or_old_removed' ELSE 'insufficient_substantive_mass_removed' END, count(*) FROM judged WHERE status IN ('ineligible', 'low mass') GROUP BY status"),
    "repaired_cells": query(EXPORT, f"SELECT question_id, regexp_replace(country, ' \\(Current national sample\\)$', '') AS country_display, CASE WHEN ends_with(country, ' (Current national sample)') THEN 'current_national' ELSE 'national' END AS sample_status, option, {r('value / sum(value) OVER (PARTITION BY question_id, country)', 9, 'p')} FROM full_cell JOIN judged USING (question_id, country) JOIN decided USING (question_id) WHERE status = 'kept' AND reason IS NULL AND NOT nonresponse"),
    "source_counts": query(EXPORT, "SELECT count(*) AS units, count(*) FILTER (contains(country, '(Non-national sample)')) AS non_national, count(*) FILTER (contains(country, '(Old national sample)')) AS old_national, count(*) FILTER (contains(country, '(Current national sample)')) AS current_national, (SELECT count(DISTINCT question_id) FROM opts) AS questions, (SELECT count(DISTINCT question_id) FROM opts WHERE CAST(substr(question_id, 2, 4) AS INT) % 7 = 3) AS numeric_option_questions FROM samp"),
    "condition_pivot": query(PREDICTIONS, f"SELECT {UNIT}, option, {r('baseline')}, {r('country_label')}, {r('population_evidence')}, {r('conflict')} FROM wide"),
    "unit_metrics_target": query(METRICS, f"SELECT model_key, question_id, label_country, {r('country_influence')}, {r('evidence_influence')}, {r('evidence_advantage')}, repetitions FROM targets"),
    "unit_metrics_directed": query(METRICS, f"SELECT {UNIT}, {r('EO_raw')}, {r('EO_normalized')}, classification FROM metrics"),
    "every_pair_metrics": query(METRICS.replace("WHERE place <= 3)", ")").replace(", a, b LIMIT 20)", ", a, b)"), f"SELECT {UNIT}, {r('EO_raw')}, {r('EO_normalized')}, classification FROM metrics"),
    "divergence_components": query(METRICS, f"SELECT {UNIT}, {r('jb', 9, 'jsd_baseline')}, {r('jc', 9, 'jsd_label')}, {r('je', 9, 'jsd_evidence')}, {r('jl', 9, 'jsd_conflict_label')}, {r('jx', 9, 'jsd_conflict_evidence')}, {r('jr', 9, 'jsd_references')} FROM d WHERE jr > 0"),
    "conflict_classes": query(TIED, "SELECT model_key, count(*) FILTER (classification = 'evidence-side') AS evidence_side_n, count(*) FILTER (classification = 'label-side') AS label_side_n, count(*) FILTER (classification = 'tie') AS tie_n FROM tied GROUP BY model_key"),
    "class_proportions": query(TIED, f"SELECT model_key, c.classification, count(m.classification) AS n, {r('count(m.classification) / sum(count(m.classification)) OVER (PARTITION BY model_key)', 9, 'proportion')} FROM (SELECT DISTINCT model_key FROM tied) CROSS JOIN (VALUES ('evidence-side'), ('label-side'), ('tie')) c(classification) LEFT JOIN tied m USING (model_key, classification) GROUP BY model_key, c.classification"),
    "metric_summary": query(METRICS, f"SELECT model_key, metric, count(*) AS n, {r('avg(value)', 9, 'mean')}, {r('stddev_pop(value)', 9, 'population_sd')}, {r('min(value)', 9, 'minimum')}, {r('max(value)', 9, 'maximum')} FROM long GROUP BY ALL"),
    "cluster_sums": query(METRICS, f"SELECT model_key, metric, question_id, {r('total')}, n FROM sums"),
    "bootstrap_ci": query(BOOTSTRAP, f"SELECT model_key, metric, n, {r('estimate')}, {r('mean')}, {r('se')}, {r('lo', 9, 'ci_lower')}, {r('hi', 9, 'ci_upper')} FROM point JOIN boot USING (model_key, metric)"),
    "bootstrap_weights": query(WEIGHTS, f"SELECT model_key, metric, n, {r('estimate')}, {r('mean')}, {r('se')}, {r('lo', 9, 'ci_lower')}, {r('hi', 9, 'ci_upper')} FROM point JOIN boot USING (model_key, metric)"),
    "main_metrics_wide": query(
        BOOTSTRAP,
        "SELECT model_key, "
        + ", ".join(x for m in ("country_influence", "evidence_influence", "evidence_advantage", "EO_raw", "EO_normalized") for x in (r(f"max(estimate) FILTER (metric = '{m}')", 9, m), r(f"max(lo) FILTER (metric = '{m}')", 9, f"{m}_ci_95_lower"), r(f"max(hi) FILTER (metric = '{m}')", 9, f"{m}_ci_95_upper")))
        + " FROM point JOIN boot USING (model_key, metric) GROUP BY model_key",
    ),
    "agreement_by_unit": query(AGREEMENT, "SELECT question_id, label_country, evidence_country, unit_id, " + ", ".join(f"{r(f'EO_normalized_{m}')}, classification_{m}" for m in MODELS) + f", evidence_side_models, label_side_models, tie_models, {r('m', 9, 'EO_normalized_mean')}, {r('v', 9, 'EO_normalized_variance')} FROM agree"),
    "agreement_summary": query(
        AGREEMENT,
        " UNION ALL ".join(
            f"SELECT '{name}' AS statistic, count(*) FILTER ({rule}) AS count, {r(f'100.0 * count(*) FILTER ({rule}) / count(*)', 6, 'percent')} FROM agree"
            for name, rule in (
                ("all_evidence_side", "evidence_side_models = 5"),
                ("all_but_one_evidence_side", "evidence_side_models >= 4"),
                ("all_label_side", "label_side_models = 5"),
                ("any_cross_model_disagreement", "evidence_side_models > 0 AND label_side_models > 0"),
                ("one_label_otherwise_evidence", "evidence_side_models = 4"),
                ("one_evidence_otherwise_label", "label_side_models = 4"),
                ("splits_of_one_total", "evidence_side_models = 4 OR label_side_models = 4"),
                ("even_splits", "evidence_side_models = 2 AND label_side_models = 2"),
                ("MACHINERY_only_label_side", "classification_MACHINERY = 'label-side' AND classification_AUTOMOBILE = 'evidence-side' AND classification_BUILDING = 'evidence-side' AND classification_FURNITURE = 'evidence-side' AND classification_HOUSEHOLD = 'evidence-side'"),
            )
        ),
    ),
    "extreme_cases": query(
        AGREEMENT,
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{name}' AS selection_rule, unit_id, {r('m', 9, 'EO_normalized_mean')}, {r('v', 9, 'EO_normalized_variance')} FROM agree ORDER BY {order}, unit_id LIMIT 1)"
            for name, order in (("Largest mean EO", "round(m, 12) DESC"), ("Lowest mean EO", "round(m, 12)"), ("Largest model disagreement", "round(v, 12) DESC"))
        ),
    ),
    "stratified_metrics": query(
        METRICS,
        f"""SELECT model_key, CASE WHEN CAST(substr(question_id, 2) AS INT) < 1998 THEN 'Global Attitudes' ELSE 'WVS' END AS source, count(*) FILTER (grain = 't') AS target_units, count(*) FILTER (grain = 'd') AS directed_units,
  {r("avg(country_influence) FILTER (grain = 't')", 9, "country_influence")}, {r("avg(evidence_influence) FILTER (grain = 't')", 9, "evidence_influence")}, {r("avg(evidence_advantage) FILTER (grain = 't')", 9, "evidence_advantage")},
  {r("avg(EO_raw) FILTER (grain = 'd')", 9, "EO_raw")}, {r("avg(EO_normalized) FILTER (grain = 'd')", 9, "EO_normalized")}, {r("100.0 * count(*) FILTER (grain = 'd' AND classification = 'evidence-side') / count(*) FILTER (grain = 'd')", 6, "evidence_side_pct")}
FROM (SELECT 't' AS grain, model_key, question_id, country_influence, evidence_influence, evidence_advantage, EO_raw, EO_normalized, classification FROM targets
  UNION ALL SELECT 'd', model_key, question_id, country_influence, evidence_influence, evidence_advantage, EO_raw, EO_normalized, classification FROM metrics) GROUP BY ALL""",
    ),
    "harmonized_sort": query(
        PREDICTIONS,
        f"SELECT {UNIT}, condition, row_number() OVER (ORDER BY list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE'], model_key), question_id, label_country, evidence_country, list_position(['baseline', 'country_label', 'population_evidence', 'conflict'], condition)) AS position FROM (SELECT DISTINCT {UNIT} FROM wide) CROSS JOIN (VALUES ('baseline'), ('country_label'), ('population_evidence'), ('conflict')) c(condition)",
    ),
    "coverage_diff": query(PREDICTIONS, "SELECT 'AUTOMOBILE' AS model_key, question_id, label_country, evidence_country FROM (SELECT question_id, label_country, evidence_country FROM wide WHERE model_key = 'AUTOMOBILE' EXCEPT SELECT question_id, label_country, evidence_country FROM wide WHERE model_key = 'BUILDING' AND label_country < 'NATION_2')"),
    "permutation_constancy": query(PREDICTIONS, "SELECT question_id, label_country, CAST(count(DISTINCT evidence_country) AS BIGINT) AS n FROM wide GROUP BY ALL HAVING count(DISTINCT evidence_country) > 1"),
    "pending_units": query(PAIRS, "SELECT unit_id FROM manifest WHERE label_country >= 'NATION_2'"),
    "run_progress": query(PAIRS, "SELECT count(*) AS expected, count(*) FILTER (label_country < 'NATION_2') AS completed, count(*) FILTER (label_country >= 'NATION_2') AS pending, CAST(0 AS BIGINT) AS unexpected FROM manifest"),
    "label_softmax": query(SCORES, f"SELECT key, option, {r('p')} FROM softmax"),
    "recover_distribution": query(SCORES, f"SELECT key, o.option, {r('p')} FROM (SELECT DISTINCT key FROM softmax) CROSS JOIN (SELECT DISTINCT option FROM scored) o LEFT JOIN softmax USING (key, option)"),
    "largest_remainder": query(TICKS, "SELECT question_id, country, option, ticks FROM ticks"),
    "format_evidence": query(TICKS, "SELECT question_id, country, evidence, string_split(evidence, ', ')[1] || ', ' || string_split(evidence, ', ')[2] AS incomplete FROM lines"),
    "prompt_hash": query(TICKS, f"SELECT question_id, country, sha256({_PROMPT}) AS prompt_sha256 FROM lines"),
    "chat_serialize": "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
    "violations_report": query(PREDICTIONS, "SELECT 'unknown pair' AS rule, question_id || '|' || label_country || '|' || evidence_country AS key FROM (SELECT DISTINCT question_id, label_country, evidence_country FROM wide WHERE label_country >= 'NATION_2') UNION ALL SELECT 'unequal coverage', question_id || '|' || label_country || '|' || evidence_country || '|' || condition FROM (SELECT DISTINCT question_id, label_country, evidence_country FROM wide) CROSS JOIN (VALUES ('baseline'), ('country_label'), ('population_evidence'), ('conflict')) c(condition)"
        " UNION ALL SELECT DISTINCT 'duplicate row', concat_ws('|', model_key, question_id, label_country, evidence_country, 'baseline') FROM wide WHERE model_key = 'AUTOMOBILE' AND label_country LIKE '%0'"
        " UNION ALL SELECT DISTINCT 'incomplete conditions', concat_ws('|', model_key, question_id, label_country, evidence_country) FROM wide WHERE model_key = 'BUILDING' AND label_country LIKE '%3'"
        " UNION ALL SELECT DISTINCT 'distribution: sum', concat_ws('|', model_key, question_id, label_country, evidence_country, 'country_label') FROM wide WHERE model_key = 'FURNITURE' AND label_country LIKE '%5'"),
    "synthetic_scores": query(PAIRS, f"SELECT unit_id, label, {r('-4.0 + 4.0 * (CAST(CAST(' + chr(39) + '0x' + chr(39) + " || substr(sha256('7' || chr(0) || unit_id || chr(0) || label), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551615.0)", 9, 'score')} FROM manifest CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(label)"),
    "stable_seed": query(PAIRS, "SELECT unit_id, CAST(CAST('0x' || substr(sha256('42' || chr(0) || unit_id), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM manifest"),
    "props_json": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "first_word_pairs": "SELECT count(*) AS pairs FROM (SELECT lower(split_part(trim(p_name), ' ', 1)) AS w, p_brand, p_partkey FROM part) a JOIN (SELECT lower(split_part(trim(p_name), ' ', 1)) AS w, p_brand, p_partkey FROM part) b ON a.p_brand = b.p_brand AND a.w = b.w AND a.p_partkey < b.p_partkey",
}
