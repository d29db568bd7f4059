"""Registered queries over a run's files: checkpoints at once and as a stream, and tokens in texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.prompts import CONDITIONS
from quorvia.functions.text import text_hash
from quorvia.operators.bootstrap import bootstrap
from quorvia.operators.full_rows import trace_rules
from quorvia.operators.metrics import UNIT, conflict_classes, directed_units, long_metrics, target_units
from quorvia.operators.smoke import smoke_assertions
from quorvia.operators.summaries import positions
from quorvia.operators.validation import BACKEND, first_word_rules, release_rules
from quorvia.plans import oracle as o
from quorvia.plans import survey as sv
from quorvia.plans.contracts import base
from quorvia.plans.traces import full_rows
from quorvia.sources.credentials import credential_places, file_lengths
from quorvia.sources.stored import shared_dir, stored
from quorvia.streaming.states import CHECKPOINT, COMPLETE, PENDING, follow, furthest, judged

VERSION, FINGERPRINT = "row-v1", "f" * 64
OWN = {"schema_version": VERSION, "run_fingerprint": FINGERPRINT}


def checkpoint_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of one model's checkpoints, and the manifest (key, place) that they belong to.

    Every row is pending once; most are complete too, some of them twice. Complete ones of
    some populations are of another run, at another place, of another schema or status.
    """
    _, pairs, rows = base(spark, sf_dir)
    placed = positions(pairs, [F.col("question_id")], ["unit_id"]).select(*UNIT[1:], F.posexplode(F.array(*map(F.lit, CONDITIONS))).alias("step", "condition"), "position")
    key = F.array(*UNIT[1:], "condition")
    manifest = stored(placed.select(F.array_join(key, "|").alias("key"), ((F.col("position") - 1) * len(CONDITIONS) + F.col("step")).cast("long").alias("place"), key.alias("row_key"), "label_country"), "checkpoint-manifest")
    own = rows.where("model_key = 'MACHINERY'").select(F.array_join(key, "|").alias("key"), F.to_json(F.struct("options", "p")).alias("row"))
    ends = lambda x: F.col("label_country").endswith(x)
    state = lambda status, extra=F.lit(None).cast("string"): F.struct(F.lit(status).alias("status"), extra.alias("odd"))
    odd = F.when(ends("3"), "fingerprint").when(ends("5"), "place").when(ends("7"), "status").when(ends("6"), "schema").when(ends("2"), "key")
    states = F.filter(
        F.array(state(PENDING), F.when(~ends("4"), state(COMPLETE, odd)), F.when(ends("0"), state(COMPLETE)), F.when(ends("0"), state(PENDING))),
        lambda s: s.isNotNull(),
    )
    every = manifest.join(own, "key").select("*", F.explode(states).alias("s"))
    is_odd = lambda kind: F.coalesce(F.col("s.odd") == kind, F.lit(False))
    lines = every.select(
        F.when(is_odd("schema"), "row-v0").otherwise(VERSION).alias("schema_version"),
        F.when(is_odd("fingerprint"), "0" * 64).otherwise(FINGERPRINT).alias("run_fingerprint"),
        (F.col("place") + F.when(is_odd("place"), 1).otherwise(0)).alias("manifest_index"),
        F.when(is_odd("key"), F.concat(F.slice("row_key", 1, 3), F.array(F.lit("none")))).otherwise(F.col("row_key")).alias("row_key"),
        F.when(is_odd("status"), "done").otherwise(F.col("s.status")).alias("metrics_status"),
        "row",
    )
    folder = f"{shared_dir(spark)}/tables/checkpoints-{uuid.uuid4().hex}"
    lines.repartition(12, F.xxhash64("row_key", "metrics_status", "schema_version")).write.json(folder)
    return folder, manifest.select("key", "place")


def told(states: DataFrame, faults: DataFrame) -> DataFrame:
    """States with the hash of their row, and the reasons of files that were turned away."""
    one = states.select("key", F.col("status").alias("found"), text_hash("row").alias("row_sha256"), F.lit(1).cast("long").alias("n"))
    other = faults.groupBy("key", F.col("fault").alias("found")).agg(F.lit(None).cast("string").alias("row_sha256"), F.count("*").alias("n"))
    return one.union(other).select("key", "found", F.col("row_sha256").isNotNull().alias("counts"), "n")


def checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = checkpoint_files(spark, sf_dir)
    found = stored(judged(spark.read.schema(CHECKPOINT).json(folder), manifest, **OWN), "checkpoints")
    return told(furthest(found.where("fault IS NULL")), found.where("fault IS NOT NULL"))


def checkpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the files, a few at a time."""
    folder, manifest = checkpoint_files(spark, sf_dir)
    place = f"{shared_dir(spark)}/tables/checkpoint-states-{uuid.uuid4().hex}"
    follow(spark, folder, manifest, f"{place}/table", f"{place}/stream", files_per_trigger=4, **OWN).awaitTermination()
    faults = judged(spark.read.schema(CHECKPOINT).json(folder), manifest, **OWN).where("fault IS NOT NULL")
    return told(furthest(spark.read.parquet(f"{place}/table")), faults)


def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, a token added to one in fifty, and scanned by ranges of bytes."""
    own = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(" hf_"), F.md5(F.col("doc_id").cast("string").cast("binary")))).otherwise("")
    folder = f"{shared_dir(spark)}/tables/texts-{uuid.uuid4().hex}"
    sv.table(spark, sf_dir, "documents").select(F.concat(F.coalesce("text", F.lit("")), own).alias("value")).write.text(folder)
    return credential_places(file_lengths(spark, folder, "*.txt"), size=1 << 20).groupBy("token").agg(F.count("*").alias("n"))


def first_word_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size whose names share the first word must differ in type and price."""
    parts = sv.table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 7 == 0, F.floor(F.col("p_retailprice") / 100) * 100).otherwise(F.col("p_retailprice"))
    return first_word_rules(parts.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key"), F.col("p_type").alias("label"), F.col("p_name").alias("text"), price.alias("score")))


def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summaries against published ones: exact, rounded to four places, or changed."""
    found = sv.metrics(spark, sf_dir)
    directed = directed_units(found)
    intervals = stored(bootstrap(long_metrics(target_units(found), directed), replicates=200, draws="arithmetic"), "intervals")
    classes = conflict_classes(directed)
    advantage = F.col("metric") == "evidence_advantage"
    shown = lambda c: F.when(advantage, F.round(c, 4)).otherwise(F.col(c))
    at = lambda model, metric: (F.col("model_key") == model) & (F.col("metric") == metric)
    published = intervals.select(
        "model_key", "metric", F.when(advantage, 4).alias("decimals"), (shown("estimate") + F.when(at("AUTOMOBILE", "EO_raw"), 1e-9).otherwise(0)).alias("estimate"),
        (shown("ci_lower") + F.when(at("FURNITURE", "evidence_advantage"), 1e-4).otherwise(0)).alias("ci_lower"), (shown("ci_upper") - F.when(at("MACHINERY", "EO_normalized"), 1e-9).otherwise(1e-11)).alias("ci_upper"),
    )
    counts = classes.select("model_key", (F.col("evidence_side_n") + F.when(F.col("model_key") == "BUILDING", 1).otherwise(0)).alias("evidence_side_n"))
    return release_rules(intervals.where(~at("HOUSEHOLD", "country_influence")), classes, published, counts)


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions of a short run for every model: two units in both directions, and a fault in most models' rows."""
    _, pairs, _ = base(spark, sf_dir)
    first = pairs.orderBy(F.desc(F.round("divergence", 12)), "question_id", F.least("label_country", "evidence_country")).limit(2)
    two = stored(first.select(*UNIT[1:]), "smoke-units")
    rows = stored(full_rows(spark, sf_dir).join(F.broadcast(two), UNIT[1:], "left_semi"), "smoke-rows")
    conflict, building = F.col("condition") == "conflict", F.col("model_key") == "BUILDING"
    rows = rows.where(~(building & conflict)).union(rows.where(conflict & (F.col("model_key") == "HOUSEHOLD")))
    rows = rows.withColumns(
        {
            "backend": F.lit(BACKEND), "model_identifier": F.col("model_key"), "synthetic": (F.col("model_key") == "FURNITURE") & conflict,
            "generated_answer": F.when((F.col("model_key") == "MACHINERY") & conflict, "A"), "template_verified": ~((F.col("model_key") == "MACHINERY") & conflict),
            "answer_target": F.col("answer_target") + F.when((F.col("model_key") == "FURNITURE") & conflict, 1).otherwise(0),
        }
    )
    return smoke_assertions(rows, trace_rules(rows), two)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "checkpoint_states": checkpoint_states,
    "checkpoint_stream": checkpoint_stream,
    "credential_scan": credential_scan,
    "first_word_report": first_word_report,
    "smoke_assertions": smoke,
    "release_report": release_report,
}

_STATES = o.query(
    o.PAIRS
    + """,
k AS (SELECT question_id || '|' || label_country || '|' || evidence_country AS unit, label_country, c FROM manifest CROSS JOIN (VALUES ('baseline'), ('country_label'), ('population_evidence'), ('conflict')) v(c)),
odd AS (SELECT *, CASE right(label_country, 1) WHEN '3' THEN 'run fingerprint' WHEN '5' THEN 'manifest order' WHEN '7' THEN 'status' WHEN '6' THEN 'schema' WHEN '2' THEN 'row key' END AS odd FROM k)""",
    """SELECT unit || '|' || c AS key, CASE WHEN odd IS NOT NULL OR label_country LIKE '%4' THEN 'pending' ELSE 'complete' END AS found, TRUE AS counts, CAST(1 AS BIGINT) AS n FROM odd
UNION ALL SELECT unit || '|' || c, odd, FALSE, CAST(1 AS BIGINT) FROM odd WHERE odd IS NOT NULL AND odd <> 'row key'
UNION ALL SELECT unit || '|none', odd, FALSE, CAST(count(*) AS BIGINT) FROM odd WHERE odd = 'row key' GROUP BY ALL""",
)

_SMOKE = {
    "genuine_backend_only": "model_key <> 'FURNITURE'", "exactly_all_rows": "model_key NOT IN ('BUILDING', 'HOUSEHOLD')", "unique_keys": "model_key <> 'HOUSEHOLD'",
    "reciprocal_units": "TRUE", "all_conditions_per_unit": "model_key NOT IN ('BUILDING', 'HOUSEHOLD')", "template_verified": "model_key <> 'MACHINERY'", "candidate_tokenization_valid": "TRUE",
    "correct_answer_position": "model_key <> 'FURNITURE'", "all_labels_scored": "TRUE", "no_generation": "model_key <> 'MACHINERY'",
}

ORACLE_SQL = {
    "release_report": """SELECT DISTINCT rule, model || key AS key FROM customer JOIN (VALUES ('AUTOMOBILE', '|EO_raw', 'published estimate differs'), ('FURNITURE', '|evidence_advantage', 'published ci_lower differs'),
  ('MACHINERY', '|EO_normalized', 'published ci_upper differs'), ('HOUSEHOLD', '|country_influence', 'published value lacks'), ('BUILDING', '', 'published count differs')) v(model, key, rule) ON model = c_mktsegment""",
    "first_word_report": """SELECT 'options with one first word are alike' AS rule, o.key || '|' || word AS key
FROM (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS key, lower(split_part(trim(p_name), ' ', 1)) AS word, p_type AS label, CASE WHEN p_partkey % 7 = 0 THEN floor(p_retailprice / 100) * 100 ELSE p_retailprice END AS score FROM part) AS o
GROUP BY o.key, word HAVING count(*) > count(DISTINCT label) OR count(*) > count(DISTINCT score)""",
    "smoke_assertions": o.query(o.PREDICTIONS, "SELECT DISTINCT model_key, " + ", ".join(f"{rule} AS {name}" for name, rule in _SMOKE.items()) + " FROM wide"),
    "checkpoint_states": _STATES,
    "checkpoint_stream": _STATES,
    "credential_scan": """SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, '') || CASE WHEN doc_id % 50 = 0 THEN ' hf_' || md5(CAST(doc_id AS VARCHAR)) ELSE '' END, 'hf_[A-Za-z0-9]{20,}')) AS token FROM documents) GROUP BY token""",
}
