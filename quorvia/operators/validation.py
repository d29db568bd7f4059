"""Data-quality rules as tables of violations.

Every rule gives rows (rule, key); no rows means it holds. ``require`` raises with the first
few of them, after all rules have been looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.functions.distributions import aligned, distribution_fault, distributions_close, evidence_override_normalized, js_divergence, label_map, map_label_probabilities, normalize_log_scores, option_labels
from quorvia.functions.json_text import canonical_hash
from quorvia.functions.prompts import CONDITIONS
from quorvia.functions.text import canonical_option, directed_unit_id, is_blank, stable_seed, target_unit_id, text_hash
from quorvia.functions.udfs import shuffle_options
from quorvia.operators.metrics import DIRECTED_METRICS, TARGET, TARGET_METRICS, UNIT, directed_metrics
from quorvia.operators.pairs import missing_reciprocals

VIOLATIONS = "rule string, key string"


def as_key(*columns: Column | str) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("∅")) for c in columns])


def flagged(df: DataFrame, rule: str, *key: Column | str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), as_key(*key).alias("key"))


def failing(df: DataFrame, rules: Mapping[str, Column], *key: Column | str) -> DataFrame:
    """Rows that break rules, all looked at in one pass. rules: what is wrong, by name; unknown counts as wrong."""
    names = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda n: n.isNotNull())
    return df.select(F.explode(names).alias("rule"), as_key(*key).alias("key"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return flagged(df.groupBy(*keys).count().where("count > 1"), rule, *keys)


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of the left that the right lacks."""
    return flagged(left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti"), rule, *keys)


def gather(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def manifest_rules(manifest: DataFrame, cells: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Unique keys, no self pairs, both directions, known populations, unit ids, and the size if given."""
    key = UNIT[1:]
    found = [
        duplicates(manifest, key, "duplicate pair"),
        flagged(manifest.where("label_country = evidence_country"), "self pair", *key),
        flagged(missing_reciprocals(manifest), "missing reciprocal", *key),
    ]
    if "unit_id" in manifest.columns:
        found.append(flagged(manifest.where(F.col("unit_id") != F.concat("question_id", F.lit("::"), "label_country", F.lit("=>"), "evidence_country")), "unit id", *key))
    if cells is not None:
        known = cells.select("question_id", F.col("country"))
        for side in ("label_country", "evidence_country"):
            found.append(missing(manifest, known.toDF("question_id", side), ["question_id", side], f"unknown {side}"))
    if size is not None:
        found.append(flagged(manifest.agg(F.count("*").alias("n")).where(F.col("n") != size), "size", "n"))
    return gather(*found)


def prediction_rules(
    predictions: DataFrame, manifest: DataFrame, *, models: Sequence[str], conditions: Sequence[str] = CONDITIONS, options_col: str = "options", distribution_col: str = "prediction", sum_tolerance: float = 1e-8
) -> DataFrame:
    """Known models, conditions and pairs; unique keys; sound distributions; every unit with all
    conditions; every model with the same units; one option order and seed per target."""
    key = [*UNIT, "condition"]
    found = [
        flagged(predictions.where(~F.col("model_key").isin(*models)), "unknown model", *key),
        flagged(predictions.where(~F.col("condition").isin(*conditions)), "unknown condition", *key),
        missing(predictions, manifest, UNIT[1:], "unknown pair"),
        duplicates(predictions, key, "duplicate row"),
        flagged(predictions.groupBy(*UNIT).agg(F.count_distinct("condition").alias("n")).where(F.col("n") != len(conditions)), "incomplete conditions", *UNIT),
        flagged(predictions.groupBy(*key[1:]).agg(F.count_distinct("model_key").alias("n")).where(F.col("n") != len(models)), "unequal coverage", *key[1:]),
    ]
    if distribution_col in predictions.columns:
        fault = distribution_fault(distribution_col, options_col, sum_tolerance)
        found.append(predictions.withColumn("__fault", fault).where("__fault IS NOT NULL").select(F.concat(F.lit("distribution: "), "__fault").alias("rule"), as_key(*key).alias("key")))
    if "permutation_seed" in predictions.columns:
        found.append(flagged(inconstant(predictions, ["question_id", "label_country"], ["displayed", "permutation_seed"]), "permutation", "question_id", "label_country"))
    return gather(*found)


def inconstant(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys under which the values are not the same in all rows."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n")).where("n > 1").select(*keys, "n")


#: Where predictions must come from.
BACKEND, SCORING_METHOD = "llama.cpp", "full_contextual_option_label_sequence_log_probability"


def origin_rules(predictions: DataFrame, questions: DataFrame, *, backend: str = BACKEND, scoring_method: str = SCORING_METHOD, rows_per_model: int | None = None) -> DataFrame:
    """Predictions of a real run: backend and scoring as named, not synthetic, no generated answer,
    of known questions, and as many of each model as asked for."""
    key = [*UNIT, "condition"]
    rules = {"synthetic": F.col("synthetic"), "backend": F.col("backend") != backend, "scoring method": F.col("scoring_method") != scoring_method}
    if "generated_answer" in predictions.columns:
        rules["generated answer"] = F.col("generated_answer").isNotNull()
    found = [failing(predictions, rules, *key), missing(predictions, questions, ["question_id"], "unknown question")]
    if rows_per_model is not None:
        found.append(flagged(predictions.groupBy("model_key").count().where(F.col("count") != rows_per_model), "rows of model", "model_key", "count"))
    return gather(*found)


def row_rules(rows: DataFrame, *, temperature: float = 1.0, tolerance: float = 1e-9, sum_tolerance: float = 1e-8, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """The contract of a single result row, apart from all others.

    rows: model_key, question_id, label_country, evidence_country, condition, unit_id,
    target_unit_id (texts), options, displayed (arrays), label_to_option, label_probabilities,
    label_log_scores, prediction, label_reference, evidence_reference, presented_evidence
    (maps), evidence_presented, prompt, prompt_sha256.

    Ids follow from their parts; the displayed options are the options in another order and
    give the label map; log scores normalise to the label probabilities, and these, by the map,
    to the prediction; the prompt has its hash; evidence is there in its two conditions only,
    and is the label's reference or, in a conflict, the other population's.
    """
    texts = ("model_key", "question_id", "label_country", "evidence_country", "unit_id", "target_unit_id", "prompt")
    options, displayed = F.col("options"), F.col("displayed")
    labels = option_labels(F.least(F.greatest(F.size(displayed), F.lit(1)), F.lit(26)))
    presents = F.col("condition").isin("population_evidence", "conflict")
    source = F.when(F.col("condition") == "conflict", F.col("evidence_reference")).otherwise(F.col("label_reference"))
    ordered = lambda m: F.transform(labels, lambda x: F.try_element_at(F.col(m), x))
    as_map = lambda m: F.map_from_arrays(labels, m)
    odd = {m: distribution_fault(m, options, sum_tolerance).isNotNull() for m in ("prediction", "label_reference", "evidence_reference")}
    usable = F.coalesce((F.size(options) >= 2) & (F.size(options) <= 26) & (F.size(F.array_distinct(options)) == F.size(options)) & F.forall(options, lambda o: ~is_blank(o)), F.lit(False))
    shown = F.coalesce((F.size(displayed) == F.size(options)) & (F.size(F.array_except(options, displayed)) == 0), F.lit(False))
    scored = F.coalesce((F.size("label_log_scores") == F.size(labels)) & F.forall(ordered("label_log_scores"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    certain = distribution_fault("label_probabilities", labels, sum_tolerance).isNull()
    # what builds on a broken part is not looked at
    after = lambda ok, bad: F.when(ok, bad).otherwise(F.lit(False))
    rules = {
        **{f"{t} missing": is_blank(F.col(t)) for t in texts},
        "self pair": F.col("label_country") == F.col("evidence_country"),
        "unit id": F.col("unit_id") != directed_unit_id(*UNIT[1:]),
        "target unit id": F.col("target_unit_id") != target_unit_id("question_id", "label_country"),
        "unknown condition": ~F.col("condition").isin(*conditions),
        "options": ~usable,
        "displayed options": after(usable, ~shown),
        "label map": after(usable & shown, ~map_equal("label_to_option", label_map(displayed))),
        "log scores": after(usable & shown, ~scored),
        "label probabilities": after(usable & shown, ~certain),
        "softmax": after(usable & shown & scored & certain, ~distributions_close("label_probabilities", as_map(normalize_log_scores(ordered("label_log_scores"), temperature)), tolerance)),
        **{f"{m} distribution": after(usable, bad) for m, bad in odd.items()},
        "prompt hash": F.col("prompt_sha256") != text_hash("prompt"),
        "evidence flag": F.col("evidence_presented") != presents,
        "evidence without condition": ~presents & F.col("presented_evidence").isNotNull(),
        "presented evidence": after(presents, ~F.coalesce(distributions_close("presented_evidence", source, tolerance), F.lit(False))),
        "round trip": after(usable & shown & certain & ~odd["prediction"], ~distributions_close("prediction", map_label_probabilities(labels, ordered("label_probabilities"), "label_to_option"), tolerance)),
    }
    return failing(rows, rules, *UNIT, "condition")


def map_equal(a: Column | str, b: Column) -> Column:
    """Whether two maps hold the same entries."""
    return F.coalesce(F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b)), F.lit(False))


#: What the metadata of a result document must say.
UNIT_KEY, JSD_BASE = ["question_id", "country", "conflict_country"], 2
DATA_ARTIFACTS = {"dataset", "pair_manifest", "source_dataset", "repair_summary"}
RUNTIME_FACTS = {"chat template not used": lambda r: r.get("use_chat_template") is True, "chat template hash missing": lambda r: bool(r.get("chat_template_sha256"))}


def metadata_faults(metadata: Mapping, *, scoring_method: str = SCORING_METHOD, allow_synthetic: bool = False, conditions: Sequence[str] = CONDITIONS) -> list[str]:
    """What is wrong with the metadata of one result document: a text for each fault, none if it is sound."""
    if not isinstance(metadata, Mapping):
        return ["metadata is no object"]
    models, synthetic, scientific = (metadata.get(k) for k in ("models", "synthetic_backend", "scientific_inference"))
    named = isinstance(models, list) and bool(models) and all(isinstance(m, str) and m for m in models) and len(set(models)) == len(models)
    wrong = {
        "scoring method": metadata.get("scoring_method") != scoring_method,
        "directed unit key": metadata.get("directed_unit_key") != UNIT_KEY,
        "divergence base": metadata.get("jensen_shannon_base") != JSD_BASE,
        "inference flags": not (isinstance(synthetic, bool) and isinstance(scientific, bool) and synthetic != scientific),
        "synthetic results": synthetic is True and not allow_synthetic,
        "conditions": metadata.get("conditions") != list(conditions),
        "models": not named,
    }
    found = [k for k, bad in wrong.items() if bad]
    if scientific is not True:
        return found
    sound = lambda x: isinstance(x, Mapping) and x.get("status") == "present" and bool(x.get("sha256"))
    artifacts, runtimes = metadata.get("data_artifacts"), metadata.get("model_runtime")
    found += ["package lock"] * (not sound(metadata.get("package_lock")))
    if not isinstance(artifacts, Mapping) or set(artifacts) != DATA_ARTIFACTS:
        found.append("data artifacts")
    else:
        found += [f"data artifact {k}" for k, v in sorted(artifacts.items()) if not sound(v)]
    if not isinstance(runtimes, Mapping) or not named or set(runtimes) != set(models):
        return [*found, "model runtimes"]
    for m in models:
        found += [f"{m}: {name}" for name, fine in RUNTIME_FACTS.items() if not fine(runtimes[m])]
        found += [f"{m}: {part} revision" for part in ("model", "tokenizer") if runtimes[m].get(f"requested_{part}_revision") != runtimes[m].get(f"resolved_{part}_revision")]
    return found


def dataset_rules(questions: DataFrame, samples: DataFrame) -> DataFrame:
    """A repaired survey: usable options, named samples, sound distributions, two samples or more.

    questions: question_id, options; samples: question_id, country, distribution (map).
    """
    canonical = F.transform("options", canonical_option)
    usable = (F.size(canonical) >= 2) & (F.size(F.array_distinct(canonical)) == F.size(canonical)) & F.forall(canonical, lambda o: o.isNotNull())
    known = questions.select("question_id", canonical.alias("own"))
    joined = samples.join(known, "question_id", "left")
    n = questions.select("question_id").join(samples.groupBy("question_id").agg(F.count_distinct("country").alias("n")), "question_id", "left")
    return gather(
        failing(questions, {"options": ~usable}, "question_id"),
        failing(joined, {"sample name": is_blank(F.col("country")), "sample of unknown question": F.col("own").isNull(), "distribution": F.col("own").isNotNull() & distribution_fault("distribution", "own").isNotNull()}, "question_id", "country"),
        flagged(n.where("coalesce(n, 0) < 2"), "fewer than two samples", "question_id"),
    )


def pair_rules(manifest: DataFrame, questions: DataFrame, samples: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Pairs of a manifest against a survey: fields that are there, known questions and samples, the
    same options, and the divergence of the two samples where the manifest states one."""
    key = UNIT[1:]
    canonical = lambda c: F.transform(c, canonical_option)
    rules = {f"{k} missing": is_blank(F.col(k)) for k in key}
    known = samples.select("question_id", "country")
    found = [failing(manifest, rules, *key), duplicates(manifest, key, "duplicate pair"), flagged(manifest.where("label_country = evidence_country"), "self pair", *key), missing(manifest, questions, ["question_id"], "unknown question")]
    found += [missing(manifest, known.toDF("question_id", side), ["question_id", side], f"unknown {side}") for side in key[1:]]
    if "options" in manifest.columns:
        both = manifest.where("options IS NOT NULL").join(questions.select("question_id", canonical("options").alias("own")), "question_id")
        found.append(flagged(both.where(~canonical("options").eqNullSafe(F.col("own"))), "other options", *key))
    if "divergence" in manifest.columns:
        side = lambda name: samples.select("question_id", F.col("country").alias(f"{name}_country"), F.col("distribution").alias(name))
        both = manifest.select(*key, "divergence").join(side("label"), ["question_id", "label_country"]).join(side("evidence"), ["question_id", "evidence_country"])
        order = F.array_sort(F.map_keys("label"))
        value = js_divergence(aligned("label", order), aligned("evidence", order))
        found.append(flagged(both.where(~F.coalesce(F.abs(F.col("divergence") - value) <= tolerance, F.lit(False))), "divergence", *key))
    return gather(*found)


def domain_rules(units: DataFrame, domains: DataFrame) -> DataFrame:
    """Questions without a domain, or with several."""
    return gather(missing(units, domains, ["question_id"], "question without domain"), duplicates(domains.distinct(), ["question_id"], "question with several domains"))


def distinct_reference_rules(metrics: DataFrame) -> DataFrame:
    """Pairs whose two references are equal: no normalised override is defined for them."""
    return flagged(metrics.where("jsd_references = 0"), "equal references", *UNIT)


def cluster_rules(targets: DataFrame, directed: DataFrame, models: Sequence[str]) -> DataFrame:
    """What a clustered bootstrap needs: named, finite, unique rows of known models, no self pairs,
    both directions, targets for all ends and ends for all targets, the same units in every model."""
    finite = lambda m: F.col(m).isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    row = lambda keys, metrics: {f"{k} missing": is_blank(F.col(k)) for k in keys} | {f"{m} not finite": finite(m) for m in metrics} | {"unknown model": ~F.col("model_key").isin(*models)}
    back = directed.select("model_key", "question_id", F.col("evidence_country").alias("label_country"), F.col("label_country").alias("evidence_country"))

    def lacking(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
        n = df.where(F.col("model_key").isin(*models)).groupBy(*keys).agg(F.count_distinct("model_key").alias("n"))
        return flagged(n.where(F.col("n") != len(models)), rule, *keys)

    return gather(
        failing(targets, row(TARGET, [m for m in TARGET_METRICS if m in targets.columns or directed_metrics(directed) == DIRECTED_METRICS]), *TARGET),
        failing(directed, row(UNIT, directed_metrics(directed)) | {"self pair": F.col("label_country") == F.col("evidence_country")}, *UNIT),
        duplicates(targets, TARGET, "duplicate target"),
        duplicates(directed, UNIT, "duplicate unit"),
        missing(back, directed, UNIT, "missing reciprocal"),
        endpoint_rules(directed, targets),
        lacking(targets, TARGET[1:], "target not in all models"),
        lacking(directed, UNIT[1:], "unit not in all models"),
    )


def permutation_rules(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Seeds and displayed orders that don't follow from the run's seed and the target.

    rows: question_id, label_country, options, displayed, permutation_seed.
    """
    own = stable_seed(seed, target_unit_id("question_id", "label_country"))
    df = rows.withColumn("own_seed", own).withColumn("own_order", shuffle_options("options", "own_seed"))
    return failing(df, {"permutation seed": F.col("permutation_seed") != F.col("own_seed"), "displayed order": F.col("displayed") != F.col("own_order")}, "question_id", "label_country").distinct()


def provenance_rules(rows: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Rows that are not bound to the run: a column whose value is another than the expected digest."""
    return failing(rows, {f"other {name}": F.col(name) != value for name, value in expected.items()}, *UNIT, "condition")


def signature_rules(rows: DataFrame, signature_col: str = "signature", fingerprint_col: str = "run_fingerprint") -> DataFrame:
    """Rows whose fingerprint is not the hash of their own signature, worked out again from its canonical JSON."""
    own = canonical_hash(signature_col, rows.schema[signature_col].dataType)
    lacks = F.col(signature_col).isNull() | is_blank(F.col(fingerprint_col))
    return failing(rows, {"signature missing": lacks, "signature hash": ~lacks & (F.col(fingerprint_col) != own)}, *UNIT, "condition")


def target_rules(targets: DataFrame) -> DataFrame:
    return flagged(targets.where(~F.col("invariant")), "target metric varies with its partner", *TARGET)


def endpoint_rules(directed: DataFrame, targets: DataFrame) -> DataFrame:
    """Every end of a directed unit is a target, and every target is such an end."""
    ends = directed.select("model_key", "question_id", F.explode(F.array("label_country", "evidence_country")).alias("label_country"))
    return gather(missing(ends, targets, TARGET, "endpoint without target"), missing(targets, ends, TARGET, "target without endpoint"))


def reference_rules(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """An evidence reference equals the target reference of the same population, where there is one.

    rows: question_id, label_country, evidence_country, label_reference, evidence_reference (arrays).
    """
    own = rows.groupBy("question_id", F.col("label_country").alias("evidence_country")).agg(F.min("label_reference").alias("own"))
    far = F.exists(F.zip_with("own", "evidence_reference", lambda a, b: F.coalesce(F.abs(a - b) > tolerance, F.lit(True))), lambda x: x)
    return flagged(rows.join(own, ["question_id", "evidence_country"], "left").where("own IS NOT NULL").where(far), "evidence reference differs", "question_id", "label_country", "evidence_country")


def recomputed_rules(stored: DataFrame, derived: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Stored values that differ from derived ones, and keys of one side only."""
    a = stored.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = derived.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = a.join(b, list(keys))
    wrong = [flagged(both.where(~(F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}")) <= tolerance)), f"stored {c} differs", *keys) for c in columns]
    return gather(*wrong, missing(stored, derived, keys, "not derived"), missing(derived, stored, keys, "not stored"))


def release_rules(intervals: DataFrame, classes: DataFrame, published: DataFrame, counts: DataFrame, tolerance: float = 5e-10) -> DataFrame:
    """Summaries that differ from the published ones, and published ones that aren't there.

    intervals: model_key, metric, estimate, ci_lower, ci_upper; published: the same and
    decimals, where a value was published rounded (null: in full); classes and counts:
    model_key, evidence_side_n.
    """
    names = ("estimate", "ci_lower", "ci_upper")
    keys = ["model_key", "metric"]
    both = intervals.select(*keys, *names).join(published.select(*keys, "decimals", *[F.col(c).alias(f"__{c}") for c in names]), keys)
    within = F.coalesce(0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-12, F.lit(tolerance))
    far = {f"published {c} differs": ~(F.abs(F.col(c) - F.col(f"__{c}")) <= within) for c in names}
    counted = classes.select("model_key", "evidence_side_n").join(counts.select("model_key", F.col("evidence_side_n").alias("__n")), "model_key")
    return gather(failing(both, far, *keys), missing(published, intervals, keys, "published value lacks"), failing(counted, {"published count differs": F.col("evidence_side_n") != F.col("__n")}, "model_key"))


def path_rules(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Token paths of a row's labels: unique, and their log probabilities sum to the label's score.

    rows: key, paths array<struct<label, token_ids, token_log_probabilities, score>>.
    """
    ids = F.transform("paths", lambda p: p["token_ids"])
    sums = F.exists("paths", lambda p: F.abs(F.aggregate(p["token_log_probabilities"], F.lit(0.0), lambda a, x: a + x) - p["score"]) > tolerance)
    return gather(flagged(rows.where(F.size(F.array_distinct(ids)) != F.size(ids)), "token paths repeat", "key"), flagged(rows.where(sums), "path score differs", "key"))


def first_word_rules(rows: DataFrame) -> DataFrame:
    """Options of a row that share their first word, ignoring case, must differ in label and score.

    rows: key, options array<struct<label, text, score>>, or one row for each option: key,
    label, text, score. Options are counted by first word, and no pairs of them are made; a
    violation names the row and the word.
    """
    o = rows.select("key", F.explode("options").alias("o")).select("key", "o.*") if "options" in rows.columns else rows
    word = F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))
    by = o.where("text IS NOT NULL").groupBy("key", word.alias("word")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("score").alias("scores"))
    return flagged(by.where((F.col("labels") < F.col("n")) | (F.col("scores") < F.col("n"))), "options with one first word are alike", "key", "word")


def endpoint_orientation(units: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The override of the references themselves: 1 for the evidence's, -1 for the label's."""
    at = lambda c: evidence_override_normalized(c, label="label_reference", evidence="evidence_reference")
    wrong = (F.abs(at("evidence_reference") - 1) > tolerance) | (F.abs(at("label_reference") + 1) > tolerance)
    return flagged(units.where(F.coalesce(wrong, F.lit(True))), "endpoint orientation", "question_id", "label_country", "evidence_country")


def require(violations: DataFrame, shown: int = 5) -> None:
    """Raise if there is any violation; says how many there are of each rule and shows a few."""
    counts = {r["rule"]: r["count"] for r in violations.groupBy("rule").count().collect()}
    if counts:
        some = [f"{r['rule']}: {r['key']}" for r in violations.orderBy("rule", "key").limit(shown).collect()]
        raise ValueError(f"violations {dict(sorted(counts.items()))}; " + "; ".join(some))
