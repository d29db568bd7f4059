import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorvia.functions.distributions import all_metrics
from quorvia.functions.prompts import first_difference, marker_count
from quorvia.functions.text import canonical_option, csv_cell
from quorvia.functions.udfs import python_json
from quorvia.operators import bootstrap as boot
from quorvia.operators.resume import finished_prefix, pair_limit, permutation_digest, progress_document
from quorvia.operators.summaries import agreement_summary, extreme_cases, main_metrics
from quorvia.operators.validation import cluster_rules, metadata_faults, permutation_rules, provenance_rules, row_rules
from quorvia.plans.inputs import load_dataset, load_inputs
from quorvia.sources import readers, sinks, stored

MODELS = ("qwen", "llama", "mistral", "gemma")


def test_one_model_alone(spark):
    """The order of models doesn't say which one is meant."""
    e, t = "evidence-side", "label-side"
    rows = [(1, 0, 0, e, e, t, e), (2, 0, 0, e, e, e, t), (3, 0, 0, e, e, t, t), (4, 0, 0, t, t, t, t)]
    by_unit = spark.createDataFrame(rows, "id int, a int, b int, " + ", ".join(f"classification_{m} string" for m in MODELS))
    sides = lambda side: sum(F.when(F.col(f"classification_{m}") == side, 1).otherwise(0) for m in MODELS)
    by_unit = by_unit.withColumns({"evidence_side_models": sides(e), "label_side_models": sides(t)})
    found = {r.statistic: r["count"] for r in agreement_summary(by_unit, MODELS, "mistral").collect()}
    assert found["mistral_only_label_side"] == 1 and found["three_evidence_one_label"] == 2 and len(found) == 9
    gemma = {r.statistic: r["count"] for r in agreement_summary(by_unit.where("id <> 1"), MODELS, "mistral").collect()}
    assert gemma["mistral_only_label_side"] == 0
    assert len(agreement_summary(by_unit, MODELS).collect()) == 8
    with pytest.raises(ValueError, match="no such model"):
        agreement_summary(by_unit, MODELS, "other")


def test_cases_with_ties_and_nulls(spark):
    rows = [("b", 1.0, 0.5), ("a", 1.0, 0.1), ("c", -1.0, 0.5), ("d", None, None)]
    df = spark.createDataFrame(rows, "unit_id string, EO_normalized_mean double, EO_normalized_variance double")
    assert [r.unit_id for r in extreme_cases(df).collect()] == ["a", "c", "b"]
    assert extreme_cases(df.limit(0)).count() == 0


def test_draws_are_numpys(spark):
    for replicates, k, at_once in ((25, 7, 10), (9, 1, 4), (40, 8, 7)):
        want = np.random.default_rng(3).integers(0, k, size=(replicates, k))
        got = sorted((r.replicate, r.draw) for r in boot.pcg64_draws(spark, replicates, k, 3, at_once).collect())
        assert [d for _, d in got] == want.tolist() and [i for i, _ in got] == list(range(replicates))


def test_series_without_some_clusters(spark):
    sums = spark.createDataFrame([("m", "x", "Q2", 2.0, 1), ("m", "x", "Q1", 3.0, 2), ("m", "y", "Q2", 5.0, 4)], "model_key string, metric string, question_id string, total double, n long")
    found = {r.metric: (r.totals, r.counts, r.k) for r in boot.as_arrays(sums).collect()}
    assert found == {"x": ([3.0, 2.0], [2.0, 1.0], 2), "y": ([0.0, 5.0], [0.0, 4.0], 2)}


def test_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('\t{"a": 2}\n {"a": 3}\n\t \n[1]\n{"a"\n{"a": 5}\n')
    assert readers.line_count(spark, str(path)) == 5
    bad = sorted((r.number, r.fault) for r in readers.bad_lines(spark, str(path)).collect())
    assert bad == [(3, "blank line"), (4, "not an object"), (5, "no JSON")]
    path.write_text('\t{"a": 2}\n {"a": 3}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(path), "a int").collect()) == [2, 3]


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 10)):
        (tmp_path / name).write_text("".join('{"a": 1}\n' if i % 7 else "x\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = readers.bad_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {"a": [], "b": []}
    for r in found:
        by[r.file[-1]].append(r.number)
    assert sorted(by["a"]) == list(range(1, 3001, 7)) and sorted(by["b"]) == [1, 8]


def survey(**changes):
    one = {"options": ["Yes", " No"], "domain": "GAS", "question": "Q?", "countries": {"A": {"distribution": {"Yes": 1, "No": 3}}, "B": {"distribution": {"Yes": 1, "No": 1}}}}
    return {"Q1": {"question_id": "Q1", **one, **changes}}


def test_dataset_and_pairs(spark, tmp_path):
    data, pairs, settings = tmp_path / "d.json.gz", tmp_path / "p.json", tmp_path / "s.json"

    def write(**changes):
        data.write_bytes(gzip.compress(json.dumps(survey(**changes)).encode()))

    write()
    listed = [{"question_id": "Q1", "country": a, "conflict_country": b, "options": ["Yes", "No"]} for a, b in (("A", "B"), ("B", "A"))]
    pairs.write_text(json.dumps(listed))
    settings.write_text(json.dumps({"experiment": {"smoke": {"question_pairs": 1}, "none": {"question_pairs": 0}}}))
    found = load_inputs(spark, str(settings), str(data), str(pairs), "smoke")
    assert {r.country: r.p for r in found["cells"].collect()} == {"A": [0.25, 0.75], "B": [0.5, 0.5]}
    assert [(r.label_country, r.unit_id, r.options) for r in found["pairs"].collect()] == [("A", "Q1::A=>B", ["Yes", "No"])]
    with pytest.raises(ValueError, match="above 0"):
        load_inputs(spark, str(settings), str(data), str(pairs), "none")
    with pytest.raises(ValueError, match="asked for"):
        pair_limit(found["pairs"], 5)
    for faulty, name in ((["No", "Yes"], "other options"), (None, "self pair")):
        pairs.write_text(json.dumps([{**listed[0], "options": faulty}] if faulty else [{**listed[0], "conflict_country": "A"}]))
        with pytest.raises(ValueError, match=name):
            load_inputs(spark, str(settings), str(data), str(pairs))
    for changes, name in (({"options": ["Yes", "Yes "]}, "options"), ({"countries": {"A": survey()["Q1"]["countries"]["A"]}}, "fewer than two samples"), ({"countries": {k: {"distribution": {"Yes": 0, "No": 0}} for k in "AB"}}, "distribution")):
        write(**changes)
        with pytest.raises(ValueError, match=name):
            load_dataset(spark, str(data))


def metadata(**changes):
    present = {"status": "present", "sha256": "0"}
    runtime = {"use_chat_template": True, "chat_template_sha256": "0", "requested_model_revision": "a", "resolved_model_revision": "a", "requested_tokenizer_revision": "b", "resolved_tokenizer_revision": "b"}
    one = {
        "scoring_method": "full_contextual_option_label_sequence_log_probability", "directed_unit_key": ["question_id", "country", "conflict_country"], "jensen_shannon_base": 2,
        "synthetic_backend": False, "scientific_inference": True, "models": ["m"], "conditions": ["baseline", "country_label", "population_evidence", "conflict"],
        "package_lock": present, "data_artifacts": dict.fromkeys(("dataset", "pair_manifest", "source_dataset", "repair_summary"), present), "model_runtime": {"m": runtime},
    }
    return one | changes


def test_metadata():
    assert metadata_faults(metadata()) == []
    assert metadata_faults(metadata(jensen_shannon_base=10, models=["m", "m"])) == ["divergence base", "models", "model runtimes"]
    assert metadata_faults(metadata(synthetic_backend=True, scientific_inference=False)) == ["synthetic results"]
    assert metadata_faults(metadata(synthetic_backend=True, scientific_inference=False), allow_synthetic=True) == []
    assert metadata_faults(metadata(scientific_inference=False)) == ["inference flags"]
    assert metadata_faults(metadata(package_lock={}, data_artifacts={})) == ["package lock", "data artifacts"]
    runtime = metadata()["model_runtime"]["m"]
    assert metadata_faults(metadata(model_runtime={"m": {**runtime, "use_chat_template": 1, "resolved_model_revision": "c"}})) == ["m: chat template not used", "m: model revision"]
    assert metadata_faults([]) == ["metadata is no object"]


def test_rows_with_nulls_are_faulty_not_fatal(spark):
    schema = (
        "model_key string, question_id string, label_country string, evidence_country string, condition string, unit_id string, target_unit_id string, options array<string>, displayed array<string>, "
        "label_to_option map<string,string>, label_probabilities map<string,double>, label_log_scores map<string,double>, prediction map<string,double>, label_reference map<string,double>, "
        "evidence_reference map<string,double>, presented_evidence map<string,double>, evidence_presented boolean, prompt string, prompt_sha256 string"
    )
    df = spark.createDataFrame([(None,) * 19, ("m", "Q", "A", "A", "other", "Q::A=>A", "Q::A", ["x"] * 40, [], {}, {}, {}, {}, {}, {}, {}, True, "", "")], schema)
    rules = {r.rule for r in row_rules(df).collect()}
    assert {"model_key missing", "options", "unknown condition", "self pair", "evidence flag", "prompt hash"} <= rules


def test_cluster_rules_on_sound_rows(spark):
    targets = spark.createDataFrame([(m, "Q", c, 0.1, 0.2, 0.1) for m in "ab" for c in "XY"], "model_key string, question_id string, label_country string, country_influence double, evidence_influence double, evidence_advantage double")
    directed = spark.createDataFrame([(m, "Q", x, y, 0.1, 0.2) for m in "ab" for x, y in ("XY", "YX")], "model_key string, question_id string, label_country string, evidence_country string, EO_raw double, EO_normalized double")
    assert cluster_rules(targets, directed, ["a", "b"]).count() == 0
    assert {r.rule for r in cluster_rules(targets, directed, ["a"]).collect()} == {"unknown model"}


def test_small_texts(spark):
    df = spark.createDataFrame([("aé1", "aé2"), ("same", "same"), ("ab", "abc"), ("<s>x<s>", None)], "a string, b string")
    rows = df.select(first_difference("a", "b").alias("d"), marker_count("a", "<s>").alias("n")).collect()
    assert [(r.d and (r.d["at"], r.d["byte"])) for r in rows] == [(2, 3), None, (2, 2), None] and rows[3].n == 2
    nested = spark.createDataFrame([({"b": {"d": 1, "c": 2}, "a": {}}, [(2, "x")])], "m map<string,map<string,int>>, s array<struct<z:int,a:string>>")
    row = nested.select(csv_cell("m", dict(nested.dtypes)["m"]).alias("m"), csv_cell("s", dict(nested.dtypes)["s"]).alias("s")).first()
    assert (row.m, row.s) == ('{"a":{},"b":{"c":2,"d":1}}', '[{"a":"x","z":2}]')


def test_runs(spark):
    manifest = spark.createDataFrame([(i, f"u{i}") for i in range(4)], "place long, unit_id string")
    rows = spark.createDataFrame([(f"u{i}", c, "s") for i in (0, 1, 3) for c in "xy" if (i, c) != (1, "y")], "unit_id string, condition string, run_fingerprint string")
    assert [r.unit_id for r in finished_prefix(rows, manifest, ["x", "y"]).collect()] == ["u0"]
    assert finished_prefix(rows, manifest, ["x", "y"], signature="other").count() == 0
    done = manifest.where("place IN (0, 3)")
    doc = progress_document(manifest, done, manifest.where("place = 0"))
    assert doc == {"expected_units": 4, "completed_units": 2, "unexpected_units": 0, "resumed_units": 1, "new_units": 1, "last_key": ["u3"], "status": "running", "error": None}
    assert progress_document(manifest, manifest)["status"] == "complete" and progress_document(manifest, done, error="x")["status"] == "failed"
    prompts = spark.createDataFrame([(1, "Q", "B", "A", "Q::B", ["n", "y"]), (0, "Q", "A", "B", "Q::A", ["y", "é"])], "place long, question_id string, label_country string, evidence_country string, target_unit_id string, displayed array<string>")
    import hashlib

    want = [{"directed_key": ["Q", "A", "B"], "permutation_key": "Q::A", "displayed_options": ["y", "é"]}, {"directed_key": ["Q", "B", "A"], "permutation_key": "Q::B", "displayed_options": ["n", "y"]}]
    assert permutation_digest(prompts) == hashlib.sha256(json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_files(spark, tmp_path):
    here = tmp_path / "f"
    here.write_text("x")
    found = {r.path: (r.status, r.bytes) for r in readers.file_identity(spark, [str(here), str(tmp_path / "g")]).collect()}
    assert found == {str(here): ("present", 1), str(tmp_path / "g"): ("missing", None)}
    (tmp_path / "r.json").write_text('{"runtime": {"seconds": 2.5}}')
    (tmp_path / "bad.json").write_text('{"other": 1}')
    assert [(r.model, r.runtime.seconds) for r in readers.runtime_records(spark, {"m": str(tmp_path / "r.json")}, "STRUCT<seconds: DOUBLE>").collect()] == [("m", 2.5)]
    with pytest.raises(Exception, match="malformed runtime record"):
        readers.runtime_records(spark, {"m": str(tmp_path / "bad.json")}, "STRUCT<seconds: DOUBLE>").collect()
    summary = spark.createDataFrame([("question", "few", 2), ("question", "many", 5), ("sample", "old", 1)], "kind string, reason string, count long")
    report = sinks.exclusion_report(summary)
    assert report.index("many") < report.index("few") and "## sample" in report


def test_outputs(spark, tmp_path):
    unit = "model_key string, question_id string, label_country string, evidence_country string"
    directed = spark.createDataFrame([("m", "Q", "A", "B", 0.1, 0.2, "evidence-side")], f"{unit}, EO_raw double, EO_normalized double, classification string")
    targets = spark.createDataFrame([("m", "Q", "A", 0.5, ["B"])], "model_key string, question_id string, label_country string, country_influence double, evidence_countries array<string>")
    long = spark.createDataFrame([("m", "EO_raw", 1, 0.1, 0.0, 0.2)], "model_key string, metric string, n long, estimate double, ci_lower double, ci_upper double")
    classes = spark.createDataFrame([("m", 1, 100.0)], "model_key string, evidence_side_n long, evidence_side_pct double")
    rows = directed.select("model_key", "question_id", "label_country", "evidence_country", F.lit("conflict").alias("condition"), F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(0.0)).alias("prediction"))
    tables = {"target_unit_metrics": targets, "directed_unit_metrics": directed, "bootstrap_metrics_long": long, "main_metrics": main_metrics(long, ["EO_raw"]), "conflict_classification": classes}
    paths = sinks.write_outputs(tmp_path, tables, rows, ["EO_raw"], {"manifest": "00"})
    assert [p.relative_to(tmp_path).as_posix() for p in paths] == list(sinks.ANALYSIS_FILES) and all(p.stat().st_size for p in paths)
    assert (tmp_path / "results.csv").read_text().splitlines()[1] == 'm,Q,A,B,conflict,"{""a"":0.0,""b"":1.0}"'
    assert json.loads((tmp_path / "analysis.json").read_text())["summary"]["prediction_rows"] == 1
    assert (tmp_path / "tables/conflict_classification.tex").read_text() == "m & 1 & 100.0 \\\\\n"
    first = [p.read_bytes() for p in paths]
    assert [p.read_bytes() for p in sinks.write_outputs(tmp_path, tables, rows, ["EO_raw"], {"manifest": "00"})] == first


def test_shared_folder():
    class Session:
        class conf:
            found = None

            @classmethod
            def get(cls, name, default):
                return cls.found

            @classmethod
            def set(cls, name, value):
                cls.found = value

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="shared folder"):
        stored.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert stored.shared_dir(Session).startswith("file://") and stored.shared_dir(Session) == Session.conf.found
    Session.sparkContext.master, Session.conf.found = "yarn", "hdfs://x/y"
    assert stored.shared_dir(Session) == "hdfs://x/y"


def test_release(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    files = readers.list_files(spark, str(tmp_path))
    lines = sinks.hash_manifest(files).collect()
    listed = spark.createDataFrame([(r.value,) for r in lines], "value string")
    assert sinks.verify_hashes(files, listed).count() == 0
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    found = {r.path[-1]: r.fault for r in sinks.verify_hashes(readers.list_files(spark, str(tmp_path)), listed).collect()}
    assert found == {"a": "differs", "b": "missing", "d": "unexpected"}
    assert sinks.derived_faults(tmp_path, {"a": b"x", "c": b"d", "e": b""}) == ["c: differs", "e: missing"]


def test_bound_rows(spark):
    from quorvia.functions.text import stable_seed, target_unit_id
    from quorvia.functions.udfs import shuffle_options

    df = spark.createDataFrame([("m", "Q", c, "Z", "baseline", list("abcdef"), "run") for c in "ABC"], "model_key string, question_id string, label_country string, evidence_country string, condition string, options array<string>, run_fingerprint string")
    df = df.withColumn("permutation_seed", stable_seed(42, target_unit_id("question_id", "label_country"))).withColumn("displayed", shuffle_options("options", "permutation_seed"))
    assert permutation_rules(df).count() == 0 and provenance_rules(df, {"run_fingerprint": "run"}).count() == 0
    wrong = df.withColumn("displayed", F.when(F.col("label_country") == "A", F.col("options")).otherwise(F.col("displayed"))).withColumn("permutation_seed", F.col("permutation_seed") + F.when(F.col("label_country") == "B", 1).otherwise(0))
    assert {(r.rule, r.key) for r in permutation_rules(wrong).collect()} == {("displayed order", "Q|A"), ("permutation seed", "Q|B")}
    assert provenance_rules(df, {"run_fingerprint": "other"}).count() == 3


def test_harmonised_rows(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"question_id": "Q", "condition": "evidence", "backend": "b", "domain": "x", "normalized_prediction": {"A": 1.0}}))
    raw = spark.read.schema("question_id string, condition string, backend string, domain string, normalized_prediction map<string,double>").json(str(tmp_path / "r.jsonl"))
    row = readers.harmonized(raw, "k", "Name", spark.createDataFrame([("Q", "GAS")], "question_id string, domain string")).first()
    assert (row.model_key, row.model_name, row.domain, row.condition, row.backend, row.normalized_prediction, row.unit_id) == ("k", "Name", "GAS", "population_evidence", "b", {"A": 1.0}, None)
    (tmp_path / "d.json").write_text(json.dumps({"metadata": {}, "results": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in readers.read_results(spark, str(tmp_path / "d.json"), "STRUCT<a: INT>").collect()) == [1, 2]


def test_models_and_numbers(spark):
    models = spark.createDataFrame([("b", 1), ("a", 2)], "name string, n int")
    assert [(r.name, r.position) for r in readers.select_models(models, ["a", "b"]).collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="unknown models"):
        readers.select_models(models, ["c"])
    df = spark.createDataFrame([(["y", "x"], [0.1, 1.0], [0.5, 0.5], [0.0, 1.0])], "k array<string>, v array<double>, p array<double>, q array<double>")
    row = df.select(python_json("k", "v").alias("j"), all_metrics("p", "q", "q", "p", label="q", evidence="p").alias("m")).first()
    assert row.j == '{"x": 1.0, "y": 0.1}'
    apart = row.m.country_influence
    assert row.m.evidence_influence == apart > 0 and row.m.evidence_advantage == 0 and row.m.EO_raw == apart and row.m.EO_normalized == 1
    assert [r.o for r in spark.createDataFrame([(" x\u00a0",), ("  ",)], "t string").select(canonical_option("t").alias("o")).collect()] == ["x", None]


def test_figure(spark, tmp_path):
    pytest.importorskip("matplotlib")
    main = spark.createDataFrame([("m", 0.1, 0.0, 0.3)], "model_key string, EO_raw double, EO_raw_ci_95_lower double, EO_raw_ci_95_upper double")
    sinks.write_figure(main, "EO_raw", tmp_path / "f.png")
    assert (tmp_path / "f.png").stat().st_size
