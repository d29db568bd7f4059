import json

import pytest
from pyspark.sql import functions as F

from quorvia.operators.pairs import directed_manifest
from quorvia.operators.resume import complete_units, fingerprint, pending_units, progress, unexpected_units
from quorvia.operators.validation import first_word_rules, gather, manifest_rules, path_rules, prediction_rules, recomputed_rules, require
from quorvia.plans.experiment import analyse, batch_scorer, native_scorer, predict, prepare_units
from quorvia.sources import readers, sinks
from quorvia.streaming.checkpoints import finished_rows, first_of_each, into_table

MODELS = ["m1", "m2"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("run")

    def held(df, name):
        """From files, so that no test plans the whole run again."""
        df.write.parquet(str(place / name))
        return spark.read.parquet(str(place / name))

    cells = spark.createDataFrame(
        [(q, c, ["Yes", "No", "Maybe"], [float((i + j * k) % 5 + 1) for k in range(3)]) for j, q in enumerate(("Q1", "Q2", "Q3"), 1) for i, c in enumerate("ABC")],
        "question_id string, country string, options array<string>, p array<double>",
    ).withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, y: a + y)))
    cells = held(cells, "cells")
    manifest = held(directed_manifest(cells, 10), "manifest")
    questions = cells.select("question_id").distinct().withColumn("question", F.concat(F.lit("What about "), "question_id", F.lit("?")))
    prompts = held(prepare_units(cells, manifest, questions), "prompts")
    rows = predict(prompts, native_scorer(1), "m1").unionByName(predict(prompts, batch_scorer(lambda p, labels: [[-float(len(t) % (i + 2)) for i, _ in enumerate(x)] for t, x in zip(p, labels, strict=True)]), "m2"))
    return cells, manifest, questions, held(rows, "rows")


def test_rows(run):
    rows = run[3].collect()
    assert len(rows) == 2 * 10 * 4
    for r in rows:
        assert sum(r.p) == pytest.approx(1) and r.p == [r.prediction[o] for o in r.options]
        assert sorted(r.displayed) == sorted(r.options) and r.label_to_option == dict(zip(r.labels, r.displayed, strict=True))
        assert r.evidence_presented == (r.presented_evidence is not None) == ("Survey Response Statistics" in r.prompt)
    by_target = {}
    for r in rows:
        by_target.setdefault(r.target_unit_id, set()).add((tuple(r.displayed), r.permutation_seed))
    assert all(len(x) == 1 for x in by_target.values())


def test_analysis(spark, run):
    cells, manifest, _, rows = run
    domains = cells.select("question_id").distinct().withColumn("domain", F.lit("GAS"))
    out = analyse(rows, cells, manifest, domains, MODELS, replicates=50)
    assert out["violations"].count() == 0
    assert out["directed_unit_metrics"].count() == 20 and out["main_metrics"].count() == 2
    assert {r.source for r in out["source_stratified_metrics"].collect()} == {"Global Attitudes"}
    assert out["cross_model_agreement_summary"].count() == 8 and out["illustrative_cases"].count() == 3
    report = sinks.results_report("Run", [("Main", out["main_metrics"]), ("Classes", out["conflict_classification"])])
    assert report.count("\n## ") == 2 and "| m1 |" in report
    assert len(sinks.latex_estimates(out["main_metrics"], ["EO_raw"])) == 2
    doc = json.loads(sinks.nested_document({"classes": out["conflict_classification"]}))
    assert [r["model_key"] for r in sorted(doc["classes"], key=lambda r: r["model_key"])] == MODELS
    assert sinks.analysis_manifest(rows, out["target_unit_metrics"], out["directed_unit_metrics"])["prediction_rows"] == 80
    unit = out["directed_unit_metrics"]
    assert recomputed_rules(unit, unit, ["model_key", "question_id", "label_country", "evidence_country"], ["EO_raw"]).count() == 0


def test_tampering_is_found(spark, run):
    cells, manifest, _, rows = run
    kinds = lambda df: {r.rule for r in df.select("rule").distinct().collect()}
    check = lambda df: kinds(prediction_rules(df, manifest, models=MODELS))
    assert check(rows) == set()
    assert check(rows.union(rows.where("model_key = 'm1'").limit(1))) == {"duplicate row"}
    assert check(rows.where("NOT (model_key = 'm1' AND condition = 'conflict')")) == {"incomplete conditions", "unequal coverage"}
    assert "distribution: sum" in check(rows.withColumn("prediction", F.transform_values("prediction", lambda k, v: v * 2)))
    assert "permutation" not in check(rows)
    assert kinds(manifest_rules(manifest.where("label_country < evidence_country"), cells, 10)) == {"missing reciprocal", "size"}
    with pytest.raises(ValueError, match="duplicate row"):
        require(prediction_rules(rows.union(rows), manifest, models=MODELS))
    paths = spark.createDataFrame([("k", [("A", [1], [-1.0], -1.0), ("B", [1], [-2.0], -3.0)])], "key string, paths array<struct<label string, token_ids array<int>, token_log_probabilities array<double>, score double>>")
    assert kinds(path_rules(paths)) == {"token paths repeat", "path score differs"}
    words = spark.createDataFrame([("k", [("A", "Very good", -1.0), ("B", "very bad", -1.0), ("C", "no", -1.0)])], "key string, options array<struct<label string, text string, score double>>")
    assert first_word_rules(words).count() == 1 and gather(first_word_rules(words)).count() == 1


def test_resume(spark, run):
    _, manifest, _, rows = run
    done = rows.where("model_key = 'm1' AND question_id <> 'Q1'")
    units = complete_units(done)
    left = pending_units(manifest, units)
    assert left.count() + units.count() == 10 and unexpected_units(manifest, units).count() == 0
    at = progress(manifest, units).first()
    assert (at.expected, at.completed, at.pending, at.unexpected) == (10, units.count(), left.count(), 0)
    assert fingerprint({"b": 1, "a": [1.5]}) == fingerprint({"a": [1.5], "b": 1}) != fingerprint({"a": [1.5], "b": 2})


def test_files(spark, run, tmp_path):
    _, manifest, _, rows = run
    table = rows.select("model_key", "unit_id", "condition", "prediction", "evidence_presented")
    one, two = (sinks.write_stable_jsonl(table, tmp_path / f"{i}/rows.jsonl.gz", ["model_key", "unit_id", "condition"]) for i in (1, 2))
    assert one == two and readers.line_count(spark, str(tmp_path / "1")) == 80
    schema = "model_key string, unit_id string, condition string, prediction map<string,double>, evidence_presented boolean"
    back = readers.read_jsonl(spark, str(tmp_path / "1"), schema)
    values = lambda df: sorted((r.model_key, r.unit_id, r.condition, sorted(r.prediction.items())) for r in df.collect())
    assert back.count() == 80 and values(back) == values(table)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.jsonl").write_text('{"model_key": "a"}\n\n[1]\n{"model_key"\n')
    assert sorted(r.fault for r in readers.bad_lines(spark, str(tmp_path / "bad")).collect()) == ["blank line", "no JSON", "not an object"]
    with pytest.raises(Exception, match="blank line|not an object|JSON"):
        readers.read_jsonl(spark, str(tmp_path / "bad"), schema).collect()
    data = {"Q1": {"question_id": "Q1", "domain": "GAS", "question": "?", "options": ["A", 2.0], "countries": {"X": {"distribution": {"A": 1, "2.0": 1}}, "Y": {"distribution": {"A": 1, "2.0": 3}}}}}
    (tmp_path / "data.json").write_text(json.dumps(data))
    questions, samples = readers.read_dataset(spark, str(tmp_path / "data.json"))
    assert questions.first().options == ["A", "2.0"] and [(r.country, r.place) for r in samples.orderBy("place").collect()] == [("X", 0), ("Y", 1)]
    pairs = [{"question_id": "Q1", "country": "X", "conflict_country": "Y", "options": ["A", "2.0"], "divergence_bits": 0.1}]
    (tmp_path / "pairs.json").write_text(json.dumps(pairs))
    assert readers.read_manifest(spark, str(tmp_path / "pairs.json")).first().unit_id == "Q1::X=>Y"
    (tmp_path / "res.json").write_text(json.dumps({"metadata": {}, "results": [{"a": None, "b": 1}, {"b": 2}]}))
    assert [r.place for r in readers.lacking_fields(spark, str(tmp_path / "res.json"), ["a", "b"]).collect()] == [1]
    sinks.write_csv(sinks.flat(table, ["unit_id"]), str(tmp_path / "csv"))
    flat = readers.read_csv(spark, str(tmp_path / "csv"), "unit_id string, condition string, evidence_presented string, model_key string, prediction string")
    assert flat.count() == 80 and {r.evidence_presented for r in flat.collect()} == {"true", "false"}
    files = readers.list_files(spark, str(tmp_path), "*.json")
    assert files.count() == 3 and sinks.hash_manifest(files).first().value.count("  ") == 1 and sinks.credential_hits(files).count() == 0
    digest = sinks.build_archive({"b": b"2", "a": b"1"}, tmp_path / "x.zip")
    assert digest == sinks.build_archive({"a": b"1", "b": b"2"}, tmp_path / "y.zip")
    assert sinks.verify_archive(tmp_path / "x.zip", {"a": "0" * 64, "c": ""}) == ["a: differs", "b: unexpected", "c: missing"]
    sinks.write_json_document({"n": 1}, tmp_path / "n.json")
    assert readers.load_settings(str(tmp_path / "n.json")) == {"shuffle_options": False, "n": 1}


def test_stream(spark, run, tmp_path):
    rows = run[3].select("model_key", "question_id", "label_country", "evidence_country", "condition")
    for i in (1, 2):
        sinks.write_jsonl(rows, str(tmp_path / f"in/{i}"))
    schema = "model_key string, question_id string, label_country string, evidence_country string, condition string"
    into_table(first_of_each(finished_rows(spark, str(tmp_path / "in/*"), schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80
