import json

import pytest
from pyspark.sql import functions as F

from quorvia.functions.variants import is_number, is_text, kind, value_text
from quorvia.operators.repair import repair_survey, source_counts
from quorvia.plans import typed
from quorvia.sources import readers
from tests.duck import same, views

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(typed.QUERIES))
def test_query_against_sql(spark, name):
    assert same(typed.QUERIES[name](spark, SF), typed.ORACLE_SQL[name], views(SF)) > 0


def test_scalars_are_those_of_python(spark):
    texts = ["1", "-7", "1.0", "-1.0", "2.50", "1e3", "1e-7", "0.1", "true", "false", '"x"', '" 1 "', "null", "12345678901234567890", "1e300", "0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("v"))
    rows = df.select("t", value_text("v").alias("text"), is_text("v").alias("is_text"), is_number("v").alias("is_number"), kind("v").alias("kind")).collect()
    for r in rows:
        value = json.loads(r.t)
        assert r.text == str(value) and r.is_text == isinstance(value, str), r
        assert r.is_number == (isinstance(value, (int, float)) and not isinstance(value, bool)), r
    nested = spark.sql("""select parse_json('{"b": [1, "x"], "a": {}}') v, cast(null as variant) n""")
    assert nested.select(value_text("v").alias("v"), value_text("n").alias("n"), is_text("n").alias("t")).first()[:] == ('{"a":{},"b":[1,"x"]}', None, False)


def test_numeric_options_of_a_survey(spark, tmp_path):
    sample = {"distribution": {"1": 0.5, "2.0": 0.5}, "sample_status": "national"}
    data = {
        "Q1": {"domain": "GAS", "question": "a?", "options": [1, 2.0], "countries": {"X": sample, "Y (Old national sample)": sample}},
        "Q2": {"domain": "GAS", "question": "b?", "options": ["1", "2.0"], "countries": {"X": sample}},
        "Q3": {"domain": "GAS", "question": "c?", "options": ["1", True], "countries": {}},
    }
    (tmp_path / "data.json").write_text(json.dumps(data))
    questions, samples = readers.read_dataset(spark, str(tmp_path / "data.json"))
    assert {r.question_id: (r.options, r.numeric_options) for r in questions.collect()} == {"Q1": (["1", "2.0"], True), "Q2": (["1", "2.0"], False), "Q3": (["1", "True"], True)}
    assert source_counts(questions, samples).first().asDict() == {"units": 3, "non_national": 0, "old_national": 1, "current_national": 0, "questions": 3, "numeric_option_questions": 2}
    assert source_counts(questions.drop("numeric_options"), samples).first().numeric_option_questions == 0


ROWS = {
    "one": [{"unit_id": "u1", "condition": "evidence", "quantization": "Q4", "permutation_seed": 18446744073709551615, "original_options": ["a", 1, 2.0, True], "normalized_prediction": {"a": 0.5, "b": 0.5}, "candidate_label_token_ids": {"A": [1, 2]}}],
    "two": [{"unit_id": "u2", "condition": "conflict", "quantization": {"bits": 4}, "permutation_seed": "18446744073709551615", "original_options": ["a"], "normalized_prediction": {"a": "0.25", "b": 1}}],
    "three": [{"unit_id": "u3", "condition": "baseline", "quantization": None, "extra": [1]}],
    "four": [{"unit_id": "u4", "condition": "baseline", "quantization": 4.5, "synthetic": False, "evidence_presented": True}],
}


def written(tmp_path, rows):
    for name, some in rows.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in some))
    return {name: str(tmp_path / f"{name}.jsonl") for name in rows}


def test_four_models_of_unlike_types(spark, tmp_path):
    paths = written(tmp_path, ROWS)
    df = readers.read_model_results(spark, paths, rows_per_model=1, names={"one": "One"})
    assert dict(df.dtypes)["quantization"] == "variant" and dict(df.dtypes)["permutation_seed"] == "decimal(20,0)"
    rows = {r.model_key: r for r in df.withColumn("q", value_text("quantization")).withColumn("t", kind("quantization")).drop("quantization").collect()}
    assert [(rows[m].t, rows[m].q) for m in ROWS] == [("STRING", "Q4"), ("OBJECT<bits: BIGINT>", '{"bits":4}'), ("VOID", "None"), ("DECIMAL(2,1)", "4.5")]
    assert rows["one"].original_options == ["a", "1", "2.0", "True"] and rows["one"].condition == "population_evidence" and rows["one"].model_name == "One"
    assert rows["one"].permutation_seed == rows["two"].permutation_seed == 2**64 - 1 and rows["one"].candidate_label_token_ids == {"A": [1, 2]}
    assert rows["two"].normalized_prediction == {"a": 0.25, "b": 1.0} and rows["three"].normalized_prediction is None and rows["four"].synthetic is False


def test_incomplete_or_odd_results_are_errors(spark, tmp_path):
    paths = written(tmp_path, ROWS)
    with pytest.raises(ValueError, match="incomplete model output"):
        readers.read_model_results(spark, paths, rows_per_model={"one": 1, "two": 2, "three": 1, "four": 1})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_model_results(spark, {"one": str(tmp_path / "none.jsonl")}, rows_per_model=1)
    with pytest.raises(ValueError, match="no model"):
        readers.read_model_results(spark, {}, rows_per_model=1)
    for line in ("[1]", "", "{", "3"):
        (tmp_path / "odd.jsonl").write_text(line + "\n")
        with pytest.raises(Exception, match="bad result row of odd"):
            readers.read_model_results(spark, {"odd": str(tmp_path / "odd.jsonl")}, rows_per_model=1)


def test_harmonised_predictions(spark, tmp_path):
    plain = ROWS | {"two": [ROWS["two"][0] | {"normalized_prediction": {"a": 0.25, "b": 0.75}}]}
    rows = {r.unit_id: r for r in readers.read_predictions(spark, list(written(tmp_path, plain).values())[1:]).collect()}
    assert [(rows[u].quantization, rows[u].condition) for u in ("u2", "u3", "u4")] == [('{"bits":4}', "conflict"), (None, "baseline"), ("4.5", "baseline")]


def test_keys_that_become_equal(spark):
    """The later value counts, as one object that holds a key twice; a sample may not stop the survey."""
    questions = spark.createDataFrame([("Q2000", "GAS", "a", ["A", "B"])], "question_id string, domain string, question string, options array<string>")
    samples = [("X", 0, {"A": 1.0, " A ": 3.0, "B": 1.0}), ("Y", 1, {"A": 1.0, "B": 3.0}), ("Z", 2, {"B": 9.0, " B": 2.0, "B ": 1.0, "A": 1.0})]
    found = repair_survey(questions, spark.createDataFrame([("Q2000", *s) for s in samples], "question_id string, country string, place int, distribution map<string,double>"))
    assert {r.country: r.p for r in found["cells"].collect()} == {"X": [0.75, 0.25], "Y": [0.25, 0.75], "Z": [0.5, 0.5]}
    assert found["decisions"].first().reason is None
