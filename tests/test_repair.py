from pyspark.sql import functions as F

from quorvia.operators.pairs import directed_manifest
from quorvia.operators.repair import exclusion_summary, repair_survey

# fixed values: small questions, one for each rule
QUESTIONS = {
    "Q0001": (["A", "B"], {"X": [1, 1], "Y": [1, 1]}, "known_mixed_schema"),
    "Q0006": (["A", "B"], {"X": [1, 1], "Y": [1, 1]}, "alias_mapping_requires_review"),
    "Q0550": (["A", "B"], {"X": [1, 1], "Y": [1, 1]}, "country_specific_placeholder_unresolved"),
    "Q0311": (["A", "B"], {"X": [1, 1], "Y": [1, 1]}, "relative_time_without_survey_wave"),
    "Q2000": (["A", "A "], {"X": [1, 1]}, "invalid_options"),
    "Q2001": (["A"], {"X": [1]}, "invalid_options"),
    "Q2002": (["A", "  "], {"X": [1, 1]}, "invalid_options"),
    "Q2003": (["A", "B", "Total       N="], {"X": [1, 1, 1]}, "table_total_parser_artifact"),
    "Q2004": (["A", "DK/Refused"], {"X": [1, 1]}, "fewer_than_two_substantive_options"),
    "Q2005": (["A", "B"], {"X": [1, 1], "Y": [1], "Z": [1, 1], "W (Non-national sample)": [1, 1]}, "invalid_distribution_schema"),
    "Q2006": (["A", "B"], {"X": [1, 1], "Y (Old national sample)": [1, 1]}, "fewer_than_two_eligible_samples"),
    "Q2007": (["A", "B", "Don't know"], {"X": [1, 1, 2], "Y": [1, 1, 1], "Z": [1, 1, 0]}, None),
    "Q2008": (["A", "B", "C"], {"X": [1, 1, 0], "Y": [1, 1, 1]}, "incompatible_positive_option_support"),
    "Q2009": (["A", "B", "C"], {"X (Current national sample)": [1, 3, 0], "Y": [3, 1, 0], "Z": [1, 1, 0]}, None),
    "Q1510": ([" in my country", "B"], {"X": [1, 3], "Y": [3, 1]}, None),
}


def frames(spark):
    q = spark.createDataFrame([(k, "GAS", f"text {k}", o) for k, (o, _, _) in QUESTIONS.items()], "question_id string, domain string, question string, options array<string>")
    rows = [(k, c, i, dict(zip(o, map(float, p), strict=False))) for k, (o, by, _) in QUESTIONS.items() for i, (c, p) in enumerate(by.items())]
    return q, spark.createDataFrame(rows, "question_id string, country string, place int, distribution map<string,double>")


def test_rules_in_order(spark):
    out = repair_survey(*frames(spark))
    assert {r.question_id: r.reason for r in out["decisions"].collect()} == {k: r for k, (_, _, r) in QUESTIONS.items()}
    status = {(r.question_id, r.country): r.status for r in out["samples"].collect()}
    assert [status["Q2005", c] for c in ("X", "Y", "Z", "W (Non-national sample)")] == ["kept", "invalid", "unread", "unread"]
    assert [status["Q2007", c] for c in "XYZ"] == ["low mass", "kept", "kept"]
    counts = {(r.kind, r.reason): r["count"] for r in exclusion_summary(out["decisions"], out["samples"]).collect()}
    assert counts["question", "invalid_options"] == 3
    assert counts["sample", "explicit_non_national_or_old_removed"] == 1 and counts["sample", "insufficient_substantive_mass_removed"] == 1


def test_repaired_values(spark):
    out = repair_survey(*frames(spark))
    cells = {(r.question_id, r.country_display): r for r in out["cells"].collect()}
    assert set(cells) == {("Q2007", "Y"), ("Q2007", "Z"), ("Q2009", "X"), ("Q2009", "Y"), ("Q2009", "Z"), ("Q1510", "X"), ("Q1510", "Y")}
    x = cells["Q2009", "X"]
    # a category without mass everywhere stays
    assert (x.options, x.p, x.sample_status) == (["A", "B", "C"], [0.25, 0.75, 0.0], "current_national")
    q = {r.question_id: r for r in out["questions"].collect()}
    assert q["Q1510"].options == ["in the respondent's country", "B"] and q["Q1510"].source_question == "text Q1510" and q["Q2009"].source_question is None
    manifest = directed_manifest(out["cells"], 4, per_question=2).collect()
    assert len(manifest) == 4 and {(r.label_country, r.evidence_country) for r in manifest if r.question_id == "Q1510"} == {("X", "Y"), ("Y", "X")}
