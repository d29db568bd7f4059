import pytest

from quorvia.operators.repair import REASONS
from quorvia.plans import contracts, queries
from tests.duck import same, views

QUERIES = queries.QUERIES | contracts.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | contracts.ORACLE_SQL
EMPTY = {"reciprocal_check", "permutation_constancy", "coverage_diff"}
#: What must be met: a report without one of its rules would prove nothing about it.
RULES = {
    "row_contract": {"unit id", "displayed options", "label map", "round trip", "softmax", "presented evidence", "evidence without condition", "evidence flag", "prompt hash", "unknown condition", "self pair", "target unit id", "prompt missing", "options", "log scores", "label probabilities", "prediction distribution", "label_reference distribution", "evidence_reference distribution"},
    "origin_report": {"synthetic", "backend", "scoring method", "generated answer", "unknown question", "rows of model"},
    "cluster_report": {"country_influence not finite", "duplicate target", "missing reciprocal", "endpoint without target", "target without endpoint", "target not in all models", "unit not in all models"},
    "manifest_report": {"duplicate pair", "missing reciprocal", "unit id", "unknown label_country", "unknown evidence_country", "size"},
    "reference_report": {"evidence reference differs", "endpoint orientation", "target metric varies with its partner"},
    "recomputed_report": {"stored EO_raw differs", "not derived", "not stored"},
    "order_report": {"row out of order", "missing row", "unexpected row"},
    "survey_report": {"options", "distribution", "fewer than two samples", "other options", "divergence", "question without domain"},
    "violations_report": {"unknown pair", "unequal coverage", "duplicate row", "incomplete conditions", "distribution: sum"},
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert same(QUERIES[name](spark, sf), ORACLE_SQL[name], views(sf)) > 0 or name in EMPTY


def test_every_query_runs_on_the_smallest_tables(spark):
    for name in ("pairs_top", "shuffle_options", "bootstrap_ci_pcg64"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", sorted(RULES))
def test_reports_meet_their_rules(name):
    met = {r[0] for r in views("/root/testdata/sf0.01").sql(f"SELECT DISTINCT rule FROM ({ORACLE_SQL[name]})").fetchall()}
    assert met == RULES[name]


def test_every_reason_is_met():
    met = {r[0] for r in views("/root/testdata/sf0.01").sql(f"SELECT DISTINCT reason FROM ({ORACLE_SQL['quarantine_reason']})").fetchall()}
    assert met <= {*REASONS, None}
    assert {"invalid_options", "fewer_than_two_substantive_options", "invalid_distribution_schema", "fewer_than_two_eligible_samples", "table_total_parser_artifact", None} <= met


def test_ties_are_met():
    con = views("/root/testdata/sf0.01")
    assert con.sql(f"SELECT sum(tie_n) FROM ({ORACLE_SQL['conflict_classes']})").fetchall()[0][0] > 0
    assert {"evidence-side", "label-side", "tie"} == {r[0] for r in con.sql(f"SELECT classification FROM ({ORACLE_SQL['class_proportions']}) WHERE n > 0").fetchall()}
