import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorvia.functions import distributions as d
from quorvia.functions import prompts, text
from quorvia.operators.bootstrap import as_arrays, bootstrap, cluster_sums, replicate_values


def value(spark, column, **columns):
    df = spark.range(1).select(*[v.alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def mapping(**kw):
    return F.create_map(*[F.lit(x) for k, v in kw.items() for x in (k, float(v))])


def test_divergence_ends(spark):
    assert value(spark, d.js_divergence(array(1, 0), array(0, 1))) == 1.0
    assert value(spark, d.js_divergence(array(2, 3), array(2, 3), strict=True)) == 0.0
    assert value(spark, d.js_divergence(array(0, 0), array(1, 1))) is None


def test_override_ends(spark):
    label, evidence = array(1, 0), array(0.2, 0.8)
    over = lambda p, **k: value(spark, d.evidence_override_normalized(p, label=label, evidence=evidence, **k))
    assert over(evidence) == pytest.approx(1) and over(label) == pytest.approx(-1)
    assert value(spark, d.evidence_override_normalized(label, label=label, evidence=label)) is None
    with pytest.raises(Exception, match="undefined"):
        value(spark, d.evidence_override_normalized(label, label=label, evidence=label, strict=True))
    assert [value(spark, d.classify_conflict(F.lit(x))) for x in (1e-11, -1e-11, 1e-13)] == ["evidence-side", "label-side", "tie"]


def test_normalise_and_faults(spark):
    o = F.array(F.lit("A"), F.lit("B"))
    assert value(spark, d.normalize_distribution(mapping(A=2, B=3), o)) == [0.4, 0.6]
    assert value(spark, d.normalize_distribution(mapping(B=3, A=2))) == [0.4, 0.6]
    fault = lambda m: value(spark, d.distribution_fault(m, o, 1e-8))
    cases = {"keys": mapping(A=1), "no mass": mapping(A=0, B=0), "negative": mapping(A=-1, B=2), "not finite": mapping(A=math.nan, B=1), "sum": mapping(A=1, B=1)}
    assert {k: fault(m) for k, m in cases.items()} == {k: k for k in cases} and fault(mapping(A=0.5, B=0.5)) is None
    assert fault(mapping(A=math.inf, B=1)) == "not finite"
    with pytest.raises(Exception, match="invalid distribution"):
        value(spark, d.normalize_distribution(mapping(A=-1, B=2), o))


def test_rounding(spark):
    assert value(spark, d.largest_remainder(array(1, 1, 1))) == [33333334, 33333333, 33333333]
    assert sum(value(spark, d.presented_evidence(array(1, 1, 1)))) == pytest.approx(1, abs=1e-15)
    line = value(spark, prompts.format_evidence(array(3, 2), F.array(F.lit("Yes"), F.lit("No"))))
    assert line == "A (Yes): 60.000000%, B (No): 40.000000%"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=2, max_size=9).filter(lambda x: sum(a for a, _ in x) and sum(b for _, b in x)))
def test_properties(spark, pairs):
    p, q = array(*[a for a, _ in pairs]), array(*[b for _, b in pairs])
    row = spark.range(1).select(d.js_divergence(p, q).alias("pq"), d.js_divergence(q, p).alias("qp"), d.largest_remainder(p).alias("t"), d.normalize_log_scores(p).alias("s")).first()
    assert 0 <= row.pq <= 1 and row.pq == pytest.approx(row.qp, abs=1e-15)
    assert sum(row.t) == 10**8 and sum(row.s) == pytest.approx(1)


def test_labels_and_softmax(spark):
    assert value(spark, d.option_labels(3)) == ["A", "B", "C"]
    with pytest.raises(Exception, match="between 1 and 26"):
        value(spark, d.option_labels(27))
    s = value(spark, d.normalize_log_scores(array(1000, 1001)))
    assert s == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    back = d.map_label_probabilities(F.array(F.lit("A"), F.lit("B")), array(1, 3), d.label_map(F.array(F.lit("No"), F.lit("Yes"))))
    assert value(spark, d.recover_canonical(back, F.array(F.lit("Yes"), F.lit("No")))) == [0.75, 0.25]


def test_nonresponse(spark):
    # fixed values: samples of both kinds
    yes = ["DK/Refused", "Don't know", "Don’t know", "No answer/refused", "Missing", "Not available".replace("available", "answered"), "Refused", " not sure "]
    no = ["Both", "Neither", "None at all", "Depends on the situation (VOL)", "Other (VOL)", "Donkey", "Refuser"]
    for o in yes:
        assert value(spark, text.is_nonresponse(F.lit(o))), o
    for o in no:
        assert not value(spark, text.is_nonresponse(F.lit(o))), o
    assert value(spark, text.is_table_total(F.lit("Total       N=")))
    assert value(spark, text.display_country(F.lit("X (Current national sample)"))) == "X"


def test_prompts(spark):
    o = F.array(F.lit("Yes"), F.lit("No"))
    tail = "\nQuestion: Q?\nOptions:\nA. Yes\nB. No\n\nReply with exactly one of these option labels: A, B. Do not output anything else.\nAnswer:"
    made = {c: value(spark, prompts.prompt(c, F.lit("Q?"), o, country=F.lit("X"), evidence=F.lit("a, b, c"))) for c in (*prompts.CONDITIONS, *prompts.OPENINGS)}
    assert all(m.endswith(tail) for m in made.values()) and len(set(made.values())) == 10
    assert made["baseline"] == prompts.CORE_OPENING + "\n\n" + tail[1:]
    assert made["conflict"] == prompts.CORE_OPENING + "\nTarget Country: X\nSurvey Response Statistics: a, b, c" + tail
    assert "Related Information: a, b\n" in made["evidence_incomplete"] and "from X." in made["persona"]
    with pytest.raises(ValueError):
        prompts.prompt("conflict", F.lit("Q?"), o, country=F.lit("X"))


def test_bootstrap_counts_multiplicity(spark):
    # fixed values: two clusters; a cluster drawn twice weighs twice
    rows = [("a", "m", "Q1", v) for v in (1.0, 3.0)] + [("a", "m", "Q2", v) for v in (10.0, 12.0, 12.0, 14.0)]
    rows += [("b", "m", q, 2 * v) for _, _, q, v in rows]
    long = spark.createDataFrame(rows, "model_key string, metric string, question_id string, value double")
    sums = cluster_sums(long)
    draws = spark.createDataFrame([(0, [0, 0]), (1, [0, 1]), (2, [1, 0]), (3, [1, 1])], "replicate long, draw array<int>")
    got = {(r.model_key, r.replicate): r.value for r in replicate_values(as_arrays(sums), draws).collect()}
    assert [got["a", i] for i in range(4)] == [2, 52 / 6, 52 / 6, 12] and got["b", 1] == 104 / 6
    out = {r.model_key: r for r in bootstrap(long, replicates=200, seed=7).collect()}
    assert out["a"].estimate == 52 / 6 and (out["a"].ci_lower, out["a"].ci_upper) == (2, 12) and out["a"].n == 6
    one = bootstrap(long.where("question_id = 'Q1'"), replicates=1, draws="arithmetic").first()
    assert (one.se, one.ci_lower, one.ci_upper) == (0, 2, 2)
    with pytest.raises(ValueError):
        bootstrap(long, confidence=1.0)
