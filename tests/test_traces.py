import json

import pytest
from pyspark.sql import functions as F

from quorvia.functions.chat_check import STYLES, first_differing_byte, serialization_fault, token_diagnostics
from quorvia.functions.prompts import serialize_messages
from quorvia.operators.full_rows import component_rules, full_row_rules, inside_another, trace_rules
from quorvia.plans import traces
from quorvia.sources.stored import stored
from tests.duck import same, views

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(traces.QUERIES))
def test_query_against_sql(spark, name):
    assert same(traces.QUERIES[name](spark, SF), traces.ORACLE_SQL[name], views(SF)) > 0


def test_what_is_met():
    con = views(SF)
    rules = {r[0] for r in con.sql(f"SELECT DISTINCT rule FROM ({traces.ORACLE_SQL['full_rows_report']})").fetchall()}
    assert rules == {*traces.TRACE_FAULTS, *(f"component {n}" for n in traces.COMPONENT_FAULTS), *(f"metric {n}" for n in traces.METRIC_FAULTS), "classification"}
    faults = {(r[0] or "")[-8:] for r in con.sql(f"SELECT DISTINCT fault FROM ({traces.ORACLE_SQL['chat_faults']})").fetchall()}
    assert {"", "boundary", " repeats", "rk lacks"} <= faults and len(faults) >= 6


def test_sound_rows_break_no_rule(spark):
    assert full_row_rules(traces.full_rows(spark, SF)).count() == 0


def test_broken_traces(spark):
    """Parts that are null or missing are named and stop nothing."""
    rows = traces.full_rows(spark, "/root/testdata/sf0.001").where("model_key = 'BUILDING' AND condition = 'baseline'").limit(1)
    rows = stored(rows, "test-rows")
    empty = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("candidates", "token_aliases", "raw_scores", "prompt_tokens", "answer_target")})
    assert {r.rule for r in trace_rules(empty).collect()} == {"candidate labels", "prompt tokens"}
    lone = rows.withColumn("divergences", F.lit(None).cast(rows.schema["divergences"].dataType))
    assert {r.rule for r in component_rules(lone).collect()} == {"conditions of the unit"}


def test_paths_inside_others(spark):
    cases = [([[1], [2]], False), ([[1, 2], [1]], True), ([[5, 1, 2], [5, 3], [5, 1]], True), ([[1, 2], [1, 2]], False), ([[1]], False), ([[2, 1], [1, 2, 3], [1, 3]], False), ([[1, 9], [1, 2, 3], [1, 2]], True), ([], False)]
    df = spark.createDataFrame([(p, w) for p, w in cases], "paths array<array<int>>, want boolean")
    assert all(r.got == r.want for r in df.select("want", inside_another(F.col("paths")).alias("got")).collect())


CHAT = [("system", "Be brief."), ("user", " Hi there \n"), ("assistant", "Hello."), ("user", "Bye [INST] é")]


def chats(spark, chat, style, damage=lambda t: t, answer=True):
    m = F.from_json(F.lit(json.dumps([{"role": r, "content": c} for r, c in chat])), "array<struct<role:string,content:string>>")
    df = spark.range(1).select(m.alias("m")).withColumn("text", damage(serialize_messages("m", style, answer)))
    return df.select(serialization_fault("text", "m", style, answer).alias("fault")).first().fault


@pytest.mark.parametrize("style", sorted(STYLES))
def test_acceptor_is_the_inverse_of_the_serialiser(spark, style):
    assert chats(spark, CHAT, style) is None and chats(spark, CHAT[1:], style) is None and chats(spark, CHAT, style, answer=False) is None
    assert chats(spark, CHAT, style, lambda t: F.replace(t, F.lit("Hello."), F.lit("Hullo."))) == f"turn {1 if style == 'inst' else 2}: content"
    assert chats(spark, CHAT, style, lambda t: F.lit("")) == "empty text"
    assert chats(spark, [("tool", "x")], style) == "turn 0: role" and chats(spark, [("user", "")], style) == "turn 0: empty content" and chats(spark, [("user", None)], style) is not None
    if STYLES[style].opening:
        twice = chats(spark, CHAT, style, lambda t: F.concat(F.lit(STYLES[style].opening * 2), t))
        assert twice == "opening mark repeats"
    if STYLES[style].suffix:
        assert chats(spark, CHAT, style, lambda t: F.concat(t, F.lit("x"))) == "answer boundary"
        assert chats(spark, [*CHAT, ("assistant", "late")], style, lambda t: F.replace(t, F.lit("late"), F.lit(""))).startswith("turn ")
    with pytest.raises(ValueError):
        serialization_fault("text", "m", "other")


def test_first_differing_byte(spark):
    pairs = [("", ""), ("a", "a"), ("a", "b"), ("aé", "aè"), ("é", "éx"), ("日本語", "日本吾"), ("x" * 5000 + "🙂y", "x" * 5000 + "🙃y"), ("", "z"), ("ab", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", first_differing_byte("a", "b").alias("d")).collect():
        a, b = r.a.encode(), r.b.encode()
        at = next((i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1]), None)
        want = None if at is None else (at, a[at] if at < len(a) else None, b[at] if at < len(b) else None)
        assert (tuple(r.d) if r.d else None) == want, (r.a[:20], r.b[:20])


def test_token_diagnostics(spark):
    rows = [([1, 5, 6], [1, 5, 6]), ([1, 5, 6], [1, 5, 7]), ([1, 1, 5], [1, 5]), ([5, 1], [5, 1]), ([], [1]), ([1, 5], [1, 5, 9])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").select(token_diagnostics("a", "b", 1).alias("d")).select("d.*")
    got = [(r.equal, r.differs_at, r.actual_id, r.expected_id, r.openings_actual, r.openings_expected, r.accepted) for r in df.collect()]
    assert got == [(True, None, None, None, 1, 1, True), (False, 2, 6, 7, 1, 1, False), (False, 1, 1, 5, 2, 1, False), (True, None, None, None, 1, 1, False), (False, 0, None, 1, 0, 1, False), (False, 2, None, 9, 1, 1, False)]
