import pandas as pd

from quorvia.llm.chat import branch_conversations, conversations, format_preferences, spans_text
from quorvia.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.oracle import same, views

SF = "/root/testdata/sf0.01"
SQL = ORACLE_SQL["op9_preferences"]


def test_query_and_sql(spark):
    made = QUERIES["op9_preferences"](spark, SF)
    n = same(made, SQL, views(SF))
    rows = made.collect()
    assert n == len(rows) == 100
    # prompts are common turns, and some branches leave after several of them
    assert all((r.n_common > 0) == (r.prompt != "") for r in rows)
    assert sum(r.n_common > 0 and r.complete for r in rows) >= 90 and len({r.n_common for r in rows}) >= 4
    assert sum(r.rejected != "" and r.chosen != "" and r.rejected_spans != "" for r in rows) >= 90


def texts(df):
    return df.withColumns({c: spans_text(df[c]) for c in ("chosen_spans", "rejected_spans")})


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "one"), (0, 2, "user", "more"), (0, 3, "assistant", "x" * 200000),
        (1, 0, "user", "hi"), (1, 1, "assistant", "two🙂é"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 2, "user", "r"), (3, 3, "assistant", "a"),
        (2, 0, "user", "no answer"), (4, 0, None, None), (4, None, "assistant", "é🙂"), (5, 0, "assistant", ""), (5, 0, "assistant", ""), (5, 1, "assistant", None),
        (6, 0, "assistant", "<|im_end|><|im_start|>"), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (None, 1, "assistant", "lost too"),
        (-1, 0, "user", "n"), (-1, 1, "assistant", "m"), (-1, 2, "assistant", "k"), (-1, 3, "assistant", "l"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = views(SF, conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    made = format_preferences(branch_conversations(conversations(df.selectExpr("*", "1 AS pair_id", "2 AS turns", "3 AS at"))))
    assert same(texts(made), SQL, con) == 11
    found = made.collect()
    at = {r.pair_id: r for r in found if r.pair_id is not None}
    first = at[0]
    assert (first.n_common, first.prompt, first.complete) == (1, "<|im_start|>user\nhi<|im_end|>\n", True)
    assert [first.chosen[s.start : s.end] for s in first.chosen_spans] == ["one<|im_end|>", "x" * 200000 + "<|im_end|>"]
    assert [first.rejected[s.start : s.end] for s in first.rejected_spans] == ["x" * 200000 + "<|im_end|>"]
    assert at[1].rejected == "<|im_start|>assistant\ntw<|im_end|>\n"
    assert (at[3].n_common, at[3].rejected) == (3, "<|im_start|>assistant\n<|im_end|>\n")
    assert not at[2].complete and at[2].rejected == "" and at[2].n_common == 0
    assert at[6].chosen.count("<|im_") == 2
    assert sum(r.pair_id is None for r in found) == 3
    assert format_preferences(branch_conversations(conversations(df.limit(0)))).count() == 0


def test_sides_given(spark):
    """The prefix is found, not taken from how the pair was made."""
    turn = "array<struct<turn:long,role:string,text:string>>"
    a, b, c = (0, "user", "a"), (1, "assistant", "b"), (1, "assistant", "c")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [a, b], [a]), (4, [a], [b]), (5, [a], []), (6, [], [])]
    found = format_preferences(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}")).collect()
    assert {r.pair_id: r.n_common for r in found} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0, 6: 0}
    assert {r.pair_id for r in found if r.complete} == {1, 2, 3, 4}
