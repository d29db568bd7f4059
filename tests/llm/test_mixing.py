from collections import defaultdict

import pandas as pd

from quorvia.llm import mixing
from quorvia.llm.mixing import mix_documents, mixed
from quorvia.llm.queries import OP8_SQL, QUERIES
from tests.llm.oracle import same, views

SF = "/root/testdata/sf0.01"


def test_query_and_sql(spark):
    assert same(QUERIES["op8_mixing"](spark, SF), OP8_SQL, views(SF)) == 1000


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def test_targets_and_laws(spark):
    rows = [(i, "w " * (1 + i * 37 % 11), None if i % 9 == 0 else "abc"[i % 3], i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mix_documents(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = fill(sizes)
    for r in found:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source]
    assert all(abs(taken[s] - want[s]) <= 11 for s in want)
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in found)


def test_nested(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(500)], "doc_id long, text string, source string")
    small = {r.doc_id for r in mix_documents(df, share=0.3).where("copies > 0").collect()}
    large = {r.doc_id for r in mix_documents(df, share=0.6).where("copies > 0").collect()}
    assert small < large and abs(len(small) - 150) <= 1 and abs(len(large) - 300) <= 1


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", "x"), (1, " \t\n\x0b", "x"), (2, "a b c", "y"), (2, "a b c", "y"), (3, "w " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert same(mix_documents(df).select("doc_id", "size", "source_size", "target", "taken"), OP8_SQL, views(SF, documents=pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))) == 6
    assert mix_documents(df.limit(0)).count() == 0
    assert mixed(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_documents(empty).collect()] == [(0, 0.0, 0)] * 2


def test_clashing_names(spark):
    names = ["times", "below", "mix_source", "mix_times", "mix_below", "mix_copy", "__source", "__copy", "a.b", "hash", "size"]
    df = spark.createDataFrame([(i, "w " * (i % 5 + 1), "ab"[i % 2], *names) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixed(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == sum(r.copies for r in mix_documents(df).collect()) and all(r["a.b"] == "a.b" and r["times"] == "times" for r in rows)


def test_shuffled_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    rows = [(i, "w " * (1 + i % 7), f"s{i % 40}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    assert same(mix_documents(df).select("doc_id", "size", "source_size", "target", "taken"), OP8_SQL, views(SF, documents=frame)) == 800
