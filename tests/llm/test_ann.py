import numpy as np
import pytest
from pyspark.sql import functions as F

from quorvia.llm import ann
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(rows, k, asks):
    """Exact neighbours with equal vectors scored alike."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if asks(i):
            s = (x * np.array(v, np.float64)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for r in QUERIES["op2_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    vectors, hits = dict(rows), 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            assert r.score == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[r.vec_id], float))), rel=1e-12, abs=1e-12)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0] * 3), (None, [1.0] * 8), (1100, [float("inf")] * 8), (300, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, q string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    for q in want:
        assert [v for _, v, _ in sorted(got[q])] == [v for v, _ in want[q]]
    few = ann.nearest(df.where("vec_id < 5"), F.lit(True), 20).collect()
    assert len(few) == 5 * 4
    assert ann.nearest(df.limit(0), F.lit(True), 20).count() == 0


def test_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    report = {}
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 3 == 0, 5, recall=0.9, report=report).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 5, lambda i: i % 3 == 0)
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.85 * 5 * len(want) and report["recall"] >= 0.9 and 1 < report["visits"] <= report["leaves"]


def test_ties_of_scores_near_zero(spark):
    """Vectors that lie about at right angles to the query, many of them alike in score."""
    rng = np.random.default_rng(11)
    q = [1.0] + [0.0] * 7
    rows = [(0, q)] + [(i, [0.0, *rng.normal(size=7).tolist()]) for i in range(1, 120)] + [(i, [-1e-300 * (i % 3), *rng.normal(size=7).tolist()]) for i in range(120, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0, 20, recall=1.0).collect())
    assert [v for _, v in found] == [v for v, _ in brute(rows, 20, lambda i: i == 0)[0]]


def test_few_leaves_where_vectors_cluster(spark):
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(60, 16)) * 4
    x = middles[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    report = {}
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 10, report=report).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 10, lambda i: i % 50 == 0)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    assert report["recall"] >= 0.97 and report["visited_rows"] < 0.25


def test_ids_repeated_with_other_vectors(spark):
    """An id is one neighbour, at its nearest vector, and one query, from its nearest vector."""
    rng = np.random.default_rng(21)
    for least in (0, 40):
        rows = [(i, rng.normal(size=6)) for i in (20, 20, 2, 2, 1, 3, *range(100, 100 + least))] + [(2, np.ones(6)), (20, np.ones(6))] * 2
        df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
        for k in (2, 5):
            got = {}
            for r in ann.nearest(df, F.col("vec_id").isin(20, 2), k, recall=1.0).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
            for q in (20, 2):
                scores = {c: max(float((v * w).sum()) for i, v in rows if i == q for j, w in rows if j == c) for c, _ in rows if c != q}
                want = sorted(scores, key=lambda c: (-scores[c], c))[:k]
                found = sorted(got[q])
                assert [r for r, _, _ in found] == list(range(1, len(want) + 1)) and [v for _, v, _ in found] == want
                assert all(abs(s - scores[v]) < 1e-12 for _, v, s in found)
