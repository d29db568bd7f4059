import numpy as np
import pytest
from pyspark.sql import functions as F

from quorvia.operators import farthest
from quorvia.operators.farthest import bounded_pairs, distances, farthest_pairs
from quorvia.operators.pairs import candidate_pairs, directed_manifest, top_pairs
from quorvia.plans import queries
from quorvia.sources.stored import stored
from tests.duck import same, views

SF = "/root/testdata/sf0.01"


def cells(spark, by_question):
    rows = [(q, f"c{i:05d}", [float(x) for x in p]) for q, some in by_question.items() for i, p in enumerate(some)]
    return stored(spark.createDataFrame(rows, "question_id string, country string, p array<double>"), "test-cells")


def rows(df):
    return sorted((r.question_id, r.a, r.b, round(r.divergence, 9), r.place) for r in df.collect())


@pytest.mark.parametrize("name", ["pairs_bounded", "farthest_customers"])
def test_query_against_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], views(SF)) >= 15


def test_same_rows_as_all_pairs(spark):
    rng = np.random.default_rng(3)
    some = {
        "even": rng.dirichlet([1] * 4, 150), "peaked": rng.dirichlet([0.2] * 5, 120), "flat": rng.dirichlet([30] * 3, 100), "many": rng.dirichlet([1] * 12, 80),
        "copies": np.repeat(rng.dirichlet([1] * 3, 5), 20, 0), "corners": np.eye(6).repeat(4, 0), "two": rng.dirichlet([1] * 3, 2), "one": rng.dirichlet([1] * 3, 1), "three": rng.dirichlet([1] * 3, 3), "same": np.full((9, 3), 1 / 3),
    }
    df = cells(spark, some)
    every = candidate_pairs(df)
    for best in (1, 3, 7):
        assert rows(farthest_pairs(df, best)) == rows(top_pairs(every, best))
    assert rows(farthest_pairs(df, 3, 11)) == rows(top_pairs(every, 3, 11))
    assert rows(directed_manifest(df, 20, few=10).withColumnsRenamed({"label_country": "a", "evidence_country": "b"}).withColumn("place", F.lit(0))) == rows(
        directed_manifest(df, 20).withColumnsRenamed({"label_country": "a", "evidence_country": "b"}).withColumn("place", F.lit(0))
    )


def test_populations_without_mass_and_no_populations(spark):
    df = cells(spark, {"Q": [[0, 0], [1, 0], [0, 2], [1, 1]]})
    assert [(r.a, r.b) for r in farthest_pairs(df, 1).collect()] == [("c00001", "c00002")] and distances(df).count() == 3
    assert farthest_pairs(df.limit(0)).count() == 0


def divergences(points, p):
    m = (points + p) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(points > 0, points * np.log2(points / m), 0) + np.where(p > 0, p * np.log2(p / m), 0)
    return terms.sum(axis=1) / 2


def test_many_populations_of_one_question(spark):
    """20,000 populations: fewer than a tenth of the pairs get a divergence, and the best are those of all pairs."""
    points = np.random.default_rng(8).dirichlet([2] * 5, 20_000)
    df = cells(spark, {"Q": points})
    made = stored(bounded_pairs(df, 3), "test-made")
    n = made.count()
    assert n < 0.1 * 20_000 * 19_999 / 2
    got = [(r.a, r.b) for r in top_pairs(made, 3).orderBy("place").collect()]
    best = []
    for i in range(0, 20_000 - 1):
        d = divergences(points[i + 1 :], points[i])
        for j in np.argpartition(d, -min(3, len(d)))[-3:]:
            best.append((round(-d[j], 12), f"c{i:05d}", f"c{i + 1 + j:05d}"))
        best = sorted(best)[:3]
    assert got == [b[1:] for b in best]


def test_few_pairs_are_made(spark):
    """Of 1,200 populations, copies or not, little more than the best pairs get a divergence."""
    rng = np.random.default_rng(5)
    df = cells(spark, {"copies": np.repeat(rng.dirichlet([2] * 5, 40), 30, 0), "apart": rng.dirichlet([2] * 5, 1200)})
    made = stored(bounded_pairs(df, 3), "test-made")
    assert all(r["count"] < 200 for r in made.groupBy("question_id").count().collect())
    assert rows(top_pairs(made, 3)) == rows(top_pairs(candidate_pairs(df), 3))


def test_blocks_halved_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(farthest, "FEW", 0)
    monkeypatch.setattr(farthest, "PART", 3)
    rng = np.random.default_rng(6)
    some = {"even": rng.dirichlet([1] * 4, 200), "many": rng.dirichlet([1] * 12, 60), "two": rng.dirichlet([1] * 2, 90), "sparse": rng.dirichlet([0.1] * 6, 90), "copies": np.repeat(rng.dirichlet([1] * 3, 5), 20, 0)}
    df = cells(spark, some)
    for best in (1, 4):
        assert rows(farthest_pairs(df, best)) == rows(top_pairs(candidate_pairs(df), best))
