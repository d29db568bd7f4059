import numpy as np
from pyspark.sql import functions as F

from quorvia.operators.blocks import block_bootstrap, block_counts, draws_of_block, replicate_sums, weight_counts
from quorvia.operators.bootstrap import as_arrays, cluster_sums, replicate_values
from quorvia.plans import queries
from quorvia.sources.stored import stored
from tests.duck import same, views

SF = "/root/testdata/sf0.01"


def test_weights_against_sql(spark):
    assert same(queries.QUERIES["bootstrap_weights"](spark, SF), queries.ORACLE_SQL["bootstrap_weights"], views(SF)) > 0


def test_counts_are_multinomial():
    before = np.cumsum([0, 5, 0, 9, 1, 7, 11])
    counts = np.concatenate([block_counts(before, b, 4000, 0, 42) for b in range(6) if before[b + 1] > before[b]], axis=1)
    assert counts.shape == (4000, 33) and (counts.sum(axis=1) == 33).all()
    assert sum(draws_of_block(before, b, 4000, 0, 42) for b in range(6)).tolist() == [33] * 4000
    # every cluster is drawn once on average, with the variance and covariance of a multinomial
    assert abs(counts.mean(axis=0) - 1).max() < 0.1 and abs(counts.var(axis=0) - 32 / 33).max() < 0.12
    covariance = np.cov(counts.T)
    assert abs(covariance[~np.eye(33, dtype=bool)].mean() + 1 / 33) < 0.01
    assert (block_counts(before, 2, 50, 0, 42) == block_counts(before, 2, 50, 0, 42)).all() and (block_counts(before, 2, 50, 1, 42) != block_counts(before, 2, 50, 0, 42)).any()


def frame(spark, n):
    rng = np.random.default_rng(2)
    rows = [(m, x, f"q{i:03d}", float(rng.normal())) for m in "ab" for x in ("u", "v") for i in range(n) for _ in range(rng.integers(0, 4))]
    return spark.createDataFrame(rows, "model_key string, metric string, question_id string, value double")


def test_equal_counts_give_the_values_of_arrays(spark):
    """The counts of the blocks as draws of the other way: every replicate has the same value."""
    sums = stored(cluster_sums(frame(spark, 60)), "test-sums")
    got = {(r.model_key, r.metric, r.replicate): r.total / r.n for r in replicate_sums(sums, replicates=250, block=7, at_once=100).collect()}
    ids = sorted(r.question_id for r in sums.select("question_id").distinct().collect())
    n_blocks = -(-len(ids) // 7)
    of = {r.question_id: r.b for r in sums.select("question_id", F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)).alias("b")).distinct().collect()}
    blocks = [[i for i in ids if of[i] == b] for b in range(n_blocks)]
    before = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    draws = []
    for chunk, first in enumerate((0, 100, 200)):
        some = min(100, 250 - first)
        counts = [block_counts(before, b, some, chunk, 42) if blocks[b] else np.zeros((some, 0), int) for b in range(n_blocks)]
        for r in range(some):
            draws.append((first + r, [ids.index(i) for b in range(n_blocks) for i, n in zip(blocks[b], counts[b][r], strict=True) for _ in range(n)]))
    assert all(len(d) == len(ids) for _, d in draws)
    want = replicate_values(as_arrays(sums), spark.createDataFrame(draws, "replicate long, draw array<int>")).collect()
    assert len(want) == len(got) == 4 * 250
    assert all(abs(got[r.model_key, r.metric, r.replicate] - r.value) < 1e-12 for r in want)


def test_weights_are_those_of_the_rule(spark):
    sums = stored(cluster_sums(frame(spark, 20)), "test-sums")
    got = {(r.model_key, r.metric, r.replicate): (r.total, r.n) for r in replicate_sums(sums, replicates=130, draws="weights", block=3, at_once=50).collect()}
    rows = sums.collect()
    for replicate in (0, 49, 50, 129):
        for key in {(r.model_key, r.metric) for r in rows}:
            own = [r for r in rows if (r.model_key, r.metric) == key]
            times = weight_counts([r.question_id for r in own], replicate, 1, 42)[0]
            assert abs(got[*key, replicate][0] - sum(t * r.total for t, r in zip(times, own, strict=True))) < 1e-9
            assert got[*key, replicate][1] == sum(t * r.n for t, r in zip(times, own, strict=True))


def test_many_clusters(spark):
    """100,000 clusters by 10,000 replicates: a standard error as theory has it, without an array of all clusters."""
    long = spark.range(100_000).select(F.lit("m").alias("model_key"), F.explode(F.array(F.lit("u"), F.lit("v"))).alias("metric"), F.format_string("q%06d", "id").alias("question_id"), F.randn(3).alias("value"))
    found = {r.metric: r for r in block_bootstrap(long).collect()}
    assert set(found) == {"u", "v"}
    for r in found.values():
        assert (r.n, r.clusters, r.replicates) == (100_000, 100_000, 10_000)
        assert abs(r.se * 100_000**0.5 - 1) < 0.05 and abs(r.mean - r.estimate) < 5 * r.se / 100
        assert abs((r.ci_upper - r.ci_lower) / (2 * 1.96 * r.se) - 1) < 0.06


def test_odd_inputs(spark):
    import pytest

    long = frame(spark, 3)
    with pytest.raises(ValueError):
        block_bootstrap(long, draws="pcg64")
    assert block_bootstrap(long.limit(0), replicates=10).count() == 0
    one = block_bootstrap(spark.createDataFrame([("m", "u", "q", 2.0)], long.schema), replicates=10).first()
    assert (one.estimate, one.mean, one.se, one.ci_lower, one.ci_upper) == (2.0, 2.0, 0.0, 2.0, 2.0)
