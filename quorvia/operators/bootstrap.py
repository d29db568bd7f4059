"""Question-clustered percentile bootstrap on cluster sums.

A replicate draws clusters with replacement; its value is the sum of the drawn clusters'
sums over the sum of their counts, so a cluster drawn twice weighs twice. All models and
metrics share the draws. Only cluster sums are shuffled, never units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.sources.stored import stored


def cluster_sums(long: DataFrame) -> DataFrame:
    """model_key, metric, question_id, total, n."""
    return long.groupBy("model_key", "metric", "question_id").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def as_arrays(sums: DataFrame) -> DataFrame:
    """model_key, metric, totals and counts as arrays in the sorted order of clusters; clusters a series lacks are 0."""
    ids = sums.agg(F.array_sort(F.collect_set("question_id")).alias("ids"))
    # every series at every cluster: one row of ids on the right, then filled and sorted
    grid = sums.select("model_key", "metric").distinct().crossJoin(F.broadcast(ids)).select("model_key", "metric", F.explode("ids").alias("question_id"))
    filled = grid.join(sums, ["model_key", "metric", "question_id"], "left")
    cell = F.struct("question_id", F.coalesce("total", F.lit(0.0)).cast("double").alias("total"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    df = filled.groupBy("model_key", "metric").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return df.select("model_key", "metric", F.col("c.total").alias("totals"), F.col("c.n").alias("counts"), F.size("c").alias("k"))


def arithmetic_draws(spark: SparkSession, replicates: int, k: int, seed: int = 42) -> DataFrame:
    """replicate, draw (array of cluster places): a plain rule that any engine can repeat.

    The square keeps a replicate from drawing every cluster once, as a sum alone would.
    """
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    x = lambda s: (F.col("replicate") * 7919 + s * 104729 + seed) % 1000003
    place = lambda s: (x(s) * x(s) % 998244353 % k).cast("int")
    return spark.range(replicates).select(F.col("id").alias("replicate")).withColumn("draw", F.transform(slots, place))


def pcg64_draws(spark: SparkSession, replicates: int, k: int, seed: int = 42, at_once: int = 1000) -> DataFrame:
    """NumPy's default generator: one matrix of replicates by clusters, a range of rows in each task.

    Drawn numbers can't be skipped without being drawn, so a task runs through those before its own.
    """
    ranges = -(-replicates // at_once)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in (batch["id"] * at_once).tolist():
                stream = np.random.default_rng(seed)
                before = first * k
                while before:
                    n = min(before, 1 << 20)
                    stream.integers(0, k, size=n)
                    before -= n
                rows = stream.integers(0, k, size=(min(at_once, replicates - first), k)).astype("int32")
                yield pd.DataFrame({"replicate": np.arange(first, first + len(rows)), "draw": list(rows)})

    return spark.range(0, ranges, 1, min(ranges, 200)).mapInPandas(run, "replicate long, draw array<int>")


def replicate_values(arrays: DataFrame, draws: DataFrame) -> DataFrame:
    """model_key, metric, replicate, value: every series at every draw."""
    total = F.aggregate("draw", F.lit(0.0), lambda a, i: a + F.get("totals", i))
    count = F.aggregate("draw", F.lit(0.0), lambda a, i: a + F.get("counts", i))
    return draws.crossJoin(arrays).select("model_key", "metric", "replicate", F.try_divide(total, count).alias("value"))


def bootstrap(long: DataFrame, *, replicates: int = 10_000, confidence: float = 0.95, seed: int = 42, draws: str = "pcg64") -> DataFrame:
    """model_key, metric, n, estimate, mean, se, ci_lower, ci_upper, replicates, clusters, seed.

    draws: pcg64 (as NumPy draws them) or arithmetic. Bounds are linear quantiles.
    """
    if replicates < 1 or not 0 < confidence < 1 or draws not in ("pcg64", "arithmetic"):
        raise ValueError("at least one replicate, a confidence between 0 and 1, and known draws are needed")
    spark = long.sparkSession
    sums = stored(cluster_sums(long), "cluster-sums")
    k = sums.select("question_id").distinct().count()
    made = (pcg64_draws if draws == "pcg64" else arithmetic_draws)(spark, replicates, max(k, 1), seed)
    values = replicate_values(stored(as_arrays(sums), "cluster-arrays"), made)
    return spread(sums, values, replicates=replicates, confidence=confidence, seed=seed)


def spread(sums: DataFrame, values: DataFrame, *, replicates: int, confidence: float, seed: int) -> DataFrame:
    """Point estimates of cluster sums, and mean, standard error and interval of the replicates' values."""
    tail = (1 - confidence) / 2
    bounds = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    by = values.groupBy("model_key", "metric").agg(bounds.alias("b"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("se"))
    point = sums.groupBy("model_key", "metric").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("estimate"))
    k = sums.agg(F.count_distinct("question_id").alias("clusters"))
    return point.crossJoin(k).join(by, ["model_key", "metric"]).select(  # one row on the right
        "model_key", "metric", "n", "estimate", "mean", "se", F.col("b")[0].alias("ci_lower"), F.col("b")[1].alias("ci_upper"),
        F.lit(replicates).cast("long").alias("replicates"), "clusters", F.lit(seed).cast("long").alias("seed"),
    )
