"""Clustered bootstrap over any number of clusters: counts of draws in blocks of clusters.

How often each cluster is drawn is a multinomial count. It is split down a binary tree of
blocks: at every node a binomial with a seed of its own says how many of the draws fall to
the left, so any block's number of draws follows from the path to it alone. A task holds one
block's counts for some replicates, adds its partial sums over the blocks that it is given,
and hands on one sum for each series and replicate. No array of all clusters is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.operators.bootstrap import cluster_sums, spread
from quorvia.sources.stored import stored

#: Clusters of a block, on average, and replicates whose counts are held at once.
BLOCK, AT_ONCE = 1000, 1000


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(key)))


def draws_of_block(before: np.ndarray, block: int, replicates: int, chunk: int, seed: int) -> np.ndarray:
    """How many of all draws fall into a block, for each replicate of a chunk.

    before: clusters in the blocks before each, and at the end in all; as many draws are made.
    """
    n = np.full(replicates, before[-1], np.int64)
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        size = before[high] - before[low]
        share = (before[middle] - before[low]) / size if size else 0.0
        left = generator(seed, chunk, low, high).binomial(n, share)
        if block < middle:
            n, high = left, middle
        else:
            n, low = n - left, middle
    return n


def block_counts(before: np.ndarray, block: int, replicates: int, chunk: int, seed: int) -> np.ndarray:
    """How often each cluster of a block is drawn: a row for each replicate of a chunk."""
    size = int(before[block + 1] - before[block])
    n = draws_of_block(before, block, replicates, chunk, seed)
    row = np.repeat(np.arange(replicates), n)
    drawn = generator(seed, chunk, block, block + 1, 1).integers(0, size, size=len(row))
    return np.bincount(row * size + drawn, minlength=replicates * size).reshape(replicates, size)


def weight_counts(ids: list[str], first: int, replicates: int, seed: int) -> np.ndarray:
    """Counts of 0, 1 or 2 by a plain rule over the replicate and the cluster's name, which any engine can repeat."""
    own = np.array([int(hashlib.md5(i.encode()).hexdigest()[:8], 16) for i in ids], np.int64)
    x = (np.arange(first, first + replicates)[:, None] * 7919 + own[None, :] + seed) % 1000003
    return (x * x % 998244353) % 3


def replicate_sums(sums: DataFrame, *, replicates: int, seed: int = 42, draws: str = "tree", block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """model_key, metric, replicate, total, n: every series' drawn sums. sums: a written table of ``cluster_sums``."""
    spark = sums.sparkSession
    k = sums.select("question_id").distinct().count()
    n_blocks = max(1, -(-k // block))
    placed = sums.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)).cast("int"))
    # a number for each block, which is a thousandth of the clusters
    found = placed.select("block", "question_id").distinct().groupBy("block").count().collect()
    sizes = np.zeros(n_blocks, np.int64)
    for r in found:
        sizes[r["block"]] = r["count"]
    shared = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(sizes)]))
    parts = min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.select("block", "question_id", "model_key", "metric", F.col("total").cast("double").alias("total"), F.col("n").cast("double").alias("n")).repartition(parts, "block").sortWithinPartitions("block", "question_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = shared.value
        held: dict[tuple[str, str], np.ndarray] = {}

        def add(number: int, rows: pd.DataFrame) -> None:
            ids, place = np.unique(rows["question_id"].to_numpy(), return_inverse=True)
            of, series = pd.factorize(pd.MultiIndex.from_frame(rows[["model_key", "metric"]]))
            values = np.zeros((len(ids), 2 * len(series)))
            np.add.at(values, (place, of), rows["total"].to_numpy())
            np.add.at(values, (place, len(series) + of), rows["n"].to_numpy())
            for chunk, first in enumerate(range(0, replicates, at_once)):
                some = min(at_once, replicates - first)
                counts = block_counts(before, number, some, chunk, seed) if draws == "tree" else weight_counts(list(ids), first, some, seed)
                drawn = counts.astype(float) @ values
                for i, key in enumerate(series):
                    if key not in held:
                        held[key] = np.zeros((2, replicates))
                    held[key][0, first : first + some] += drawn[:, i]
                    held[key][1, first : first + some] += drawn[:, len(series) + i]

        waiting: list[pd.DataFrame] = []
        for batch in batches:
            for number, rows in batch.groupby("block", sort=True):
                if waiting and waiting[0]["block"].iloc[0] != number:
                    add(int(waiting[0]["block"].iloc[0]), pd.concat(waiting))
                    waiting = []
                waiting.append(rows)
        if waiting:
            add(int(waiting[0]["block"].iloc[0]), pd.concat(waiting))
        for (model, metric), (total, n) in held.items():
            for first in range(0, replicates, at_once):
                to = min(first + at_once, replicates)
                yield pd.DataFrame({"model_key": model, "metric": metric, "replicate": np.arange(first, to), "total": total[first:to], "n": n[first:to]})

    partial = dealt.mapInPandas(run, "model_key string, metric string, replicate long, total double, n double")
    return partial.groupBy("model_key", "metric", "replicate").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def block_bootstrap(long: DataFrame, *, replicates: int = 10_000, confidence: float = 0.95, seed: int = 42, draws: str = "tree", block: int = BLOCK) -> DataFrame:
    """The columns of ``bootstrap``. draws: tree (multinomial counts) or weights (a rule that other engines can repeat)."""
    if replicates < 1 or not 0 < confidence < 1 or draws not in ("tree", "weights"):
        raise ValueError("at least one replicate, a confidence between 0 and 1, and known draws are needed")
    sums = stored(cluster_sums(long), "cluster-sums")
    values = replicate_sums(sums, replicates=replicates, seed=seed, draws=draws, block=block).select("model_key", "metric", "replicate", F.try_divide("total", "n").alias("value"))
    return spread(sums, values, replicates=replicates, confidence=confidence, seed=seed)
