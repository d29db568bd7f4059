"""Connected components by contraction, over tables in the shared folder.

Defined results: edges with a null end, edges of an id to itself and repeated edges add
nothing; without other edges there are no rows. There are no texts, and columns besides ``a``
and ``b`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, root for every end of an edge; root is the component's smallest id. edges: a, b (longs, or binary).

    In each round every vertex goes to its first neighbour, or stays, in a fixed random order
    of ids; edges within a contracted vertex vanish. Stars take two rounds, and chains of any
    order shrink by a constant share a round. Nothing is collected but counts.
    """
    left = cut(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    label = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b").alias("order"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64("a").alias("order"), F.col("a").alias("to"))
        parent = cut(both.groupBy("a").agg(first.alias("near")).select("a", F.least(own, F.col("near"))["to"].alias("to")), f"{name}-parents")
        p, q = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        left = cut(left.join(p, "a").join(q, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges")
        if label is None:
            label = parent.toDF("id", "root")
        else:
            label = label.join(parent.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        label = cut(label, f"{name}-labels")
    if label is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    least = label.groupBy("root").agg(F.min("id").alias("least"))
    return label.join(least, "root").select("id", F.col("least").alias("root"))
