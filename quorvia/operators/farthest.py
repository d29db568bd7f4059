"""The most divergent pairs of populations, exactly, without making every pair.

The Jensen-Shannon divergence is a sum over options of a function that is convex in either
share. Populations whose shares are at least ``low`` lie within the corners that put the rest
of the mass on one option, so the divergence from any of them is at most that from a corner.

A question's pivots are, for each option, the population with the largest share of it, and then
those farthest from these. Divergences from pivots give a value that the best pairs reach at
least. Populations, then blocks of populations with like shares, then pairs whose bound stays
below it are left out; blocks are halved as long as many pairs are left, and a block meets only
the parts of what it met before. Of equal distributions the first names are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.functions.distributions import js_divergence, normalized, total
from quorvia.operators.pairs import top_pairs
from quorvia.sources.stored import stored

#: What rounding can take from a divergence, in sums and in the ranking.
MARGIN = 1e-9
#: Blocks to a share of 1, halved each time; pairs below which they are not halved again; the members that a part of a block holds.
SCALES, FEW, PART = (4, 8, 16, 32), 4_000_000, 500


def dealt(df: DataFrame) -> DataFrame:
    """Few rows with much to compute, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shares(df: DataFrame) -> list[Column]:
    """The share of each option, for as many as a question has at most."""
    n = df.agg(F.max(F.size("p")).alias("n")).first().n or 1
    return [F.get("p", F.lit(i)) for i in range(n)]


def least_shares(options: list[Column]) -> tuple[Column, Column]:
    """Aggregates low, the least share of each option, and spare, the mass above them."""
    low = F.array_compact(F.array(*[F.min(x) for x in options]))
    return low.alias("low"), F.greatest(1.0 - total(low), F.lit(0.0)).alias("spare")


def weighed(x: Column) -> Column:
    return F.coalesce(x * F.log2(x), F.lit(0.0))  # log2(0) is null


def gain(more: Column):
    """What mass put on an option of the first array adds."""
    return lambda x, y: 0.5 * (weighed(x + more) - weighed(x) + more - weighed(x + y + more) + weighed(x + y))


def at_most(a: Column | str, b: Column | str, spare_a: Column | None = None, spare_b: Column | None = None) -> Column:
    """A bound on the divergence of two arrays, either of a population or, with spare mass, of least shares.

    Without spare mass it is the divergence, but for rounding. Where both put theirs on one
    option it is no less than that corner's, since the function is submodular.
    """
    out = total(F.zip_with(a, b, lambda x, y: 0.5 * (weighed(x) + weighed(y) + x + y - weighed(x + y))))
    for one, other, more in ((a, b, spare_a), (b, a, spare_b)):
        if more is not None:
            out = out + F.array_max(F.zip_with(one, other, gain(more)))
    return out


def reaches(bound: Column) -> Column:
    """Whether a bound reaches the row's value; true where there is none."""
    return F.coalesce(bound >= F.col("least"), F.lit(True))


def points(df: DataFrame, by: list[Column]) -> DataFrame:
    """question_id, names and points: the populations that are largest by each column."""
    best = [F.max_by(F.struct("country", "p"), F.struct(value, F.col("country"))) for value in by]
    found = df.groupBy("question_id").agg(F.array_sort(F.array_distinct(F.array(*best))).alias("found"))
    return found.select("question_id", F.col("found.country").alias("names"), F.col("found.p").alias("points"))


def measured(df: DataFrame, pivots: DataFrame) -> DataFrame:
    """The rows with r, the divergences from the question's pivots, and best, the largest of a pair that no other row names."""
    own = F.array_position("names", F.col("country"))  # 0: no pivot itself; two pivots make one pair
    joined = df.join(pivots, "question_id").withColumn("r", F.transform("points", lambda q: at_most("p", q)))
    return joined.withColumn("best", F.array_max(F.filter("r", lambda _, i: (own == 0) | (own > i + 1)))).drop("names", "points")


def reached(held: DataFrame, per_question: int) -> DataFrame:
    """question_id, least: what the last of the best pairs reaches at least; no row for fewer pairs."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("best").desc()))
    best = held.where("best IS NOT NULL").select("question_id", "best", rank.alias("k")).where(F.col("k") <= per_question)
    found = best.groupBy("question_id").agg(F.count("*").alias("n"), F.min("best").alias("best"))
    return found.where(F.col("n") == per_question).select("question_id", (F.col("best") - MARGIN).alias("least"))


def distances(cells: DataFrame, copies: int | None = None) -> DataFrame:
    """question_id, country, p, r and best: the divergences from the question's pivots. Populations without mass have none and are left out.

    copies: of equal distributions, only so many are kept, by their names.
    """
    own = cells.select("question_id", "country", normalized("p").alias("p")).where("p IS NOT NULL")
    if copies is not None:
        rank = F.row_number().over(Window.partitionBy("question_id", "p").orderBy("country"))
        own = own.withColumn("k", rank).where(F.col("k") <= copies).drop("k")
    own = stored(own, "populations")
    return measured(own, stored(points(own, shares(own)), "pivots"))


def outer(cells: DataFrame, per_question: int) -> DataFrame:
    """question_id, country, p, least: the populations that one of the best pairs can have, and what these pairs reach."""
    # a pair with a name that is not among the first of its copies has enough pairs before it; within copies, one name more
    held = stored(distances(cells, per_question + 1), "distances")
    options = shares(held)
    ends = held.groupBy("question_id").agg(*least_shares(options)).join(reached(held, per_question), "question_id", "left")
    ends = stored(ends.withColumn("least", F.coalesce("least", F.lit(-1.0))), "ends")

    def kept(df: DataFrame, ends: DataFrame) -> DataFrame:
        near = df.select("question_id", "country", "p").join(ends, "question_id")
        return near.where(reaches(at_most("p", "low", spare_b=F.col("spare")))).select("question_id", "country", "p", "least")

    far = stored(points(held, [F.get("r", F.lit(i)) for i in range(len(options))]), "pivots")
    again = stored(measured(kept(held, ends).drop("least"), far), "distances")
    more = reached(again, per_question).withColumnRenamed("least", "more")
    ends = ends.join(more, "question_id", "left").withColumn("least", F.greatest("least", "more")).drop("more")
    return kept(again, stored(ends, "ends"))


def block(scale: int) -> Column:
    return F.array_join(F.transform("p", lambda x: F.floor(x * scale).cast("string")), "-")


def meetings(kept: DataFrame, scale: int, before: DataFrame | None, options: list[Column]) -> DataFrame:
    """The pairs of blocks at a scale, of those that met at half of it, whose bound reaches their question's value; with their least shares and sizes."""
    within = F.lit("") if before is None else block(scale // 2)
    blocks = kept.groupBy("question_id", within.alias("within"), block(scale).alias("block"))
    blocks = stored(blocks.agg(*least_shares(options), F.count("*").alias("size"), F.first("least").alias("least")), "blocks")
    one, other = (blocks.select("question_id", *[F.col(c).alias(f"{c}_{side}") for c in ("within", "block", "low", "spare", "size")], *rest) for side, rest in (("a", ["least"]), ("b", [])))
    if before is None:
        met = dealt(one).join(other, "question_id")
    else:
        halves = before.select("question_id", F.col("block_a").alias("within_a"), F.col("block_b").alias("within_b"))
        met = dealt(halves.join(one, ["question_id", "within_a"])).join(other, ["question_id", "within_b"])
    met = met.where((F.col("within_a") != F.col("within_b")) | (F.col("block_a") <= F.col("block_b")))
    met = met.where(reaches(at_most("low_a", "low_b", F.col("spare_a"), F.col("spare_b"))))
    return stored(met.drop("within_a", "within_b", "least"), "meetings")


def met_again(kept: DataFrame, met: DataFrame, scale: int) -> DataFrame:
    """The populations whose bound with a block that theirs meets reaches their question's value."""
    sides = [met.select(F.col("question_id").alias("q"), F.col(f"block_{a}").alias("of"), F.col(f"low_{b}").alias("low"), F.col(f"spare_{b}").alias("spare")) for a, b in ("ab", "ba")]
    same = (F.col("question_id") == F.col("q")) & (F.col("block") == F.col("of"))
    placed = dealt(kept.withColumn("block", block(scale)))
    return stored(placed.join(sides[0].union(sides[1]), same & reaches(at_most("p", "low", spare_b=F.col("spare"))), "left_semi").drop("block"), "kept-populations")


def bounded_pairs(cells: DataFrame, per_question: int = 3) -> DataFrame:
    """question_id, a, b, divergence of all pairs that can be among the best of their question, and few others."""
    kept = stored(outer(cells, per_question), "kept-populations")
    options, met = shares(kept), None
    for scale in SCALES:
        met = meetings(kept, scale, met, options)
        if (met.agg(F.sum(F.col("size_a") * F.col("size_b")).alias("pairs")).first().pairs or 0) <= FEW:
            break
        if scale < SCALES[-1]:
            kept = met_again(kept, met, scale)

    held, parts = kept.withColumn("block", block(scale)), F.ceil(F.col("size_b") / PART).cast("int")
    a = held.select("question_id", F.col("block").alias("block_a"), F.col("country").alias("name_a"), F.col("p").alias("pa"), "least")
    a = a.join(met.select("question_id", "block_a", "block_b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["question_id", "block_a"])
    b = held.withColumnRenamed("block", "block_b").join(met.select("question_id", "block_b", parts.alias("parts")).distinct(), ["question_id", "block_b"])
    part = F.pmod(F.xxhash64("country"), F.col("parts").cast("long")).cast("int")
    b = b.select("question_id", "block_b", part.alias("part"), F.col("country").alias("name_b"), F.col("p").alias("pb"))
    pairs = dealt(a).join(b, ["question_id", "block_b", "part"])
    pairs = pairs.where((F.col("block_a") != F.col("block_b")) | (F.col("name_a") < F.col("name_b"))).where(reaches(at_most("pa", "pb")))
    # in the order of names, as every pair is
    swap = F.col("name_a") > F.col("name_b")
    ordered = pairs.select(
        "question_id", F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"),
        F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("pa"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("pb"),
    )
    return ordered.select("question_id", "a", "b", js_divergence("pa", "pb").alias("divergence"))


def farthest_pairs(cells: DataFrame, per_question: int = 3, overall: int | None = None) -> DataFrame:
    """The rows of ``top_pairs`` over all pairs. cells: question_id, country (unique by question), p."""
    return top_pairs(bounded_pairs(cells, per_question), per_question, overall)
