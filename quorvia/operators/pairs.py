"""Pairs of populations by divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.functions.distributions import js_divergence
from quorvia.functions.text import directed_unit_id

#: Decimals by which divergences are ranked, so that the order of summing decides nothing.
RANK_DECIMALS = 12


def candidate_pairs(cells: DataFrame) -> DataFrame:
    """Every pair a < b of a question's populations with its divergence. cells: question_id, country, p.

    The join is an equality on the question with a comparison on top; a question's pairs grow
    with the square of its populations, which the question asks for.
    """
    a = cells.select("question_id", F.col("country").alias("a"), F.col("p").alias("pa"))
    b = cells.select("question_id", F.col("country").alias("b"), F.col("p").alias("pb"))
    return a.join(b, "question_id").where("a < b").select("question_id", "a", "b", js_divergence("pa", "pb").alias("divergence"))


def top_pairs(pairs: DataFrame, per_question: int = 3, overall: int | None = None) -> DataFrame:
    """The most divergent pairs of each question, then of those the most divergent overall; ties by names."""
    value = F.round("divergence", RANK_DECIMALS)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(value.desc(), "a", "b"))
    found = pairs.withColumn("place", place).where(F.col("place") <= per_question)
    return found if overall is None else found.orderBy(value.desc(), "question_id", "a", "b").limit(overall)


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair: label population and evidence population."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("label_country"), F.col("b").alias("evidence_country")), F.struct(F.col("b").alias("label_country"), F.col("a").alias("evidence_country"))))
    df = pairs.select("question_id", ends.alias("end"), "divergence").select("question_id", "end.*", "divergence")
    return df.withColumn("unit_id", directed_unit_id("question_id", "label_country", "evidence_country"))


#: Populations of a question up to which making all pairs is the shorter way to the best.
FEW_POPULATIONS = 400


def directed_manifest(cells: DataFrame, n_directed: int, per_question: int = 3, few: int = FEW_POPULATIONS) -> DataFrame:
    """The manifest of ``n_directed`` directed pairs, an even number above 0.

    Both ways to the best pairs give the same rows; the one that bounds distances is taken
    where a question has more than ``few`` populations.
    """
    from quorvia.operators.farthest import farthest_pairs

    if n_directed <= 0 or n_directed % 2:
        raise ValueError("an even number of directed pairs above 0 is needed")
    most = cells.groupBy("question_id").count().agg(F.max("count").alias("n")).first().n or 0
    if most > few:
        return directed(farthest_pairs(cells, per_question, n_directed // 2))
    return directed(top_pairs(candidate_pairs(cells), per_question, n_directed // 2))


def missing_reciprocals(manifest: DataFrame) -> DataFrame:
    """Directed pairs whose other direction is not there."""
    other = manifest.select("question_id", F.col("evidence_country").alias("label_country"), F.col("label_country").alias("evidence_country"))
    return manifest.join(other, ["question_id", "label_country", "evidence_country"], "left_anti")
