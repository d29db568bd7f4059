"""Survey-shaped inputs derived from the driver's tables.

Questions are order years, populations are nations, options are order priorities, and models
are market segments. One aggregation of the orders gives a small cube from which everything
else follows. The cube, the cells, the manifest and the unit metrics are written once each,
so that what follows is planned from files and not from their whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.prompts import CONDITIONS
from quorvia.operators.metrics import UNIT, condition_pivot, unit_metrics, with_references
from quorvia.operators.pairs import candidate_pairs, directed, directed_manifest
from quorvia.sources.stored import stored

MODELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
N_DIRECTED = 40


#: Directed units that are made ties.
TIES = "model_key = 'BUILDING' AND label_country LIKE '%8'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_key, question_id, country, region, option, n. The nations' 25 rows are broadcast."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("Y"), F.year("o_orderdate")).alias("question_id"), F.col("o_orderpriority").alias("option"))
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"), F.col("n_regionkey").alias("region")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("model_key")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return stored(joined.groupBy("model_key", "question_id", "country", "region", "option").agg(F.count("*").alias("n")), "cube")


def options_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("question_id").agg(F.array_sort(F.collect_set("option")).alias("options"))


def filled(counts: DataFrame, keys: list[str], options: DataFrame) -> DataFrame:
    """keys, options, n (array in option order, 0 where nothing was counted). counts: keys, option, n."""
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("option", "n"))).alias("m"))
    n = F.transform("options", lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0)).cast("double"))
    return maps.join(options, "question_id").select(*keys, "options", n.alias("n"))


def add(a, b, times: float = 1.0):
    return F.zip_with(a, b, lambda x, y: times * x + y)


def survey(counts: DataFrame) -> DataFrame:
    """question_id, country, options, p: the populations' distributions."""
    by = counts.groupBy("question_id", "country", "option").agg(F.sum("n").alias("n"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return filled(by, ["question_id", "country"], options_of(counts)).select("question_id", "country", "options", F.transform("n", lambda x: x / total("n")).alias("p"))


def manifest(cells: DataFrame, n_directed: int | None = N_DIRECTED) -> DataFrame:
    """The most divergent pairs in both directions; all pairs if no number is given."""
    return stored(directed(candidate_pairs(cells)) if n_directed is None else directed_manifest(cells, n_directed), "manifest")


def predictions(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """model_key, question_id, label_country, evidence_country, condition, options, p.

    Baseline: the segment's shares over all nations. The others add counts of the label's
    region, the label's nation, or three parts evidence and one part label, to one part baseline.
    """
    options = options_of(counts)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    base = filled(counts.groupBy("model_key", "question_id", "option").agg(F.sum("n").alias("n")), ["model_key", "question_id"], options)
    base = base.select("model_key", "question_id", "options", F.transform("n", lambda x: x / total("n")).alias("b"))
    nation = filled(counts.groupBy("model_key", "question_id", "country", "option").agg(F.sum("n").alias("n")), ["model_key", "question_id", "country"], options)
    region = filled(counts.groupBy("model_key", "question_id", "region", "option").agg(F.sum("n").alias("n")), ["model_key", "question_id", "region"], options)
    regions = counts.select("country", "region").distinct()
    of = lambda df, key, to, name: df.select("model_key", "question_id", F.col(key).alias(to), F.col("n").alias(name))
    units = pairs.select(*UNIT[1:]).join(regions.withColumnRenamed("country", "label_country"), "label_country").join(base, "question_id")
    units = units.join(of(nation, "country", "label_country", "nl"), ["model_key", "question_id", "label_country"], "left")
    units = units.join(of(nation, "country", "evidence_country", "ne"), ["model_key", "question_id", "evidence_country"], "left")
    units = units.join(of(region, "region", "region", "nr"), ["model_key", "question_id", "region"], "left")
    zero = F.transform("b", lambda x: F.lit(0.0))
    nl, ne, nr = (F.coalesce(c, zero) for c in ("nl", "ne", "nr"))
    made = {"baseline": F.col("b"), "country_label": add(nr, F.col("b")), "population_evidence": add(nl, F.col("b")), "conflict": add(add(ne, nl, 3.0), F.col("b"))}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), made[c].alias("w")) for c in CONDITIONS]))
    df = units.select(*UNIT, "options", rows.alias("r")).select(*UNIT, "options", "r.*")
    return df.select(*UNIT, "condition", "options", F.transform("w", lambda x: x / total("w")).alias("p"))


def metrics(spark: SparkSession, sf_dir: str, n_directed: int | None = N_DIRECTED) -> DataFrame:
    """Unit metrics of all directed pairs whose references differ (equal ones are a violation elsewhere)."""
    counts = cube(spark, sf_dir)
    cells = survey(counts)
    return stored(unit_rows(predictions(counts, manifest(cells, n_directed)), cells), "unit-metrics")


def unit_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Unit metrics from predictions and the populations' distributions."""
    return unit_metrics(with_references(condition_pivot(rows), cells)).where("jsd_references > 0")


def domains(cells: DataFrame) -> DataFrame:
    return cells.select("question_id").distinct().withColumn("domain", F.when(F.substring("question_id", 2, 4).cast("int") < 1998, "GAS").otherwise("WVS"))


def raw_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A survey export with the faults that cleaning looks for: questions and samples.

    Questions are groups of customers, samples are nations with sample labels, options are
    order priorities with odd texts, and values are order totals.
    """
    key = F.pmod("o_custkey", F.lit(60))
    # among the ids are some that are set aside by hand
    number = F.when(key == 50, 311).when(key == 51, 550).otherwise(1 + 5 * key)
    option = (
        F.when(F.col("o_orderpriority").startswith("4"), "Don't know")
        .when(key == 7, "Only")
        .when((key == 8) & F.col("o_orderpriority").startswith("3"), "Low")
        .when(F.col("o_orderpriority").startswith("5") & (key % 17 == 0), "Total N=")
        .when(F.col("o_orderpriority").startswith("5"), "  Low ")
        .otherwise(F.substring("o_orderpriority", 3, 20))
    )
    country = F.concat(
        F.col("n_name"),
        F.when((key == 9) & (F.col("n_nationkey") > 0), " (Old national sample)").when(F.col("n_nationkey") % 7 == 1, " (Non-national sample)").when(F.col("n_nationkey") % 7 == 2, " (Old national sample)").when(F.col("n_nationkey") % 7 == 3, " (Current national sample)").otherwise(""),
    )
    # few nations, so that a question's samples hold several orders each
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    df = table(spark, sf_dir, "orders").withColumn("n_nationkey", F.pmod("o_orderkey", F.lit(9)).cast("int")).join(nations, "n_nationkey")
    df = df.groupBy(F.format_string("Q%04d", number.cast("int")).alias("question_id"), country.alias("country"), F.col("n_nationkey").alias("place"), option.alias("option")).agg(F.count("*").cast("double").alias("value"))
    # a question in eleven keeps its gaps, which is a fault; one nation there never says the first option
    gaps = F.substring("question_id", 2, 4).cast("int") % 11 == 0
    df = df.where(~(gaps & (F.col("place") == 4) & (F.col("option") == "URGENT")))
    # one nation mostly doesn't know
    df = df.withColumn("value", F.col("value") * F.when((F.col("place") == 5) & (F.col("option") == "Don't know"), 6).otherwise(1))
    questions = df.groupBy("question_id").agg(F.array_sort(F.collect_set("option")).alias("options")).withColumns({"domain": F.lit("GAS"), "question": F.concat(F.lit("Question "), "question_id")})
    entries = F.map_from_entries(F.collect_list(F.struct("option", "value")))
    samples = df.groupBy("question_id", "country", "place").agg(entries.alias("m")).join(questions.select("question_id", "options"), "question_id")
    # where gaps aren't kept, they are zeros
    full = F.map_from_arrays(F.col("options"), F.transform("options", lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0.0))))
    held = F.when(gaps, F.col("m")).otherwise(full)
    # one nation gives an option twice, once with spaces: the later value counts
    twice = F.map_concat("d", F.create_map(F.lit(" HIGH "), 3 * F.try_element_at("d", F.lit("HIGH"))))
    samples = samples.select("question_id", "country", "place", held.alias("d"))
    return questions, samples.select("question_id", "country", "place", F.when((F.col("place") == 6) & F.map_contains_key("d", "HIGH"), twice).otherwise(F.col("d")).alias("distribution"))
