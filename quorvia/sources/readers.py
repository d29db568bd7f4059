"""Sources: JSON documents, strict JSON lines, manifests, tables, file listings, settings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.functions.text import canonical_condition, directed_unit_id, strip
from quorvia.functions.variants import is_text, kind, value_text
from quorvia.sources.schemas import DATASET, MANIFEST, PREDICTION, TYPED_PREDICTION
from quorvia.sources.stored import stored


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON document per file (gzip by suffix), parsed by a given type; one row ``value`` each.

    Text that is no such document is an error at run time, as is an empty one.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))
    return parsed.select(F.coalesce("value", F.raise_error(F.lit("not a document of the given type"))).alias("value"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines (gzip by suffix). strict: blank lines and rows that are no objects are errors;
    Spark's own reader, used otherwise, skips the first and gives nulls for the second."""
    if not strict:
        return spark.read.schema(schema).json(path)
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths)
    text = strip("value")
    fault = F.when(F.length(text) == 0, "blank line").when(~text.startswith("{"), "not an object")
    parsed = F.from_json(text, f"STRUCT<{colons(schema)}>", {"mode": "FAILFAST"})
    row = F.when(fault.isNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("bad JSON line: "), fault)))
    return lines.select(row.alias("row")).select("row.*")


def colons(schema: str) -> str:
    """A column list as the fields of a struct type."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).simpleString()[len("struct<") : -1]


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (of the line in its file, from 1), line, fault of every line that is no JSON object.

    Lines are numbered within the split they are read from, and splits follow each other by
    their lines' count, so a large file is numbered by many tasks.
    """
    split = ["file", "split"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("order"), F.col("value").alias("line"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = lines.groupBy(*split).agg(F.count("*").alias("n")).select(*split, before.alias("before"))
    numbered = lines.withColumn("number", F.row_number().over(Window.partitionBy(*split).orderBy("order")))
    text = strip("line")
    parsed = F.try_parse_json(text)
    fault = F.when(F.length(text) == 0, "blank line").when(parsed.isNull(), "no JSON").when(~text.startswith("{"), "not an object")
    faulty = numbered.withColumn("fault", fault).where("fault IS NOT NULL").join(sizes, split)
    return faulty.select("file", (F.col("number") + F.col("before")).alias("number"), "line", "fault")


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(strip("value") != "").count()


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A survey keyed by question id: questions, and samples in long form with their place.

    Options are texts; ``numeric_options`` says whether some weren't written as such.
    """
    entries = read_json(spark, path, DATASET).select(F.explode("value").alias("key", "q"))
    typed = F.col("q.options")
    questions = entries.select(
        F.col("key").alias("question_id"), "q.domain", "q.question", F.transform(typed, value_text).alias("options"), "q.country_display_names",
        F.coalesce(F.exists(typed, lambda o: ~is_text(o)), F.lit(False)).alias("numeric_options"),
    )
    samples = entries.select(F.col("key").alias("question_id"), F.posexplode(F.map_entries("q.countries")).alias("place", "c"))
    return questions, samples.select("question_id", F.col("c.key").alias("country"), "place", F.col("c.value.distribution").alias("distribution"), F.col("c.value.sample_status").alias("sample_status"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Directed pairs with label_country and evidence_country; a missing unit id is made."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True)
    df = df.withColumnsRenamed({"country": "label_country", "conflict_country": "evidence_country"})
    return df.withColumn("unit_id", F.coalesce("unit_id", directed_unit_id("question_id", "label_country", "evidence_country")))


def read_predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Harmonised predictions of one or several models; conditions by their canonical names."""
    typed = read_jsonl(spark, paths, TYPED_PREDICTION).withColumn("condition", canonical_condition("condition"))
    return typed.withColumn("quantization", F.when(F.col("quantization").isNotNull() & (kind("quantization") != "VOID"), value_text("quantization")))


def read_model_results(spark: SparkSession, paths: Mapping[str, str], *, rows_per_model: int | Mapping[str, int], names: Mapping[str, str] | None = None, domains: DataFrame | None = None) -> DataFrame:
    """The full result rows of several models as one table, in the shared layout with typed variants.

    paths: a file or folder of JSON lines for each model key. Each line is parsed as a VARIANT,
    so files may differ in the types of their fields: numbers written as texts are read as
    numbers, options of any type become texts, and ``quantization`` stays as written. Fields a
    model didn't write are null. A line that is no object, and a model with another number of
    rows than asked for, are errors. names: display names by key; domains: question_id, domain.
    """
    lines = None
    for key in paths:  # as many as models are named
        one = spark.read.text(paths[key]).select(F.lit(key).alias("model_key"), F.col("value").alias("line"))
        lines = one if lines is None else lines.unionAll(one)
    if lines is None:
        raise ValueError("no model is named")
    parsed = F.try_parse_json("line")
    row = F.when(kind(parsed).startswith("OBJECT"), parsed).otherwise(F.raise_error(F.concat(F.lit("bad result row of "), "model_key")))
    rows = stored(lines.select("model_key", row.alias("v")), "model-results")
    found = {r["model_key"]: r["count"] for r in rows.groupBy("model_key").count().collect()}
    wanted = dict.fromkeys(paths, rows_per_model) if isinstance(rows_per_model, int) else dict(rows_per_model)
    wrong = {k: found.get(k, 0) for k in paths if found.get(k, 0) != wanted[k]}
    if wrong:
        raise ValueError(f"incomplete model output: found {wrong} rows, {wanted} are asked for")
    from pyspark.sql.types import VariantType, _parse_datatype_string

    def field(name: str, dtype) -> Column:
        if isinstance(dtype, VariantType):
            return F.try_variant_get("v", f"$.{name}", "variant")
        if name.endswith(("options", "option_order")):
            return F.transform(F.try_variant_get("v", f"$.{name}", "array<variant>"), value_text)
        return F.variant_get("v", f"$.{name}", dtype.simpleString())

    own = {"model_key": F.col("model_key"), "condition": canonical_condition(F.variant_get("v", "$.condition", "string"))}
    if names is not None:
        own["model_name"] = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("model_key"))
    made = rows.select(*[own.get(f.name, field(f.name, f.dataType)).alias(f.name) for f in _parse_datatype_string(TYPED_PREDICTION)])
    if domains is None:
        return made
    return made.drop("domain").join(domains.select("question_id", "domain"), "question_id", "left").select(*made.columns)


def harmonized(raw: DataFrame, model_key: str, display_name: str, domains: DataFrame) -> DataFrame:
    """Raw result rows of one model in the shared layout: its key and name, the questions'
    domains, canonical conditions; fields that a run didn't write are null."""
    from pyspark.sql.types import _parse_datatype_string

    layout = _parse_datatype_string(PREDICTION)
    given = {"model_key": F.lit(model_key), "model_name": F.lit(display_name), "condition": canonical_condition("condition")}
    df = raw.drop("domain").join(domains.select("question_id", "domain"), "question_id", "left")
    own = set(df.columns)
    return df.select(*[(given.get(f.name, F.col(f.name)) if f.name in given or f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A CSV table with a header; a bad row is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def read_results(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The rows of a result document ``{metadata, results}``, by a given struct type."""
    return read_json(spark, path, f"STRUCT<results: ARRAY<{row}>>").select(F.explode("value.results").alias("r")).select("r.*")


def lacking_fields(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Rows of a result document in which a field is absent, which is not the same as null."""
    rows = read_json(spark, path, "STRUCT<results: ARRAY<STRING>>").select(F.posexplode("value.results").alias("place", "row"))
    absent = F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys("row"))
    return rows.select("place", absent.alias("absent")).where(F.size("absent") > 0)


def list_files(spark: SparkSession, path: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """path, length, content below a folder, by name pattern; exclude: a regular expression on the path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    df = df.select("path", "length", "content")
    return df if exclude is None else df.where(~F.col("path").rlike(exclude))


def load_settings(path: str) -> dict:
    """Run settings from JSON, or YAML where that library is there; options aren't shuffled unless asked."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be an object")
    return {"shuffle_options": False} | found


def select_models(models: DataFrame, names: Sequence[str]) -> DataFrame:
    """Model rows by name in the given order; an unknown name is an error."""
    spark = models.sparkSession
    wanted = spark.createDataFrame(list(enumerate(names)), "position int, name string")
    found = wanted.join(models, "name", "left_anti").collect()  # as many as names are given
    if found:
        raise ValueError(f"unknown models: {[r['name'] for r in found]}")
    return models.join(F.broadcast(wanted), "name").orderBy("position")


def runtime_records(spark: SparkSession, paths: Mapping[str, str], schema: str) -> DataFrame:
    """model, runtime: one record for each model, from documents ``{"runtime": {...}}``; a missing one is an error."""
    found = None
    for model, path in sorted(paths.items()):
        one = read_json(spark, path, f"STRUCT<runtime: {schema}>").select(F.lit(model).alias("model"), F.coalesce("value.runtime", F.raise_error(F.lit(f"malformed runtime record: {path}"))).alias("runtime"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no model is named")
    return found


def file_identity(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, status (present or missing), sha256, bytes of each path asked for."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    asked = spark.createDataFrame([(p, p in there) for p in paths], "path string, there boolean")
    status = F.when(F.col("there"), "present").otherwise("missing").alias("status")
    if not there:
        return asked.select("path", status, F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("bytes"))
    # one load of them all; Spark names files by their whole URI
    held = spark.read.format("binaryFile").load(there).select(F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"), F.col("length").cast("long").alias("bytes"))
    whole = spark.createDataFrame([(p, jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(p)).toString()) for p in there], "path string, uri string")
    held = held.dropDuplicates(["uri"]).join(F.broadcast(whole), "uri").drop("uri")  # as many as are asked for
    return asked.join(held, "path", "left").select("path", status, "sha256", "bytes")
