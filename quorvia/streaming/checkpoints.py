"""Finished prediction rows as a stream: an extension, for runs that write while others read.

Files of finished rows are read as they appear; rows that repeat a key within the watermark
are dropped by Spark's own state, and batches go to a table by a batch id, so a batch that
is run again replaces its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("model_key", "question_id", "label_country", "evidence_country", "condition")


def finished_rows(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over JSON lines in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_of_each(rows: DataFrame, keys: Sequence[str] = KEY, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row per key; with an event time, keys are forgotten after the delay, which bounds the state."""
    if time_col is None:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def into_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet partitioned by batch; each batch overwrites its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
