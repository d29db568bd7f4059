"""What a run has finished, from its checkpoint files: a state machine for each row of the manifest.

A checkpoint names its run, its place in the manifest and its row, and is pending or complete.
Files that don't fit are turned away with the first reason. For each row the state only moves
on, from nothing to pending to complete; of files alike in status the one with the smaller
digest counts. So files may come late, repeatedly and in any order: a stream of them and the
whole folder at once give the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming import StreamingQuery

#: A checkpoint file's fields; ``row`` is the result row's own text.
CHECKPOINT = "schema_version STRING, run_fingerprint STRING, manifest_index BIGINT, row_key ARRAY<STRING>, metrics_status STRING, row STRING"
#: The states of a row, in order.
PENDING, COMPLETE = "pending", "complete"
STATE = "key string, status string, digest string, row string"


def judged(checkpoints: DataFrame, manifest: DataFrame, *, schema_version: str, run_fingerprint: str) -> DataFrame:
    """Checkpoints with their ``key`` and ``fault`` (null: they count), status, digest and row.

    manifest: key (the row's parts joined by ``|``), place; it may be joined to a stream.
    """
    key = F.array_join("row_key", "|", "∅")
    df = checkpoints.withColumn("key", key).join(manifest.select(F.col("key"), F.col("place")), "key", "left")
    fault = (
        F.when(F.col("row_key").isNull(), "no object")
        .when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema")
        .when(~F.col("run_fingerprint").eqNullSafe(F.lit(run_fingerprint)), "run fingerprint")
        .when(F.col("place").isNull(), "row key")
        .when(~F.col("manifest_index").eqNullSafe(F.col("place")), "manifest order")
        .when(~F.coalesce(F.col("metrics_status").isin(PENDING, COMPLETE), F.lit(False)), "status")
        .when(F.col("row").isNull(), "no row")
    )
    return df.select("key", fault.alias("fault"), F.col("metrics_status").alias("status"), F.sha2(F.encode("row", "UTF-8"), 256).alias("digest"), "row")


def furthest(states: DataFrame) -> DataFrame:
    """One row for each key: the furthest status, and of those the smallest digest. Of updates, what they come to."""
    order = F.struct((F.col("status") != COMPLETE).alias("waits"), "digest")
    return states.groupBy("key").agg(F.min_by(F.struct("status", "digest", "row"), order).alias("s")).select("key", "s.*")


class Furthest(StatefulProcessor):
    """The same by state: a key's status and digest, given on whenever they move."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "status string, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        best, text = before, None
        for part in rows:
            for status, digest, row in zip(part["status"], part["digest"], part["row"], strict=True):
                if best is None or (status != COMPLETE, digest) < (best[0] != COMPLETE, best[1]):
                    best, text = (status, digest), row
        if best != before:
            self.held.update(best)
            yield pd.DataFrame({"key": [key[0]], "status": [best[0]], "digest": [best[1]], "row": [text]})

    def close(self) -> None:
        pass


def state_updates(sound: DataFrame) -> DataFrame:
    """A stream of sound checkpoints as a stream of state changes (``STATE``). Needs a state store that holds
    several values a key, RocksDB's."""
    return sound.select("key", "status", "digest", "row").groupBy("key").transformWithStateInPandas(Furthest(), outputStructType=STATE, outputMode="Update", timeMode="None")


def follow(spark: SparkSession, folder: str, manifest: DataFrame, table: str, checkpoint: str, *, schema_version: str, run_fingerprint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Read new checkpoint files of a folder and add their state changes to a Parquet table, each batch once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files = spark.readStream.schema(CHECKPOINT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    sound = judged(files, manifest, schema_version=schema_version, run_fingerprint=run_fingerprint).where("fault IS NULL")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return state_updates(sound).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
