"""Tables in the folder that driver and executors share: they cut long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where none is set, one is made in a run without other machines; on a cluster that is an
    error, since files of one machine can't be read by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder under {master}")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from the files.

    The files outlive lost executors. They are removed by ``freed``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema).parquet(path)


#: The tables of each application that are still there, in the order in which they were made.
_made: dict[str, list[str]] = {}


def tables(spark: SparkSession) -> list[str]:
    """The paths of this application's stored tables, the latest last."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def freed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove stored tables that nothing will read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _made[spark.sparkContext.applicationId].remove(path)
