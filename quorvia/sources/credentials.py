"""Credentials in files, found by ranges of bytes: no file is held as a whole.

Files are listed with their lengths, cut into ranges, and each range is read on its own with
some bytes around it, so a token that lies across an edge is seen whole; it counts where it
begins. Executors read through Arrow's file systems, which know local, HDFS and object stores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pattern of an access token, and how many bytes around a range are looked at.
TOKEN, OVERLAP = rb"hf_[A-Za-z0-9]{20,}", 128
#: Bytes of a range.
RANGE = 8 << 20


def file_lengths(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def byte_ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """path, start and end of every range of the files (path, length); empty files have none."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    df = files.where("length > 0").select("path", "length", starts.alias("start"))
    return df.select("path", "start", F.least(F.col("start") + size, "length").alias("end"))


def credential_places(files: DataFrame, token: bytes = TOKEN, *, size: int = RANGE, overlap: int = OVERLAP, parts: int | None = None) -> DataFrame:
    """path, place (of the first byte, from 0) and token of all that looks like a credential.

    token: a pattern over bytes that cannot begin inside one of its matches; of a match that
    is longer than the overlap the token given may be cut there. parts: tasks that share the
    ranges.
    """
    if size < 1 or overlap < 1:
        raise ValueError("ranges and their overlap must hold a byte at least")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        wanted = re.compile(token)
        for batch in batches:
            found = []
            for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
                system, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                first = max(0, start - overlap)
                with system.open_input_file(name) as f:
                    data = f.read_at(int(end + overlap - first), int(first))
                found += [(path, first + m.start(), m.group().decode("latin-1")) for m in wanted.finditer(data) if start <= first + m.start() < end]
            yield pd.DataFrame(found, columns=["path", "place", "token"]).astype({"place": "int64"})

    ranges = byte_ranges(files, size)
    # ranges are a few bytes each and would share a task
    n = parts or 4 * files.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(n, "path", "start").mapInPandas(scan, "path string, place long, token string")
