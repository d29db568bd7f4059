"""Periodic runs of words: an all-lag scan of word-id arrays.

A document's words become integers; the array is compared with itself at every lag up to
its length over the least exponent, and stretches of equality that are long enough are runs.
A stretch that a multiple of its period finds again is told apart by its place: both lags
give the same interval, the smaller one is the period. Documents of up to ``long_bytes`` are
scanned where they are read, without a shuffle; of longer ones every range of lags is a row
of its own, which Spark deals out, so one text is compared by many machines.

Defined results: a null or empty text has no words and no runs, and collapses to an empty
text; null ids are kept; repeated rows are scanned each; an empty table gives no rows;
columns besides the id and the text are ignored, whatever their names. A very long text is
dealt out in ranges of lags, but its words must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quorvia.llm.common import cut, named, record_batches

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Texts of more bytes are dealt out in ranges of lags.
LONG_BYTES = 1 << 16
#: Comparisons of words that one range makes, and the fewest lags that it holds.
UNIT, LEAST_LAGS = 1 << 26, 256

RUN = "array<struct<start:long,length:long,period:long>>"
_run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """What stands between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words as equal integers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, first: int, last: int, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of maximal repetitions at the lags from ``first`` to ``last``."""
    found = []
    for lag in range(first, last + 1):
        equal = ids[lag:] == ids[:-lag]
        need = max(least, exponent * lag) - lag
        if np.count_nonzero(equal) < need:
            continue
        at = np.flatnonzero(equal)
        breaks = np.flatnonzero(np.diff(at) != 1)
        starts = at[np.concatenate([[0], breaks + 1])]
        lengths = at[np.concatenate([breaks, [len(at) - 1]])] + 1 - starts
        for i in np.flatnonzero(lengths >= need):
            found.append((starts[i], lengths[i] + lag, lag))
    return np.array(found, np.int64).reshape(-1, 3)


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """One row for each interval, that of its smallest period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words without those that a run repeats after its first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, d in zip(words, np.cumsum(depth[:-1]), strict=True) if not d]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def run_list(runs: np.ndarray) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, long_bytes: int = LONG_BYTES, unit: int = UNIT, least_lags: int = LEAST_LAGS
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    min_exponent: periods that a run must hold, a whole number of at least 2. min_length:
    words that it must hold.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    source = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    id_field = source.schema["doc_id"]
    schema = StructType([StructField("doc_id", id_field.dataType), *StructType.fromDDL(f"n_words long, runs {RUN}, collapsed string").fields])
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes

    def rows(ids: pa.Array, texts: list, found: list[np.ndarray]) -> pa.RecordBatch:
        every = [words_of(t) for t in texts]
        made = [pa.array([len(w) for w in every], pa.int64()), pa.array([run_list(r) for r in found], _run), pa.array([collapsed(w, r) for w, r in zip(every, found, strict=True)], pa.string())]
        return pa.RecordBatch.from_arrays([ids, *made], schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            texts = batch.column("text").to_pylist()
            found = []
            for text in texts:
                ids = word_ids(words_of(text))
                found.append(smallest_periods(stretches(ids, 1, len(ids) // min_exponent, min_exponent, min_length)))
            yield rows(batch.column("doc_id"), texts, found)

    short = source.where(~is_long).mapInArrow(scan, schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in record_batches(batches):
            ids = [word_ids(words_of(t)) for t in batch.column("text").to_pylist()]
            made = [pa.array(range(row, row + len(ids)), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["doc_id", "text", "row", "n", "ids"])

    numbered = StructType([id_field, *StructType.fromDDL("text string, row long, n long, ids binary").fields])
    # written once, so that a task that runs again finds the same row numbers
    held = cut(source.where(is_long).mapInArrow(number, numbered), "long-texts")
    lags = F.floor(F.col("n") / min_exponent)
    step = F.greatest(F.lit(least_lags), F.floor(F.lit(unit) / F.greatest("n", F.lit(1))))
    n_ranges = held.agg(F.sum(F.ceil(lags / step)).alias("n")).first().n
    if n_ranges is None:
        return short
    parts = max(1, min(n_ranges, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_ranges // 64)))
    ranges = held.where(lags > 0).select("row", "ids", F.explode(F.sequence(F.lit(1).cast("long"), lags, step)).alias("first"), lags.alias("lags"), step.alias("step"))
    ranges = ranges.select("row", "ids", "first", F.least(F.col("first") + F.col("step") - 1, "lags").alias("last")).repartition(parts, "row", "first")

    def scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, text="ids"):
            out = [
                run_list(smallest_periods(stretches(np.frombuffer(ids, np.int32), first, last, min_exponent, min_length)))
                for ids, first, last in zip(*(batch.column(c).to_pylist() for c in ("ids", "first", "last")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _run)], ["row", "found"])

    # repetitions of one text are fewer than its words, so a group is no larger than its row
    by_row = ranges.mapInArrow(scan_range, f"row long, found {RUN}").where(F.size("found") > 0).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"))
    joined = held.select("doc_id", "text", "row").join(by_row, "row", "left").select("doc_id", "text", F.transform(F.coalesce("found", F.array().cast(RUN)), lambda r: F.array(r.start, r.length, r.period)).alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            found = [smallest_periods(np.array(x, np.int64).reshape(-1, 3)) for x in batch.column("found").to_pylist()]
            yield rows(batch.column("doc_id"), batch.column("text").to_pylist(), found)

    return short.unionByName(joined.mapInArrow(finish, schema))
