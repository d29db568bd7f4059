"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words, neighbouring pairs and pairs with one
word between. Each coordinate has its own learning rate; the L1 term keeps most weights at
exactly zero, so the model is a short list that is broadcast. Only labelled rows, at most
``max_rows`` of them, are learned from; every whole text is scored.

Defined results: a null or empty text has no features and gets the model's base score; a
null id is scored, never learned from, and not held out; repeated rows are scored each; a
document with several labels counts as toxic if one of them says so; null labels are left
out; of rows that repeat a labelled id one is learned from; without any label to learn from
every score is 0; an empty table gives no rows; a text of any length is scored as a whole and
must fit into a task; the caller's columns, whatever their names, are not looked at except
the id and the text, and ``score`` replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quorvia.llm.common import WORD, fresh, mix, named, record_batches, word_hashes

BITS = 20
#: Bound of the labelled rows that are learned from, and how often each is seen.
MAX_ROWS = 12_000
EPOCHS = 12
#: Learning rate and its offset, L1 and L2 strength, and the weight of toxic rows, which are few.
ALPHA, BETA, L1, L2, TOXIC_WEIGHT = 3.0, 1.0, 10.0, 0.01, 3.0
#: A coordinate present in every text.
BIAS = 0

_hashes = word_hashes


def features(text: str | None) -> np.ndarray:
    """Hashed coordinates, from 1 on, repeated where words repeat."""
    words = _hashes.of(WORD.findall((text or "").lower()))
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    skips = words[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] + np.uint64(1)
    return (mix(np.concatenate([words, pairs, skips])) % np.uint64((1 << BITS) - 1)).astype(np.uint32) + np.uint32(1)


class Ftrl:
    """Per-coordinate FTRL-proximal state; weights follow from it lazily."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the checksum of the id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> dict[int, float]:
    """Weights by coordinate, without zeros. The sample is that with the smallest id hashes."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    sample = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = sample.withColumn("order", F.xxhash64("__id")).orderBy("order", "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__id").select("order", "__id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            found = [np.unique(features(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("__id"), batch.column("label"), pa.array(found, pa.binary())], ["order", "id", "label", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias = np.full(1, BIAS, np.uint32).tobytes()
        seen = [(y, np.frombuffer(bias + x, np.uint32)) for b in batches for y, x in zip(b.column("label").to_pylist(), b.column("found").to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(EPOCHS):
            for label, at in seen:
                model.learn(at, label)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(w[used], pa.float64())], ["coordinate", "weight"])

    key = rows.schema["__id"].dataType.simpleString()
    found = rows.mapInArrow(extract, f"order long, id {key}, label int, found binary")
    found = found.groupBy("order", "id").agg(F.min(F.struct("found", "label")).alias("one")).select("order", "id", "one.*")
    # one task learns, from max_rows rows at most
    found = found.repartition(1).sortWithinPartitions("order", "id")
    return {r.coordinate: r.weight for r in found.mapInArrow(learn, "coordinate int, weight double").collect()}


def score_documents(docs: DataFrame, weights: dict[int, float], *, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a score from 0 to 1. A feature counts once, however often it occurs."""
    dense = np.zeros(1 << BITS)
    dense[list(weights)] = list(weights.values())
    sparse = docs.sparkSession.sparkContext.broadcast({"at": np.flatnonzero(dense).astype(np.uint32), "w": dense[np.flatnonzero(dense)]})
    others = [c for c in keep or docs.columns if c != score_col]
    # names by place: a name with a dot can't go through Arrow
    source = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).cast("string").alias("text"))
    schema = StructType([*source.schema.fields[:-1], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sparse.value["at"]] = sparse.value["w"]
        used = w != 0
        for batch in record_batches(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                at = features(text)
                total = w[BIAS] + w[np.unique(at[used[at]])].sum()
                scores.append(1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(sparse.value["w"]) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema.names)

    return source.mapInArrow(run, schema).toDF(*others, score_col)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score and predicted (score of at least one half) for every document."""
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = score_documents(docs, weights, text_col=text_col, keep=[id_col])
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those scored at one half or more."""
    (own,) = fresh(docs, "score")
    scored = score_documents(docs, fit(docs, labels, **options), score_col=own)
    return scored.where(F.col(own) < 0.5).select(*map(named, docs.columns))
