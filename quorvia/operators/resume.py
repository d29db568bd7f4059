"""Resumable runs: what is pending, what is unexpected, how far a run is."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys: signs a run's settings."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def pending_units(manifest: DataFrame, finished: DataFrame, keys: Sequence[str] = ("unit_id",), signature: str | None = None) -> DataFrame:
    """Manifest rows without a finished row (of this run, if a signature is given)."""
    done = finished if signature is None else finished.where(F.col("run_fingerprint") == signature)
    return manifest.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unexpected_units(manifest: DataFrame, finished: DataFrame, keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    return finished.join(manifest.select(*keys).distinct(), list(keys), "left_anti")


def complete_units(rows: DataFrame, n_conditions: int = 4, keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Units of which every condition is there exactly once."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("condition").alias("d"))
    return n.where((F.col("n") == n_conditions) & (F.col("d") == n_conditions)).select(*keys)


def progress(manifest: DataFrame, finished: DataFrame, keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    """One row: expected, completed, pending, unexpected."""
    done = F.coalesce("d.done", F.lit(False))
    both = manifest.select(*keys).distinct().withColumn("wanted", F.lit(True)).alias("m").join(finished.select(*keys).distinct().withColumn("done", F.lit(True)).alias("d"), list(keys), "full")
    wanted = F.coalesce("m.wanted", F.lit(False))
    return both.agg(F.count_if(wanted).alias("expected"), F.count_if(wanted & done).alias("completed"), F.count_if(wanted & ~done).alias("pending"), F.count_if(~wanted).alias("unexpected"))


def progress_document(manifest: DataFrame, finished: DataFrame, before: DataFrame | None = None, keys: Sequence[str] = ("unit_id",), order: Sequence[str] = ("place",), error: str | None = None) -> dict:
    """How far a run is: expected, completed, resumed and new units, the last finished one in
    manifest order, status and error. before: what was finished when the run started."""
    counts = progress(manifest, finished, keys).first().asDict()
    done = manifest.join(finished.select(*keys).distinct(), list(keys), "left_semi")
    resumed = 0 if before is None else manifest.join(before.select(*keys).distinct(), list(keys), "left_semi").count()
    last = done.orderBy(*[F.col(c).desc() for c in order]).select(*keys).first()
    status = "failed" if error else "complete" if not counts["pending"] and not counts["unexpected"] else "running"
    return {
        "expected_units": counts["expected"], "completed_units": counts["completed"], "unexpected_units": counts["unexpected"],
        "resumed_units": resumed, "new_units": counts["completed"] - resumed, "last_key": list(last) if last else None, "status": status, "error": error,
    }


def permutation_digest(prompts: DataFrame, order: str = "place") -> str:
    """SHA-256 over the displayed options of all directed pairs, in manifest order.

    prompts: place, question_id, label_country, evidence_country, target_unit_id, displayed. Rows stream through the driver.
    """
    held = hashlib.sha256(b"[")
    names = ["question_id", "label_country", "evidence_country"]
    for i, r in enumerate(prompts.select(order, *names, "target_unit_id", "displayed").distinct().orderBy(order, *names).toLocalIterator()):
        one = {"directed_key": [r[n] for n in names], "permutation_key": r["target_unit_id"], "displayed_options": list(r["displayed"])}
        held.update((b"," if i else b"") + json.dumps(one, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode())
    held.update(b"]")
    return held.hexdigest()


def finished_prefix(rows: DataFrame, manifest: DataFrame, conditions: Sequence[str], keys: Sequence[str] = ("unit_id",), signature: str | None = None) -> DataFrame:
    """The keys of the manifest's units, from the first on, that are complete without a gap."""
    own = rows if signature is None else rows.where(F.col("run_fingerprint") == signature)
    done = complete_units(own.where(F.col("condition").isin(*conditions)), len(conditions), keys)
    gap = manifest.join(done, list(keys), "left_anti").agg(F.min("place").alias("gap"))
    return manifest.crossJoin(gap).where("gap IS NULL OR place < gap").select(*keys)  # one row on the right


def order_rules(rows: DataFrame, manifest: DataFrame, conditions: Sequence[str], keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Violations (rule, key) of complete results: each key and condition at its place.

    rows: place (from 0), keys, condition; manifest: place (from 0), keys. A unit's rows follow
    each other in the order of the conditions, and units that of the manifest.
    """
    wanted = manifest.select(*keys, (F.col("place") * len(conditions)).alias("first"))
    wanted = wanted.select(*keys, F.posexplode(F.array(*map(F.lit, conditions))).alias("step", "condition"), "first")
    wanted = wanted.select(*keys, "condition", (F.col("first") + F.col("step")).alias("expected"))
    found = rows.select(*keys, "condition", "place").join(wanted, [*keys, "condition"], "full")
    rule = F.when(F.col("place").isNull(), "missing row").when(F.col("expected").isNull(), "unexpected row").when(F.col("place") != F.col("expected"), "row out of order")
    return found.select(rule.alias("rule"), F.concat_ws("|", *keys, "condition").alias("key")).where("rule IS NOT NULL")


def pair_limit(manifest: DataFrame, limit: int, order: str = "place") -> DataFrame:
    """The first ``limit`` directed pairs in manifest order; fewer are an error."""
    if limit <= 0:
        raise ValueError("the number of pairs must be above 0")
    found = manifest.orderBy(order).limit(limit)
    if (n := found.count()) != limit:
        raise ValueError(f"{limit} pairs were asked for, {n} are there")
    return found
