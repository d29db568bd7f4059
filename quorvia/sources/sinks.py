"""Sinks: tables, byte-stable files, hash manifests, reports, archives.

Large results are written by Spark. Files whose bytes matter, and reports, are small; they
stream through the driver in order.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import math
import os
import tempfile
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.functions.text import csv_cell, estimate_with_interval, fixed, latex_escape


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in gzip parts."""
    df.write.mode(mode).json(path, compression="gzip", ignoreNullFields=False)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def flat(df: DataFrame, leading: Sequence[str] = ()) -> DataFrame:
    """Every column as the text of a CSV cell: first the leading ones, then the others by name."""
    kinds = dict(df.dtypes)
    names = [*[c for c in leading if c in kinds], *sorted(c for c in kinds if c not in leading)]
    return df.select(*[csv_cell(c, kinds[c]).alias(c) for c in names])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = True) -> None:
    """A CSV table with a header; small ones in one file."""
    (df.coalesce(1) if one_file else df).write.mode(mode).csv(path, header=True)


def plain(value):
    """Rows, decimals and non-finite numbers as JSON takes them."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number that is not finite")
        return value
    return int(value) if type(value).__name__ == "Decimal" else value


def json_text(value, compact: bool = True) -> str:
    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, allow_nan=False, **({"separators": (",", ":")} if compact else {"indent": 2}))


def write_bytes_atomically(path: str | Path, data: bytes) -> None:
    """Whole or not at all: a neighbouring file takes the name when it is on disk."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_json_document(value, path: str | Path) -> None:
    write_bytes_atomically(path, (json_text(value, compact=False) + "\n").encode())


def write_stable_jsonl(df: DataFrame, path: str | Path, order: Sequence[str]) -> str:
    """One gzip file with the same bytes for the same rows; gives its SHA-256. Rows stream in order."""
    held = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=held, compresslevel=9, mtime=0) as f:
        for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            f.write((json_text(row) + "\n").encode())
    write_bytes_atomically(path, held.getvalue())
    return hashlib.sha256(held.getvalue()).hexdigest()


def file_hashes(files: DataFrame) -> DataFrame:
    """path, sha256, bytes of a file listing."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def hash_manifest(files: DataFrame) -> DataFrame:
    """Lines of digest, two spaces and path, by path."""
    return file_hashes(files).orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def verify_hashes(files: DataFrame, listed: DataFrame) -> DataFrame:
    """fault, path: files that lack, differ from their listed digest, or aren't listed.

    listed: lines (value) of a hash manifest, with the paths that ``files`` has.
    """
    parts = F.split("value", "  ", 2)
    wanted = listed.where("value <> ''").select(parts[1].alias("path"), parts[0].alias("wanted"))
    both = file_hashes(files).join(wanted, "path", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("sha256") != F.col("wanted"), "differs")
    return both.select(fault.alias("fault"), "path").where("fault IS NOT NULL")


def derived_faults(folder: str | Path, made: Mapping[str, bytes]) -> list[str]:
    """Stored files that are not byte for byte what was made again: names with what is wrong."""
    found = {name: Path(folder, name) for name in sorted(made)}
    return [f"{n}: {'missing' if not p.is_file() else 'differs'}" for n, p in found.items() if not p.is_file() or p.read_bytes() != made[n]]


def credential_hits(files: DataFrame, pattern: str = r"(?i)(?:api[_-]?key|secret|token)['\"]?\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----") -> DataFrame:
    """Paths of files that seem to hold credentials; bytes are looked at as Latin-1."""
    return files.where(F.decode("content", "ISO-8859-1").rlike(pattern)).select("path")


def markdown_table(df: DataFrame, header: Mapping[str, str] | None = None, decimals: int = 4) -> str:
    """A small table in its own order. header: titles by column."""
    names = df.columns
    kinds = dict(df.dtypes)
    cells = df.select(*[(fixed(c, decimals) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])
    title = [(header or {}).get(c, c) for c in names]
    lines = [title, [":--" if kinds[c] == "string" else "--:" for c in names], *[[str(r[c]).replace("|", "\\|") for c in names] for r in cells.collect()]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def latex_rows(df: DataFrame, columns: Sequence[str], decimals: int = 4) -> list[str]:
    """Rows of a TeX table: texts escaped, doubles with fixed decimals."""
    kinds = dict(df.dtypes)
    cells = [fixed(c, decimals) if kinds[c] == "double" else latex_escape(F.col(c).cast("string")) for c in columns]
    return [r["line"] + r" \\" for r in df.select(F.concat_ws(" & ", *cells).alias("line")).collect()]


def latex_estimates(main: DataFrame, metrics: Sequence[str]) -> list[str]:
    """A row per model with every metric's estimate and interval."""
    cells = [estimate_with_interval(m, f"{m}_ci_95_lower", f"{m}_ci_95_upper") for m in metrics]
    return [r["line"] + r" \\" for r in main.select(F.concat_ws(" & ", latex_escape("model_key"), *cells).alias("line")).collect()]


def results_report(title: str, sections: Sequence[tuple[str, DataFrame]]) -> str:
    """Markdown with a table for each section."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in sections)


def nested_document(tables: Mapping[str, DataFrame]) -> str:
    """Small tables as one JSON document: a list of objects each."""
    return json_text({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}, compact=False)


def analysis_manifest(predictions: DataFrame, targets: DataFrame, directed: DataFrame) -> dict:
    """Row counts, models and clusters of an analysis."""
    at = targets.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("model_key")).alias("models"), F.count_distinct("question_id").alias("clusters")).first()
    return {"prediction_rows": predictions.count(), "target_rows": at["n"], "directed_rows": directed.count(), "models": at["models"], "question_clusters": at["clusters"]}


def write_figure(main: DataFrame, metric: str, path: str | Path) -> None:
    """Estimates with their intervals, which need not be symmetrical (where matplotlib is there)."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    rows = main.select("model_key", metric, f"{metric}_ci_95_lower", f"{metric}_ci_95_upper").toPandas()
    figure, axes = plt.subplots()
    low, high = rows[metric] - rows[f"{metric}_ci_95_lower"], rows[f"{metric}_ci_95_upper"] - rows[metric]
    axes.errorbar(rows[metric], range(len(rows)), xerr=[low, high], fmt="o", capsize=3)
    axes.set_yticks(range(len(rows)), rows["model_key"])
    axes.set_xlabel(metric)
    figure.savefig(path, bbox_inches="tight", metadata={"Software": None} if str(path).endswith("png") else None)
    plt.close(figure)


def exclusion_report(summary: DataFrame) -> str:
    """Markdown: what was set aside and why, the most frequent reason first. summary: kind, reason, count."""
    order = summary.orderBy("kind", F.desc("count"), "reason")
    return results_report("Exclusions", [(kind, order.where(F.col("kind") == kind).select("reason", "count")) for kind in ("question", "sample")])


def csv_text(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    """A small table as CSV text with a header, in a given order of columns and rows."""
    kinds = dict(df.dtypes)
    held = io.StringIO()
    out = csv.writer(held, lineterminator="\n")
    out.writerow(columns)
    cells = df.orderBy(*order).select(*[csv_cell(c, kinds[c]).alias(c) for c in columns])
    out.writerows(tuple(row) for row in cells.toLocalIterator())
    return held.getvalue()


#: The files of a model's analysis.
ANALYSIS_FILES = (
    "analysis.json", "results.csv", "directed_unit_metrics.csv", "target_unit_metrics.csv", "bootstrap_summary.csv", "conflict_classifications.csv",
    "metric_tables.json", "tables/model_metrics.tex", "tables/conflict_classification.tex", "EXPERIMENT_REPORT.md",
)


def write_outputs(folder: str | Path, tables: Mapping[str, DataFrame], rows: DataFrame, metrics: Sequence[str], sources: Mapping[str, str] | None = None) -> list[Path]:
    """The files of an analysis, each written whole or not at all; gives their paths.

    tables: what the analysis made; rows: its predictions; sources: digests of input files by name.
    These are summaries and tables of units: rows stream through the driver in order.
    """
    unit = ["model_key", "question_id", "label_country", "evidence_country"]
    targets, directed, intervals, main, classes = (tables[k] for k in ("target_unit_metrics", "directed_unit_metrics", "bootstrap_metrics_long", "main_metrics", "conflict_classification"))
    small = {"bootstrap": intervals, "conflict_classification": classes, "main_metrics": main}
    counts = [c for c in classes.columns if c != "model_key"]
    made = {
        "analysis.json": json_text({"summary": analysis_manifest(rows, targets, directed), "sources": dict(sources or {}), **{k: [plain(r) for r in df.orderBy("model_key").collect()] for k, df in small.items()}}, compact=False) + "\n",
        "results.csv": csv_text(rows, [*unit, "condition", *sorted(set(rows.columns) - {*unit, "condition"})], [*unit, "condition"]),
        "directed_unit_metrics.csv": csv_text(directed, directed.columns, unit),
        "target_unit_metrics.csv": csv_text(targets, targets.columns, unit[:3]),
        "bootstrap_summary.csv": csv_text(intervals, intervals.columns, ["model_key", "metric"]),
        "conflict_classifications.csv": csv_text(directed, [*unit, "EO_raw", "EO_normalized", "classification"], unit),
        "metric_tables.json": nested_document({k: df.orderBy("model_key") for k, df in small.items()}) + "\n",
        "tables/model_metrics.tex": "\n".join(latex_estimates(main.orderBy("model_key"), metrics)) + "\n",
        "tables/conflict_classification.tex": "\n".join(latex_rows(classes.orderBy("model_key"), ["model_key", *counts], 1)) + "\n",
        "EXPERIMENT_REPORT.md": results_report("Experiment", [("Metrics", main.orderBy("model_key")), ("Conflict classes", classes.orderBy("model_key"))]) + "\n## Files\n\n" + "".join(f"- `{name}`\n" for name in ANALYSIS_FILES),
    }
    paths = [Path(folder) / name for name in ANALYSIS_FILES]
    for path, name in zip(paths, ANALYSIS_FILES, strict=True):
        write_bytes_atomically(path, made[name].encode())
    return paths


def build_archive(members: Mapping[str, bytes], path: str | Path) -> str:
    """A zip file with the same bytes for the same members; gives its SHA-256."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, members[name])
    write_bytes_atomically(path, held.getvalue())
    return hashlib.sha256(held.getvalue()).hexdigest()


def verify_archive(path: str | Path, expected: Mapping[str, str]) -> list[str]:
    """What is wrong with an archive: members that lack, differ in digest, or aren't expected."""
    with zipfile.ZipFile(path) as z:
        found = {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist()}
    names: Iterable[str] = sorted({*found, *expected})
    return [f"{n}: {'missing' if n not in found else 'unexpected' if n not in expected else 'differs'}" for n in names if found.get(n) != expected.get(n)]
