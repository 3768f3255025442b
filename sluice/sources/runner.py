"""A run over files: read, extract, scan, ignore, filter, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import Catalog
from sluice.operators import report
from sluice.operators.findings import confident, ignoring, outside_paths, processed
from sluice.operators.scan import scan
from sluice.sources.readers import extracted, files

KINDS = ("json", "csv", "sarif", "parquet")


def scan_files(spark: SparkSession, path: str, catalog: Catalog | None = None, rules: Mapping[str, list[str]] | None = None, extensions: Iterable[str] | None = None, min_confidence: float = 0.0, steps: Iterable[Callable[[DataFrame], DataFrame]] = (), **options) -> DataFrame:
    """Findings in the files under a path, with ``path``, ``item`` (within an archive) and ``error`` of files that cannot be read.

    rules: an ignore file's (see ignore_rules); paths that they name are not
    read. extensions: endings of files to take, all if not given.
    """
    rules = rules or {}
    found = outside_paths(files(spark, path), rules.get("path", ()))
    if extensions is not None:
        ends = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
        found = found.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(ends))
    texts = extracted(found)
    key = F.concat_ws("!", "path", F.nullif("item", F.lit("")))
    rows = scan(texts.where("error is null").select(key.alias("doc_id"), "text"), catalog, **options)
    out = rows.withColumn("path", F.substring_index("doc_id", "!", 1)).withColumn("item", F.when(F.contains("doc_id", F.lit("!")), F.expr("substring(doc_id, locate('!', doc_id) + 1)")))
    return processed(ignoring(confident(out, min_confidence), rules, "path"), steps)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path, item, error of files that no extractor reads."""
    return extracted(files(spark, path)).where("error is not null").select("path", "item", "error")


def write_report(findings: DataFrame, path: str, kind: str = "json") -> None:
    """Findings as a table or as lines; values as reports show them."""
    if kind not in KINDS:
        raise ValueError(f"a report is one of {', '.join(KINDS)}")
    if kind == "parquet":
        findings.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        report.csv_rows(findings.select("doc_id").distinct(), findings).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows = report.json_rows(findings) if kind == "json" else report.sarif(findings).select("result")
        rows.write.mode("overwrite").text(path)
