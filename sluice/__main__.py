"""Command line: python -m sluice PATH --out FOLDER [--format json|csv|sarif|parquet] ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sluice.catalog import Catalog
from sluice.operators.findings import ignore_rules
from sluice.operators.report import compliance_report, rendered
from sluice.sources.runner import KINDS, scan_files, write_report


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """1 if there are findings, else 0."""
    p = argparse.ArgumentParser(prog="sluice", description="Scan the files under a path for sensitive data.")
    p.add_argument("path")
    p.add_argument("--out", help="folder that the report is written to")
    p.add_argument("--format", choices=KINDS, default="json")
    p.add_argument("--preset", action="append", default=[], help="presets of categories; all if none is named")
    p.add_argument("--catalog", help="a catalogue file")
    p.add_argument("--ignore", help="an ignore file")
    p.add_argument("--extension", action="append", help="endings of files to take")
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--require-context", action="store_true")
    p.add_argument("--summary", choices=("text", "json", "html"), default="text")
    a = p.parse_args(args)
    catalog = Catalog.load(Path(a.catalog).read_text()) if a.catalog else Catalog.core()
    catalog = catalog.preset(*a.preset) if a.preset else catalog
    spark = spark or SparkSession.builder.appName("sluice").getOrCreate()
    found = scan_files(spark, a.path, catalog, ignore_rules(Path(a.ignore).read_text()) if a.ignore else None, a.extension, a.min_confidence, require_context=a.require_context).persist()
    if a.out:
        write_report(found, a.out, a.format)
    summary = compliance_report(found)
    print(rendered(summary, a.summary))
    found.unpersist()
    return int(summary["total_findings"] > 0)


if __name__ == "__main__":
    sys.exit(main())
