"""Reports and sinks: batch summaries, compliance, CSV, JSON and SARIF rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import shown

# What must not occur for a framework to pass, and severity bounds.
FRAMEWORKS = {
    "PCI-DSS": ["Credit Card Numbers", "Primary Account Numbers"],
    "HIPAA": ["Medical Identifiers"],
    "SOC2": ["Generic Secrets", "Cloud Provider Secrets", "Code Platform Secrets"],
    "GDPR": ["Contact Information", "Personal Identifiers"],
}
HIGH, MEDIUM = 0.75, 0.40
# End of fixed values.


def severity(confidence: str = "confidence"):
    return F.when(F.col(confidence) >= HIGH, "high").when(F.col(confidence) >= MEDIUM, "medium").otherwise("low")


def compliance(findings: DataFrame) -> DataFrame:
    """framework, passed: whether none of its categories occurs. Findings shrink to their categories first."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(f, c) for f, cs in FRAMEWORKS.items() for c in cs], "framework string, category string")
    seen = findings.select("category").distinct().withColumn("hit", F.lit(True))
    return rules.join(seen, "category", "left").groupBy("framework").agg(F.every(F.col("hit").isNull()).alias("passed"))


def by_category(findings: DataFrame) -> DataFrame:
    """category, sub_category (null: all of it), findings, average_confidence, sample (redacted, of the earliest)."""
    rows = findings.rollup("category", "sub_category").agg(F.count("*").alias("findings"), F.round(F.avg("confidence"), 4).alias("average_confidence"), F.min_by(shown(F.col("matched")), F.struct("doc_id", "span_start")).alias("sample"))
    return rows.where("category is not null")


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy(severity().alias("severity")).agg(F.count("*").alias("findings"))


def batch_summary(guarded: DataFrame) -> DataFrame:
    """One row: items, clean and flagged items, findings."""
    return guarded.agg(F.count("*").alias("total_items"), F.count_if("is_clean").alias("clean_items"), F.count_if(~F.col("is_clean")).alias("flagged_items"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("total_findings"))


def items_by_category(guarded: DataFrame) -> DataFrame:
    """category, items: how many items have a finding of it."""
    return guarded.select(F.explode("categories_found").alias("category")).groupBy("category").agg(F.count("*").alias("items"))


def csv_rows(files: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each finding, or one for a file without; matched text redacted."""
    cols = ["category", "sub_category", F.col("confidence"), "has_context", "span_start", "span_end"]
    return files.join(findings, key, "left").select(*files.columns, *cols, F.when(F.col("matched").isNotNull(), shown(F.col("matched"))).alias("matched"))


def sarif(findings: DataFrame, tool: str = "sluice", version: str = "1.0.0", uri: str = "doc_id") -> DataFrame:
    """One SARIF 2.1.0 result per row as JSON, without matched text; sarif_log() frames a report of them."""
    rule = F.regexp_replace(F.concat(F.lit(f"{tool}/"), F.col("category"), F.lit("/"), F.col("sub_category")), " ", "-")
    level = F.when(F.col("confidence") >= 0.5, "warning").otherwise("note")
    message = F.struct(F.concat(F.col("sub_category"), F.lit(" detected")).alias("text"))
    region = F.struct(F.col("span_start").alias("charOffset"), (F.col("span_end") - F.col("span_start")).alias("charLength"))
    place = F.struct(F.struct(F.struct(F.col(uri).cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(rule.alias("rule_id"), F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), message.alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif_log(results: list[str], rules: list[str], tool: str = "sluice", version: str = "1.0.0") -> str:
    """A report's frame around results that the caller has collected."""
    import json

    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": [{"id": r} for r in rules]}}, "results": [json.loads(r) for r in results]}]})


def json_rows(findings: DataFrame, key: str = "doc_id", redact: bool = True) -> DataFrame:
    """A JSON object per finding, values as reports show them unless ``redact`` is off."""
    value = shown(F.col("matched")) if redact else F.col("matched")
    return findings.select(F.to_json(F.struct(F.col(key).cast("string").alias("source"), "category", "sub_category", value.alias("text"), "span_start", "span_end", "has_context", "confidence")).alias("result"))


def compliance_report(findings: DataFrame, title: str = "Compliance report") -> dict:
    """A report's content: severities, frameworks and a line per sub-category, whose number the catalogue bounds."""
    lines = [r.asDict() for r in by_category(findings).where("sub_category is not null").orderBy("category", "sub_category").collect()]
    return {
        "title": title,
        "total_findings": sum(r["findings"] for r in lines),
        "severity": {r["severity"]: r["findings"] for r in severities(findings).collect()},
        "frameworks": {r["framework"]: r["passed"] for r in compliance(findings).orderBy("framework").collect()},
        "findings": lines,
    }


def rendered(report: dict, kind: str = "text") -> str:
    """The report as json, text or html."""
    import html
    import json

    if kind == "json":
        return json.dumps(report, indent=2)
    verdict = lambda ok: "PASS" if ok else "FAIL"
    heads = ("category", "sub_category", "findings", "average_confidence", "sample")
    if kind == "text":
        rows = [f"{report['title']}", f"Findings: {report['total_findings']}", *(f"  {k}: {n}" for k, n in report["severity"].items()), *(f"{k}: {verdict(ok)}" for k, ok in report["frameworks"].items())]
        return "\n".join([*rows, *("\t".join(str(r[h]) for h in heads) for r in report["findings"])])
    if kind != "html":
        raise ValueError(f"no report of kind {kind}")
    table = lambda top, rows: "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in top) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
    body = table(("severity", "findings"), report["severity"].items()) + table(("framework", "status"), [(k, verdict(ok)) for k, ok in report["frameworks"].items()]) + table(heads, [[r[h] for h in heads] for r in report["findings"]])
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(report['title'])}</title></head><body><h1>{html.escape(report['title'])}</h1>{body}</body></html>"
