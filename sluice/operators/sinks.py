"""Events for audit tables and monitoring systems, and the foreachBatch that delivers them."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = {"flag": "FLAG", "redact": "REDACT", "reject": "REJECT", "tokenize": "TOKENIZE", "obfuscate": "OBFUSCATE"}


def audit_events(guarded: DataFrame, action: str, user: str | None = None, key: str = "doc_id", at: Column | None = None) -> DataFrame:
    """One event per document of Guard.apply(): no text, no values."""
    at = at if at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return guarded.select(F.lit(EVENTS.get(action, "SCAN")).alias("event_type"), at.alias("timestamp"), F.lit(user).alias("user"), F.lit(action).alias("action"), "categories_found", "finding_count", "is_clean", F.col(key).cast("string").alias("source"))


def payloads(events: DataFrame, kind: str, source: str = "sluice") -> DataFrame:
    """A column ``payload``: the event as the receiver wants it (splunk, elastic, datadog, syslog, json)."""
    row = F.struct("*", F.lit(source).alias("origin"))
    body = F.to_json(row)
    if kind == "splunk":
        body = F.to_json(F.struct(row.alias("event"), F.lit(source).alias("source"), F.lit("_json").alias("sourcetype")))
    elif kind == "elastic":
        body = F.concat(F.lit('{"index":{}}\n'), body, F.lit("\n"))
    elif kind == "datadog":
        body = F.to_json(F.struct(F.lit(source).alias("ddsource"), F.to_json(row).alias("message")))
    elif kind == "syslog":
        body = F.concat(F.lit("<134>1 "), F.col("timestamp"), F.lit(f" - {source} - - - "), body)
    elif kind != "json":
        raise ValueError(f"no receiver named {kind}")
    return events.select(body.alias("payload"))


def post(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[Iterable[str]], None]:
    """A sender for deliver(): one request per partition's lines."""

    def send(lines: Iterable[str]) -> None:
        data = "\n".join(lines).encode()
        if data:
            urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout).close()

    return send


def deliver(send: Callable[[Iterable[str]], None], kind: str = "json") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch, or to be called with a batch: executors send their own rows."""

    def run(events: DataFrame, _: int) -> None:
        payloads(events, kind).foreachPartition(lambda rows: send(r["payload"] for r in rows))

    return run


def metrics(df: DataFrame, name: str = "scan") -> DataFrame:
    """df, observed: documents, findings and those too large, for a listener to pick up."""
    return df.observe(name, F.count("*").alias("documents"), F.sum(F.size("findings")).alias("findings"), F.count_if(F.col("status") == "too_large").alias("too_large"), F.count_if(F.col("status") == "truncated").alias("truncated"))

