"""Streams: chunked scanning across chunk borders, exposure windows, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.catalog import Catalog
from sluice.functions.text import glob
from sluice.operators.scan import matcher

#: Characters of a stream that are scanned again with the next chunk.
OVERLAP = 256
_OUT = "stream_id string, category string, sub_category string, matched string, span_start bigint, span_end bigint, has_context boolean, confidence double"


def scan_chunks(chunks: DataFrame, catalog: Catalog | None = None, overlap: int = OVERLAP, min_confidence: float = 0.0, quiet_ms: int | None = None) -> DataFrame:
    """Findings with places in the whole stream. chunks: stream_id, seq, chunk, as a stream.

    State of a stream_id: its last ``overlap`` characters, where they start, and
    the spans reported within them, so that a value cut by a chunk's border is
    found once. A null chunk is empty; equal spans are reported once. A value at
    the end of the last chunk waits for what may follow, until an empty chunk
    ends it or, if ``quiet_ms`` is given, no chunk has come for so many
    milliseconds (such a query runs batches without data, too, to see that).
    """
    chosen = catalog or Catalog.core()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, start, seen = state.get if state.exists else ("", 0, [])
        seen = {tuple(map(int, s.split(":"))) for s in seen}
        rows = []
        chunks = [None] if state.hasTimedOut else pd.concat(pdfs).sort_values("seq")["chunk"]
        for chunk in chunks:
            text = tail + (chunk or "")
            for category, name, value, s, e, near, _, score, _ in matcher(chosen).find(text):
                span = (start + s, start + e)
                if span not in seen and score >= min_confidence and not (e == len(text) and len(text) - s < overlap and chunk):
                    seen.add(span)
                    rows.append((key[0], category, name, value, *span, near, score))
            keep = min(overlap, len(text))
            start, tail = start + len(text) - keep, text[len(text) - keep :]
            seen = {x for x in seen if x[1] > start}
        state.update((tail, start, [f"{a}:{b}" for a, b in seen]))
        if quiet_ms is not None and not state.hasTimedOut:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, _OUT, "tail string, start bigint, seen array<string>", "append", GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def exposure(findings: DataFrame, policies: list[tuple[str, int, str]], window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Alerts of closed windows: findings (ts, user, category) beyond a policy's limit (category, most, user pattern)."""
    counts = findings.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), user, "category").agg(F.count("*").alias("count"))
    limit = F.lit(None).cast("int")
    for category, most, who in policies:
        limit = F.when((F.col("category") == category) & F.col(user).cast("string").rlike(glob(who)), most).otherwise(limit)
    return counts.withColumn("limit", limit).where(F.col("count") > F.col("limit")).select(F.col("w.start").alias("window_start"), user, "category", "count", "limit")


def rate_limited(requests: DataFrame, most: int, seconds: float, key: str = "client") -> DataFrame:
    """requests (key, ts as seconds, id) with ``accepted``: at most ``most`` accepted within any ``seconds``; refused ones do not count."""
    kind = dict(requests.dtypes)[key]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(pdfs).sort_values(["ts", "id"])
        out = []
        for t in pdf["ts"]:
            log = [x for x in log if x > t - seconds]
            out.append(len(log) < most)
            if out[-1]:
                log.append(float(t))
        state.update((log,))
        yield pdf.assign(accepted=out)[[key, "ts", "id", "accepted"]]

    return requests.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts double, id bigint, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)
