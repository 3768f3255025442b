"""What becomes of findings: overlaps, thresholds, allowlists, baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import glob


def without_overlaps(findings: str) -> Column:
    """Of overlapping findings the more confident stays, then the longer, then the earlier in order.

    A fold over the array sorted by start and length: each finding meets only
    the last one kept.
    """
    length = lambda x: x["span_end"] - x["span_start"]
    order = lambda a, b: F.when(a["span_start"] != b["span_start"], a["span_start"] - b["span_start"]).when(length(a) != length(b), length(b) - length(a)).otherwise(a["ord"] - b["ord"])
    ordered = F.array_sort(F.col(findings), order)

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        better = (x["confidence"] > last["confidence"]) | ((x["confidence"] == last["confidence"]) & (length(x) > length(last)))
        return F.when((F.size(kept) == 0) | (x["span_start"] >= last["span_end"]), F.array_append(kept, x)).when(better, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), x)).otherwise(kept)

    return F.aggregate(ordered, F.slice(F.col(findings), 1, 0), step)


def confident(df: DataFrame, least: float = 0.0, overrides: Mapping[str, float] | None = None) -> DataFrame:
    """Findings that reach their category's threshold, or the general one."""
    bound = F.lit(float(least))
    for category, x in (overrides or {}).items():
        bound = F.when(F.col("category") == category, F.lit(float(x))).otherwise(bound)
    return df.where(F.col("confidence") >= bound)


def outside_categories(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Allowlist mode; no allowed categories filter nothing."""
    allowed = list(allowed)
    return df.where(~F.col("category").isin(allowed)) if allowed else df


def not_allowed(df: DataFrame, texts: Iterable[str] = (), sub_categories: Iterable[str] = ()) -> DataFrame:
    """Drop findings whose text is listed (with * ? [ a shell pattern) or whose sub-category is."""
    plain = [t for t in texts if not set(t) & set("*?[")]
    out = df.where(~F.col("matched").isin(plain)) if plain else df
    for t in set(texts) - set(plain):
        out = out.where(~F.col("matched").rlike(glob(t)))
    names = list(sub_categories)
    return out.where(~F.col("sub_category").isin(names)) if names else out


def outside_paths(df: DataFrame, globs: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose path meets none of the shell patterns."""
    for g in globs:
        df = df.where(~F.coalesce(F.col(path).rlike(glob(g)), F.lit(False)))
    return df


def ignore_rules(text: str) -> dict[str, list[str]]:
    """An ignore file's lines by kind: ``text:``, ``sub_category:`` and ``path:`` or nothing before a path's pattern; # starts a comment."""
    out: dict[str, list[str]] = {"text": [], "sub_category": [], "path": []}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            kind, colon, rest = line.partition(":")
            out[kind if colon and kind in out else "path"].append(rest.strip() if colon and kind in out else line)
    return out


def ignoring(df: DataFrame, rules: Mapping[str, list[str]], path: str | None = "path") -> DataFrame:
    """Findings that an ignore file's rules leave."""
    df = not_allowed(df, rules.get("text", ()), rules.get("sub_category", ()))
    return outside_paths(df, rules.get("path", ()), path) if path else df


def processed(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Findings after each of the steps in turn."""
    for f in steps:
        df = f(df)
    return df


def without_ignored_lines(df: DataFrame, text: str, marker: str = "scan:ignore") -> DataFrame:
    """Findings whose line carries the marker go; df has text and the span."""
    before = F.substring_index(F.substring(F.col(text), F.lit(1), F.col("span_start")), "\n", -1)
    after = F.substring_index(F.substring(F.col(text), F.col("span_start") + 1, F.length(text)), "\n", 1)
    return df.where(~F.contains(F.concat(before, after), F.lit(marker)))


def beyond_baseline(df: DataFrame, baseline: DataFrame, on: Iterable[str] = ("filename", "category", "sub_category")) -> DataFrame:
    return df.join(baseline.select(*on).distinct(), list(on), "left_anti")


def validated(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Predicates by sub-category; a null verdict drops the finding."""
    for name, ok in rules.items():
        df = df.where((F.col("sub_category") != name) | F.coalesce(ok, F.lit(False)))
    return df
