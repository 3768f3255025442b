"""Policies and rulesets: ordered rules over findings, compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.catalog import PRESETS, Catalog
from sluice.functions.text import glob

ACTIONS = ("allow", "flag", "redact", "tokenize", "obfuscate", "reject")


@dataclass(frozen=True)
class Rule:
    categories: tuple[str, ...]
    action: str
    sub_categories: tuple[str, ...] = ()
    min_confidence: float = 0.0

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"action is one of {', '.join(ACTIONS)}")

    def holds(self) -> Column:
        ok = F.col("category").isin(*self.categories) & (F.col("confidence") >= self.min_confidence)
        return ok & F.col("sub_category").isin(*self.sub_categories) if self.sub_categories else ok


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]

    @staticmethod
    def parse(config: Mapping) -> Policy:
        many = lambda x: tuple([x] if isinstance(x, str) else x or ())
        return Policy(config.get("name", "policy"), tuple(Rule(many(r.get("categories", r.get("category"))), r["action"], many(r.get("sub_categories")), float(r.get("min_confidence", 0))) for r in config.get("rules", ())))

    def action(self) -> Column:
        """The first rule that holds decides; findings that none meets are flagged."""
        out = None
        for r in self.rules:
            out = F.when(r.holds(), r.action) if out is None else out.when(r.holds(), r.action)
        return F.lit("flag") if out is None else out.otherwise("flag")

    def apply(self, findings: DataFrame) -> DataFrame:
        return findings.withColumn("action", self.action())

    def verdicts(self, findings: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, rejected, redacted, flagged (findings each)."""
        a = self.apply(findings)
        return a.groupBy(key).agg(F.bool_or(F.col("action") == "reject").alias("rejected"), F.count_if(F.col("action") == "redact").alias("redacted"), F.count_if(F.col("action") == "flag").alias("flagged"))


def redact_by_policy(text: Column, spans: Column, mark: str = "X") -> Column:
    """Whole spans become marks, separators too."""
    from sluice.operators.guard import spliced

    return spliced(text, spans, lambda x: F.repeat(F.lit(mark), x["span_end"] - x["span_start"]))


@dataclass(frozen=True)
class Ruleset:
    """A catalogue's selection: presets and categories, less what is excluded, plus own patterns."""

    presets: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    min_confidence: float = 0.0
    overrides: Mapping[str, float] = field(default_factory=dict)

    def catalog(self, base: Catalog | None = None) -> Catalog:
        base = base or Catalog.core()
        wanted = {c for p in self.presets for c in PRESETS[p]} | set(self.categories)
        chosen = base.only((wanted or set(base.categories())) - set(self.exclude))
        return Catalog(tuple(p for p in chosen.patterns if p.name not in self.disable))


# Presets, action, least confidence and whether context is required, by profile; None: all presets.
PROFILES = {
    "pci_production": (("PCI_DSS",), "reject", 0.7, True),
    "pci_development": (("PCI_DSS",), "obfuscate", 0.3, False),
    "hipaa_strict": (("HEALTHCARE",), "reject", 0.5, False),
    "hipaa_redact": (("HEALTHCARE",), "redact", 0.0, False),
    "gdpr_compliance": (("PII", "CONTACT_INFO"), "tokenize", 0.0, False),
    "soc2_secrets": (("CREDENTIALS",), "reject", 0.0, False),
    "full_scan": (None, "flag", 0.0, False),
    "development": (None, "obfuscate", 0.3, False),
    "ci_pipeline": (None, "reject", 0.5, True),
}
# End of fixed values.


def profile(name: str, base: Catalog | None = None, secret: bytes = b"", own: Mapping[str, tuple] | None = None):
    """The Guard of a profile; own: further profiles, as PROFILES has them, or others in their place."""
    from sluice.operators.guard import Guard

    presets, action, least, context = ({**PROFILES, **(own or {})})[name]
    catalog = (base or Catalog.core()).preset(*(presets or (*PRESETS, "PII_STRICT")))
    return Guard(catalog, action, least, require_context=context, secret=secret)


def session_stats(findings: DataFrame, window: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """What each user has shown in each window: window_start, user, total, uniques (values over all categories), categories."""
    out = findings.groupBy(F.window(ts, window).alias("w"), user).agg(F.count("*").alias("total"), F.count_distinct(F.concat_ws(":", "category", "matched")).alias("uniques"), F.array_sort(F.collect_set("category")).alias("categories"))
    return out.select(F.col("w.start").alias("window_start"), user, "total", "uniques", "categories")


def session_alerts(findings: DataFrame, policies: Iterable[tuple[str, int | None, int | None, str]], window: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Exposure by user and tumbling window: (window_start, user, category, alert_type, count, limit).

    policies: (category, max_total, max_unique, user pattern). Totals count
    findings of a category; uniques count the user's distinct values over all
    categories. An alert is raised where a count exceeds its limit. Works on
    batches and streams alike (totals; uniques need a batch or foreachBatch).
    """
    by_category = findings.groupBy(F.window(ts, window).alias("w"), user, "category").agg(F.count("*").alias("total"))
    unique = findings.groupBy(F.window(ts, window).alias("w"), user).agg(F.count_distinct(F.concat_ws(":", "category", "matched")).alias("uniques"))
    both = by_category.join(unique, ["w", user])
    out = None
    for category, most, different, who in policies:
        mine = both.where((F.col("category") == category) & F.col(user).cast("string").rlike(glob(who)))
        for kind, limit, n in (("total", most, "total"), ("unique", different, "uniques")):
            if limit is not None:
                part = mine.where(F.col(n) > limit).select(F.col("w.start").alias("window_start"), user, "category", F.lit(kind).alias("alert_type"), F.col(n).alias("count"), F.lit(limit).alias("limit"))
                out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no policy has a limit")
    return out
