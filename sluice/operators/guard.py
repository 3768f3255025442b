"""Guard actions over documents and their findings: reject, redact, flag, tokenize, obfuscate."""

from __future__ import annotations

import random
import string
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import Catalog
from sluice.functions.text import glob, hmac_sha256
from sluice.operators.scan import with_findings

ACTIONS = ("reject", "redact", "flag", "tokenize", "obfuscate")
# Short names of categories in tokens.
ABBREVIATIONS = {
    "Credit Card Numbers": "CC", "Primary Account Numbers": "PAN", "Card Track Data": "TRACK", "Card Expiration Dates": "EXPIRY",
    "Contact Information": "CONTACT", "Banking and Financial": "BANK", "Wire Transfer Data": "WIRE", "Check and MICR Data": "CHECK",
    "Securities Identifiers": "SEC", "Loan and Mortgage Data": "LOAN", "Regulatory Identifiers": "REG", "Banking Authentication": "AUTH",
    "Customer Financial Data": "CUSTFIN", "Internal Banking References": "INTREF", "PCI Sensitive Data": "PCI", "Cryptocurrency": "CRYPTO",
    "Vehicle Identification": "VIN", "Dates": "DATE", "URLs with Credentials": "URL", "Generic Secrets": "SECRET",
    "Cloud Provider Secrets": "CLOUD", "Code Platform Secrets": "CODE", "Payment Service Secrets": "PAY", "Messaging Service Secrets": "MSG",
    "Personal Identifiers": "PID", "Geolocation": "GEO", "Postal Codes": "ZIP", "Device Identifiers": "DEV",
    "Medical Identifiers": "MED", "Insurance Identifiers": "INS", "Authentication Tokens": "AUTHTOK", "Social Media Identifiers": "SOCIAL",
    "Education Identifiers": "EDU", "Legal Identifiers": "LEGAL", "Employment Identifiers": "EMP", "Biometric Identifiers": "BIO",
    "Property Identifiers": "PROP",
}
PREFIX = "TOK"
FAKE_DOMAINS = ("example.net", "example.org", "test.invalid", "sample.test")


def abbreviation(category: Column) -> Column:
    """Listed, or for 'Region - Country' the initials of both, or initials."""
    initials = lambda c: F.array_join(F.transform(F.split(c, " +"), lambda w: F.left(w, F.lit(1))), "")
    region, country = F.substring_index(category, " - ", 1), F.substring_index(category, " - ", -1)
    short = F.upper(F.when(F.contains(category, F.lit(" - ")), F.concat(initials(region), F.lit("_"), F.left(initials(country), F.lit(3)))).otherwise(initials(category)))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), short)


def token(category: Column, value: Column, secret: bytes, prefix: str = PREFIX) -> Column:
    """The same for the same category, value and secret."""
    digest = F.left(hmac_sha256(secret, F.concat(category, F.lit(":"), value)), F.lit(8))
    return F.concat(F.lit(prefix + "_"), abbreviation(category), F.lit("_"), digest)


def spliced(text: Column, spans: Column, new) -> Column:
    """text with each span (sorted, disjoint) replaced by new(span): one pass, pieces joined at the end."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["span_start"] - acc["at"])
        return F.struct(x["span_end"].alias("at"), F.concat(acc["out"], F.array(gap, new(x))).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def masked(value: Column, mark: str = "X") -> Column:
    """Every character but separators becomes the mark, so that the length stays."""
    return F.regexp_replace(value, "[^-. /\\\\_–— ]", mark)


@dataclass(frozen=True)
class Guard:
    catalog: Catalog = field(default_factory=Catalog.core)
    action: str = "redact"
    min_confidence: float = 0.0
    overrides: Mapping[str, float] = field(default_factory=dict)
    allow_texts: tuple[str, ...] = ()
    allow_categories: tuple[str, ...] = ()
    require_context: bool = False
    mark: str = "X"
    secret: bytes = b""
    seed: int = 0
    max_matches: int | None = None
    max_chars: int | None = None
    max_seconds: float | None = None

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"action is one of {', '.join(ACTIONS)}")
        if self.action == "tokenize" and not self.secret:
            raise ValueError("tokens need a secret")

    def apply(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """key, status, is_clean, finding_count, categories_found, findings, result and (flag, reject) rejected. Nulls are clean.

        A text that a limit of the caller's kept from being scanned to its end
        (status truncated, timeout or too_large) is never clean and has no result.
        """
        found = with_findings(df.select(key, text), self.catalog, text, require_context=self.require_context, max_matches=self.max_matches, max_chars=self.max_chars, max_seconds=self.max_seconds, apart=True)
        whole = ~F.col("status").isin("truncated", "timeout", "too_large")

        def stays(x: Column) -> Column:
            bound = F.lit(float(self.min_confidence))
            for c, least in self.overrides.items():
                bound = F.when(x["category"] == c, F.lit(float(least))).otherwise(bound)
            ok = x["confidence"] >= bound
            for t in self.allow_texts:
                ok = ok & (~x["matched"].rlike(glob(t)) if set(t) & set("*?[") else x["matched"] != t)
            return ok & ~x["category"].isin(list(self.allow_categories)) if self.allow_categories else ok

        every = found.select(key, text, "status", "gaps", "findings")
        found = every.withColumns({"all": F.col("findings"), "findings": F.filter("findings", stays)})

        def changed(new) -> Column:
            """Gaps and findings in turn, those that stay in their new form: no place is sought in the text."""
            pairs = F.zip_with(F.slice("gaps", F.lit(1), F.size("all")), F.col("all"), lambda g, x: F.concat(g, F.when(stays(x), new(x)).otherwise(x["matched"])))
            return F.when(whole & F.col(text).isNotNull(), F.concat(F.array_join(pairs, ""), F.coalesce(F.element_at("gaps", -1), F.lit(""))))

        out = found.select(key, text, "status", "findings", "gaps", "all", (whole & (F.size("findings") == 0)).alias("is_clean"), F.size("findings").alias("finding_count"), F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["category"]))).alias("categories_found"))
        if self.action == "redact":
            return out.withColumn("result", changed(lambda x: masked(x["matched"], self.mark))).drop("gaps", "all")
        if self.action == "tokenize":
            return out.withColumn("result", changed(lambda x: token(x["category"], x["matched"], self.secret))).drop("gaps", "all")
        out = out.drop("gaps", "all")
        if self.action == "obfuscate":
            return out.withColumn("result", F.when(whole, obfuscated(self.seed)(F.col(key).cast("string"), F.col(text), F.col("findings"))))
        return out.withColumn("result", F.when(whole, F.col(text))).withColumn("rejected", F.lit(self.action == "reject") & ~F.col("is_clean"))

    def vault(self, guarded: DataFrame) -> DataFrame:
        """token, original, category of every finding of apply()."""
        rows = guarded.select(F.inline("findings")).select("category", "matched").distinct()
        return rows.select(token(F.col("category"), F.col("matched"), self.secret).alias("token"), F.col("matched").alias("original"), "category")


def detokenized(df: DataFrame, vault: DataFrame, text: str = "text", key: str = "doc_id", prefix: str = PREFIX) -> DataFrame:
    """key and text with the vault's tokens put back; unknown tokens stay, and so do those that stand for several values. Rows may share a key."""
    shape = rf"{prefix}_[A-Z0-9_]+_[0-9a-f]{{8}}"
    own = df.select(key, text, F.sha2(text, 256).alias("_h"), F.split(text, shape).alias("gaps"), F.regexp_extract_all(text, F.lit(shape), 0).alias("toks"))
    each = own.select(key, "_h", F.posexplode("toks").alias("i", "token"))
    back = each.join(settled_tokens(vault), "token", "left").groupBy(key, "_h").agg(F.array_sort(F.collect_set(F.struct("i", F.coalesce("original", "token").alias("v")))).alias("vs"))
    both = own.alias("l").join(back.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._h") == F.col("r._h")), "left")
    joined = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("vs", i)["v"], F.lit("")))), "")
    return both.select(f"l.{key}", F.coalesce(joined, F.col(text)).alias(text))


def settled_tokens(vault: DataFrame) -> DataFrame:
    """token, original: tokens that stand for one value."""
    return vault.groupBy("token").agg(F.min("original").alias("original"), F.max("original").alias("_most")).where(F.col("original") == F.col("_most")).drop("_most")


def colliding_tokens(vault: DataFrame) -> DataFrame:
    """token, originals: tokens that stand for several values."""
    return vault.groupBy("token").agg(F.array_sort(F.collect_set("original")).alias("originals")).where(F.size("originals") > 1)


def export_vault(vault: DataFrame, path: str) -> None:
    """JSON lines of token, original and category."""
    vault.select("token", "original", "category").distinct().write.mode("overwrite").json(path)


def import_vault(spark: SparkSession, path: str, into: DataFrame | None = None) -> DataFrame:
    """An exported vault, added to another if one is given."""
    new = spark.read.schema("token string, original string, category string").json(path)
    return new if into is None else into.select("token", "original", "category").unionByName(new).distinct()


def redacted_by(df: DataFrame, category: str, sub_category: str, catalog: Catalog | None = None, mark: str = "X", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text with every match of one expression masked, whatever stands near it and whether or not its digits check; an unknown name is an error."""
    p = (catalog or Catalog.core()).named(category, sub_category)
    alone = Catalog((replace(p, category="Redaction", context_required=False, keywords=()),))
    found = with_findings(df.select(key, text), alone, text)
    return found.select(key, spliced(F.col(text), F.col("findings"), lambda x: masked(x["matched"], mark)).alias(text))


def fake(category: str, name: str, value: str, r: random.Random) -> str:
    """A value of the same form; cards stay valid."""
    low = name.lower()
    if category == "Credit Card Numbers":
        digits = [c for c in value if c.isdigit()]
        body = digits[:4] + [str(r.randrange(10)) for _ in digits[5:]]
        for last in "0123456789":
            new = [*body, last]
            if (sum(int(c) for c in new[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in new[-2::-2])) % 10 == 0:
                break
        rest = iter(new)
        return "".join(next(rest) if c.isdigit() else c for c in value)
    if "email" in low:
        return "".join(r.choices(string.ascii_lowercase, k=8)) + "@" + r.choice(FAKE_DOMAINS)
    if "ipv4" in low:
        return f"{r.randint(10, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}"
    if low.startswith("mac "):
        return (":" if ":" in value else "-").join(f"{r.randint(0, 255):02x}" for _ in range(6))
    keep = 2 if "iban" in low else 0
    some = lambda c: r.choice(string.digits) if c.isdigit() else r.choice(string.ascii_uppercase) if c.isupper() else r.choice(string.ascii_lowercase) if c.islower() else c
    return value[:keep] + "".join(map(some, value[keep:]))


def obfuscated(seed: int):
    """A vectorised function (key, text, findings) -> text; the seed, key and place decide, so order does not."""

    @F.arrow_udf("string")
    def run(keys: pa.Array, texts: pa.Array, findings: pa.Array) -> pa.Array:
        out = []
        for k, t, fs in zip(keys.to_pylist(), texts.to_pylist(), findings.to_pylist(), strict=True):
            parts, at = [], 0
            for x in fs or []:
                r = random.Random(f"{seed}:{k}:{x['span_start']}")
                parts += [t[at : x["span_start"]], fake(x["category"], x["sub_category"], x["matched"], r)]
                at = x["span_end"]
            out.append(t if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return run


#: What each role may do with a vault.
ROLES = {"admin": {"tokenize", "detokenize", "export", "manage"}, "analyst": {"detokenize", "export"}, "operator": {"detokenize"}, "viewer": set()}


def permitted(role: str, action: str) -> bool:
    return action in ROLES.get(role, set())

