"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust a score.

DataFrame functions only. Spans are in code points, end exclusive. The
expressions are written so that Java's matcher neither backtracks over long runs
nor recurses: a run of address characters is entered at its start (or where the
last match ended) and taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

_RUN = "[A-Za-z0-9._%+-]"
#: Base kinds in order of report: expression of equal matches to the plain one.
BASE = {
    "email": rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds, after the base kinds.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "short_card": BASE["card"],
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20]?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9-])",
}
#: Words that speak for a kind when they stand within NEAR code points before a span.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|correo|courriel",
    "ip": "ip|address|host|server|addr|adresse",
    "card": "card|karte|carte|tarjeta|visa|credit|payment",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|handy",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social|security|tax",
    "short_card": "card|karte|carte|tarjeta|amex|visa|credit|payment",
    "local_phone": "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|handy",
}
NEAR = 40
#: Score of a confirmed span without and with such a word; added kinds are reported from LEAST on, base kinds always.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.7, 0.95), "ssn": (0.5, 0.9), "short_card": (0.4, 0.8), "local_phone": (0.3, 0.7)}
LEAST = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def mod97(m: Column) -> Column:
    """The remainder that is 1 for a valid IBAN."""
    bare = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.array_remove(chars, ""), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _octets(m),
        "card": n.between(16, 19) & F.call_function("luhn_check", _digits(m)),
        "phone": n.between(8, 15),
        "iban": F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (mod97(m) == 1),
        "ssn": F.lit(True),
        "short_card": _digits(m).rlike("^(?:3[47][0-9]{13}|3[0689][0-9]{12}|4[0-9]{12})$") & F.call_function("luhn_check", _digits(m)),
        "local_phone": n.between(9, 12),
    }[kind]


def _hint(kind: str, t: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "iban": t.rlike("[A-Z]{2}[0-9]{2}"), "ip": t.rlike(r"[0-9]\.[0-9]"), "ssn": t.rlike("[0-9]-[0-9]{2}-[0-9]")}.get(kind, t.rlike("[0-9]"))


def _placed(kind: str, pieces: Column, found: Column) -> Column:
    """All matches as (kind, s, e, m), from the pieces between them: a running sum of lengths."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def with_spans(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``also``, base and spans: arrays of (kind, s, e, score).

    base holds the confirmed matches of the base kinds, by kind and place, all
    whatever their score, which nearby words raise.
    spans adds the other kinds' that reach LEAST and touch no base span. Null
    text is empty; an email, ip, card or phone that fails its check is dropped
    without a retry.
    """
    kinds = {**BASE, **ADDED}
    none = F.array().cast("array<string>")
    df = docs.select(*also, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.select("*", *[F.when(_hint(k, F.col("_t")), F.regexp_extract_all("_t", F.lit(p), 0)).otherwise(none).alias(f"_m_{k}") for k, p in kinds.items() if k != "short_card"])
    empty = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")
    some = lambda k: F.col("_m_card" if k == "short_card" else f"_m_{k}")

    def confirmed(k: str) -> Column:
        spans = F.filter(_placed(k, F.split("_t", kinds[k]), some(k)), lambda x: _valid(k, x["m"]))
        return F.when(F.exists(some(k), lambda m: _valid(k, m)), spans).otherwise(empty).alias(f"_s_{k}")

    placed = [confirmed(k) for k in kinds]
    df = df.select(*also, "_t", *placed)

    def scored(k: str) -> Column:
        def score(x: Column) -> Column:
            before = F.lower(F.substring(F.col("_t"), F.greatest(x["s"] - NEAR, F.lit(0)) + 1, F.least(x["s"], F.lit(NEAR))))
            low, high = SCORES[k]
            return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(before.rlike(rf"(?<!\p{{L}})(?:{CONTEXT[k]})"), high).otherwise(low).alias("score"))

        return F.transform(F.col(f"_s_{k}"), score)

    more = F.filter(F.concat(*[scored(k) for k in ADDED]), lambda x: x["score"] >= LEAST)
    df = df.select(*also, F.concat(*[scored(k) for k in BASE]).alias("base"), more.alias("_more"))
    # Of added kinds that overlap each other the one listed first stays.
    rank = {k: i for i, k in enumerate(ADDED)}
    order = lambda x: F.coalesce(*[F.when(x["kind"] == k, i) for k, i in rank.items()])
    free = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & ~F.exists("_more", lambda y: (order(y) < order(x)) & (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return settled(df.select(*also, "base", F.concat("base", F.filter("_more", free)).alias("spans")))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
