"""The scan in plain SQL, for comparison: expressions, context, confidence and overlaps of a catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterable

from sluice.catalog import CONTEXT_BOOST, Catalog, Pattern
from sluice.functions.text import LEET
from sluice.operators.scan import FUZZY_DISTANCE, FUZZY_LENGTH

#: Expressions that look around, without doing so, and the condition on the match m and the character c before it that stands in.
PLAIN = {
    "Ticker Symbol": (r"\$[A-Z]{1,5}\b", "NOT regexp_matches(c, '[\\p{L}\\p{N}_]')"),
    "Geohash": (r"\b[0-9bcdefghjkmnpqrstuvwxyz]{7,12}\b", "regexp_matches(m, '[0-9]')"),
    "Twitter Handle": (r"@[A-Za-z_]\w{0,14}\b", "NOT regexp_matches(c, '[\\p{L}\\p{N}_]')"),
    "Hashtag": (r"#[A-Za-z]\w{2,49}\b", "NOT regexp_matches(c, '[\\p{L}\\p{N}_]')"),
    "AWS Secret Key": (r"[A-Za-z0-9/+=]+", "length(m) = 40"),
}
#: A border of words, and what RE2 must be told is a character of one.
BORDER, WORD = r"\b", r"[\p{L}\p{N}_]"
DIGITS = "list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda x: CAST(x AS INT))"
LUHN = f"(list_sum(list_transform({DIGITS}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spelled(regex: str) -> str:
    """An expression in RE2's spelling."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", regex)


def _row(i: int, p: Pattern, table: str, key: str) -> str:
    regex = quoted(spelled(PLAIN.get(p.name, (p.regex,))[0]))
    return f"SELECT {i} AS ord, {key} AS doc_id, text AS t, regexp_extract_all(text, {regex}) AS ms, string_split_regex(text, {regex}) AS gs FROM {table} WHERE regexp_matches(text, {regex})"


def _about(i: int, p: Pattern) -> str:
    words = quoted("(?i)" + "|".join(rf"\b{re.escape(k)}\b" for k in p.keywords) if p.keywords else "[^\\s\\S]")
    long = ", ".join(f"{{'k': {quoted(k.lower())}, 'n': {len(k.split())}}}" for k in p.keywords if len(k) >= FUZZY_LENGTH)
    long = f"[{long}]" if long else "CAST([] AS STRUCT(k VARCHAR, n INTEGER)[])"
    regex = PLAIN.get(p.name, (p.regex,))[0]
    return f"({i}, {str(regex.startswith(BORDER)).lower()}, {str(regex.endswith(BORDER)).lower()}, {quoted(p.category)}, {quoted(p.name)}, CAST({p.specificity} AS DOUBLE), {str(p.context_required).lower()}, {p.distance}, {words}, {long})"


def found(categories: Iterable[str] | None = None, table: str = "documents", key: str = "doc_id") -> str:
    """Common table expressions of which the last, ``found``, has every finding, overlaps included."""
    rows = list(enumerate(Catalog.core().only(categories).patterns))
    ok = " ".join(f"WHEN ord = {i} THEN {PLAIN[p.name][1]}" for i, p in rows if p.name in PLAIN) + " " + " ".join(f"WHEN ord = {i} THEN {LUHN}" for i, p in rows if p.category == "Credit Card Numbers")
    ok = f"CASE {ok} ELSE true END" if ok.strip() else "true"
    leet = f"{quoted(LEET[0])}, {quoted(LEET[1])}"
    return f"""about(ord, lead, trail, category, sub_category, spec, need, dist, words, long) AS (VALUES {", ".join(_about(i, p) for i, p in rows)}),
raw AS ({" UNION ALL ".join(_row(i, p, table, key) for i, p in rows)}),
placed AS (SELECT ord, doc_id, t, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM raw)),
held AS (SELECT *, s + length(m) AS e FROM (SELECT *, substr(t, s, CASE WHEN s > 0 THEN 1 ELSE 0 END) AS c FROM placed) WHERE {ok}),
near AS (SELECT h.*, a.* EXCLUDE (ord), substr(t, greatest(0, s - dist) + 1, s - greatest(0, s - dist)) AS pre, substr(t, e + 1, dist) AS post FROM held h JOIN about a USING (ord)
  WHERE NOT (lead AND s > 0 AND regexp_matches(c || m, '^{WORD}{{2}}')) AND NOT (trail AND regexp_matches(m || substr(t, e + 1, 1), '{WORD}{{2}}$') AND e < length(t))),
toks AS (SELECT *, regexp_extract_all(lower(pre || ' ' || post), '[\\p{{L}}\\p{{N}}_]+') AS tk FROM near),
felt AS (SELECT *, regexp_matches(pre, words) OR regexp_matches(post, words) OR regexp_matches(translate(pre, {leet}), words) OR regexp_matches(translate(post, {leet}), words)
  OR len(list_filter(long, lambda k: len(list_filter(range(1, len(tk) - k.n + 2), lambda i: levenshtein(array_to_string(tk[i:i + k.n - 1], ' '), k.k) <= {FUZZY_DISTANCE})) > 0)) > 0 AS has_context FROM toks),
found AS (SELECT doc_id, category, sub_category, m AS matched, s AS span_start, CAST(e AS INT) AS span_end, has_context, need AS context_required,
  round(least(1.0, spec + CASE WHEN has_context THEN {CONTEXT_BOOST} ELSE 0 END), 2) AS confidence, ord FROM felt WHERE has_context OR NOT need)"""


def apart(name: str = "best", source: str = "found") -> str:
    """Further expressions: ``{name}_lists`` (doc_id, fs: findings without overlaps) and ``name``, their rows."""
    better = "x[1].confidence > a[-1].confidence OR x[1].confidence = a[-1].confidence AND x[1].span_end - x[1].span_start > a[-1].span_end - a[-1].span_start"
    return f"""{name}_lists AS (SELECT doc_id, list_reduce(list_transform(fs, lambda x: [x]), lambda a, x: CASE WHEN x[1].span_start >= a[-1].span_end THEN list_concat(a, x) WHEN {better} THEN list_concat(a[1:len(a) - 1], x) ELSE a END) AS fs
  FROM (SELECT doc_id, list(f ORDER BY f.span_start, f.span_end - f.span_start DESC, f.ord) AS fs FROM {source} f GROUP BY doc_id)),
{name} AS (SELECT doc_id, x.category AS category, x.sub_category AS sub_category, x.matched AS matched, x.span_start AS span_start, x.span_end AS span_end, x.has_context AS has_context, x.context_required AS context_required, x.confidence AS confidence FROM (SELECT doc_id, unnest(fs) AS x FROM {name}_lists))"""


def spliced(new: str, lists: str = "best_lists", table: str = "documents") -> str:
    """``spliced`` (doc_id, result, fs): texts with each finding x replaced by the expression ``new``."""
    return f"""spliced AS (SELECT d.doc_id, fs, CASE WHEN fs IS NULL THEN text ELSE array_to_string(list_transform(fs, lambda x, i: substr(text, CASE WHEN i > 1 THEN fs[i - 1].span_end ELSE 0 END + 1, x.span_start - CASE WHEN i > 1 THEN fs[i - 1].span_end ELSE 0 END) || {new}), '') || substr(text, fs[-1].span_end + 1) END AS result
  FROM {table} d LEFT JOIN {lists} USING (doc_id))"""


def hmac(key: bytes, message: str) -> str:
    """Hex HMAC-SHA-256 of a text expression."""
    padded = key.ljust(64, b"\0")
    blob = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in padded) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({message}))))"
