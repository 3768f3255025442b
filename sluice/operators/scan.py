"""The scan: text to findings.

A finding is a row (category, sub_category, matched, span_start, span_end,
has_context, context_required, confidence). Expressions need look-around and
Python's word semantics, so the scan runs in Arrow batches with every compiled
pattern kept in the worker; all that follows (overlaps, thresholds, allowlists,
roll-ups) is made of Column expressions and joins.
"""

from __future__ import annotations

import functools
import re
import time
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.catalog import CONTEXT_BOOST, Catalog, Pattern
from sluice.functions.text import EXOTIC_SPACES, LEET, LOOKALIKES
from sluice.operators.spread import spread

FINDING = "category string, sub_category string, matched string, span_start int, span_end int, has_context boolean, context_required boolean, confidence double, ord int"
FUZZY_DISTANCE, FUZZY_LENGTH = 2, 5

_INVISIBLE = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff\xad\u034f\u061c\u180e\ufff9-\ufffb\u202a-\u202e\u2066-\u2069\ufe00-\ufe0f\U000e0001-\U000e007f]")
_SPACES = str.maketrans(EXOTIC_SPACES, " " * len(EXOTIC_SPACES))
_LOOK = str.maketrans(*LOOKALIKES)
_LEET = str.maketrans(*LEET)
#: Characters of one byte that normalized() changes.
_ODD_LATIN = bytes(c for c in range(256) if unicodedata.normalize("NFKC", chr(c)) != chr(c) or _INVISIBLE.match(chr(c)) or c in _SPACES or c in _LOOK)
_WORD = re.compile(r"\b\w+\b")
_DIGITS = re.compile(r"\d+")
#: Width up to which an expression is sought around digits only, and what look-ahead sees beyond.
NEAR, _MARGIN = 200, 64
#: Reach of an expression that needs a digit and is wider: the whole text.
WHOLE = -1


def normalized(text: str) -> tuple[str, list[int] | None]:
    """Text as patterns see it, and each of its places in the original (None: the same).

    Invisible characters go, exotic spaces become spaces, compatibility forms
    and lookalikes become plain. ASCII texts are returned as they are.
    """
    if text.isascii():
        return text, None
    try:
        latin = text.encode("latin-1")
        if len(latin.translate(None, _ODD_LATIN)) == len(latin):
            return text, None
    except UnicodeEncodeError:
        pass
    bare, places = text, None
    if _INVISIBLE.search(text):
        places = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        bare = "".join(text[i] for i in places)
    return unicodedata.normalize("NFKC", bare.translate(_SPACES)).translate(_LOOK), places


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; rows that exceed it end the search."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


@dataclass(frozen=True)
class Needs:
    """What every match of an expression holds, whatever branch it takes: a decimal digit, some literal texts; and how long it can get."""

    digit: bool
    literals: frozenset[str]
    width: int


def _held(items) -> tuple[bool, frozenset[str]]:
    """digit and literal runs of a parsed sequence."""
    digit, found, run = False, set(), ""
    for op, arg in [*items, (None, None)]:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.add(run)
            run = ""
        if op is _c.IN:
            digit |= all(k is _c.CATEGORY and v is _c.CATEGORY_DIGIT or k is _c.RANGE and 48 <= v[0] and v[1] <= 57 or k is _c.LITERAL and 48 <= v <= 57 for k, v in arg)
        elif op is _c.SUBPATTERN:
            if not arg[1] & re.IGNORECASE:
                d, f = _held(arg[3])
                digit, found = digit | d, found | f
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0]:
            d, f = _held(arg[2])
            digit, found = digit | d, found | f
        elif op is _c.ATOMIC_GROUP:
            d, f = _held(arg)
            digit, found = digit | d, found | f
        elif op is _c.BRANCH:
            each = [_held(x) for x in arg[1]]
            digit |= all(d for d, _ in each)
            found |= frozenset.intersection(*[f for _, f in each])
    return digit or any(c.isdigit() for f in found for c in f), frozenset(found)


def needs(regex: str) -> Needs:
    tree = _parser.parse(regex)
    if tree.state.flags & re.IGNORECASE:
        return Needs(_held([x for x in tree if x[0] is not _c.LITERAL])[0], frozenset(), tree.getwidth()[1])
    digit, literals = _held(tree)
    return Needs(digit, literals, tree.getwidth()[1])


class Matcher:
    """A catalogue compiled for one worker."""

    def __init__(self, catalog: Catalog, substring: bool = False):
        """substring: a keyword speaks for a match wherever its letters stand, within words too, and only as it is spelled."""
        self.rows, self.substring = [], substring
        for i, p in enumerate(catalog.patterns):
            words = re.compile("|".join(re.escape(k) if substring else rf"\b{re.escape(k)}\b" for k in p.keywords), re.IGNORECASE) if p.keywords else None
            long = [(k.lower(), len(k.split())) for k in p.keywords if len(k) >= FUZZY_LENGTH and not substring]
            need = needs(p.regex)
            self.rows.append((i, p, re.compile(p.regex), words, long, sorted(need.literals, key=len, reverse=True), 0 if not need.digit else need.width if need.width <= NEAR else WHOLE))

    @staticmethod
    def matches(regex: re.Pattern, text: str, reach: int, digits: list[tuple[int, int]]) -> Iterator[re.Match]:
        """All matches in order; of an expression that needs a digit and is at most ``reach`` wide, sought only around the digits."""
        if reach <= 0:
            yield from regex.finditer(text)
            return
        last, at = 0, 0
        while at < len(digits):
            start, end = digits[at][0] - reach, digits[at][1] + reach
            at += 1
            while at < len(digits) and digits[at][0] - reach <= end + _MARGIN:
                end = digits[at][1] + reach
                at += 1
            # The margin shows look-ahead what follows; whatever begins in it needs a later digit.
            for m in regex.finditer(text, max(last, start), min(len(text), end + _MARGIN)):
                yield m
                last = m.end()

    def context(self, text: str, start: int, end: int, p: Pattern, words: re.Pattern | None, long: list[tuple[str, int]]) -> bool:
        """A keyword near the match: as it is, misspelt by up to two edits, or in leet spelling."""
        if words is None:
            return False
        pre, post = text[max(0, start - p.distance) : start], text[end : end + p.distance]
        if words.search(pre) or words.search(post):
            return True
        window = pre + " " + post
        tokens = _WORD.findall(window.lower())
        for key, n in long:
            for i in range(len(tokens) - n + 1):
                if within(tokens[i] if n == 1 else " ".join(tokens[i : i + n]), key, FUZZY_DISTANCE):
                    return True
        if not self.substring and window.translate(_LEET) != window:
            return bool(words.search(pre.translate(_LEET)) or words.search(post.translate(_LEET)))
        return False

    def find(self, original: str, require_context: bool = False, max_matches: int | None = None, max_seconds: float | None = None) -> list[tuple]:
        end = None if max_seconds is None else time.monotonic() + max_seconds
        text, places = normalized(original)
        digits = [m.span() for m in _DIGITS.finditer(text)]
        out: list[tuple] = []
        for i, p, regex, words, long, literals, reach in self.rows:
            if reach and not digits or any(x not in text for x in literals):
                continue
            if end is not None and time.monotonic() > end:
                raise OutOfTime(out)
            for m in self.matches(regex, text, reach, digits):
                if p.category == "Credit Card Numbers" and not luhn_valid(m.group()):
                    continue
                near = self.context(text, m.start(), m.end(), p, words, long)
                if not near and (p.context_required or require_context):
                    continue
                if max_matches is not None and len(out) >= max_matches:
                    raise TooMany(out)
                s, e = m.span()
                if places is not None:
                    s, e = (places[s] if s < len(places) else len(original)), (places[e - 1] + 1 if 0 < e <= len(places) else len(original))
                score = round(min(1.0, p.specificity + (CONTEXT_BOOST if near else 0)), 2)
                out.append((p.category, p.name, original[s:e], s, e, near, p.context_required, score, i))
        return out


class OutOfTime(Exception):
    """The time for a text was over between two patterns; what was found by then is its argument."""


class TooMany(Exception):
    """More matches than asked for; the first ones are its argument."""


def settled(found: list[tuple]) -> list[tuple]:
    """Of overlapping findings the more confident stays, then the longer, then the earlier in order; by start."""
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[3], x[3] - x[4], x[8])):
        if not out or x[3] >= out[-1][4]:
            out.append(x)
        elif (x[7], x[4] - x[3]) > (out[-1][7], out[-1][4] - out[-1][3]):
            out[-1] = x
    return out


def luhn_valid(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not digits:
        return False
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return total % 10 == 0


@functools.lru_cache(8)
def matcher(catalog: Catalog, substring: bool = False) -> Matcher:
    return Matcher(catalog, substring)


def with_findings(df: DataFrame, catalog: Catalog | None = None, text: str = "text", categories: Iterable[str] | None = None, require_context: bool = False, max_matches: int | None = None, max_chars: int | None = None, max_seconds: float | None = None, substring: bool = False, apart: bool = False) -> DataFrame:
    """df with ``findings`` (in catalogue order, overlaps included) and ``status``: ok, empty, truncated, timeout or too_large.

    Texts are scanned whole and all their matches kept, unless the caller sets
    a limit: a text of more than ``max_chars`` characters is too_large and has
    no findings, one with more than ``max_matches`` is truncated to them, and
    one that takes more than ``max_seconds`` has what was found by then.
    apart: overlaps are settled as without_overlaps does, in one pass, and a
    column ``gaps`` has the text before each finding, and after the last.
    """
    chosen = (catalog or Catalog.core()).only(categories)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", status string, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>" + (", gaps array<string>" if apart else "")
    columns = list(df.columns)
    at = columns.index(text)
    names = [x.split()[0] for x in FINDING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(chosen, substring)
        for b in batches:
            found, status, gaps = [], [], []
            for t in b.column(at):
                t = t.as_py()
                status.append("empty" if not t else "too_large" if max_chars is not None and len(t) > max_chars else "ok")
                own = []
                if status[-1] == "ok":
                    try:
                        own = m.find(t, require_context, max_matches, max_seconds)
                    except TooMany as x:
                        own, status[-1] = x.args[0], "truncated"
                    except OutOfTime as x:
                        own, status[-1] = x.args[0], "timeout"
                if apart:
                    own = settled(own)
                    edges = [0, *[e for x in own for e in x[3:5]], len(t or "")]
                    gaps.append([t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)] if t is not None else [])
                found.append([dict(zip(names, x, strict=True)) for x in own])
            kind = pa.list_(pa.struct([(n, k) for n, k in zip(names, [pa.string()] * 3 + [pa.int32()] * 2 + [pa.bool_()] * 2 + [pa.float64(), pa.int32()], strict=True)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status), pa.array(found, kind), *([pa.array(gaps, pa.list_(pa.string()))] if apart else [])], names=[*columns, "status", "findings", *["gaps"] * apart])

    return spread(df).mapInArrow(run, schema)


def scan(df: DataFrame, catalog: Catalog | None = None, text: str = "text", key: str = "doc_id", deduplicate: bool = True, **options) -> DataFrame:
    """A row per finding: key and the columns of FINDING. Null and empty texts have none."""
    found = with_findings(df.select(key, text), catalog, text, apart=deduplicate, **options)
    return found.select(key, F.inline("findings"))


def scan_distinct(df: DataFrame, catalog: Catalog | None = None, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """As scan(), but each different text is scanned once: worth its shuffle where many rows repeat.

    Rows meet their text's findings again by digest; a text that very many rows
    share is one row on the findings' side.
    """
    rows = df.select(key, F.sha2(text, 256).alias("_h"))
    once = df.select(F.sha2(text, 256).alias("_h"), text).dropDuplicates(["_h"])
    return rows.join(scan(once, catalog, text, "_h", **options), "_h").drop("_h")
