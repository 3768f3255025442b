"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXOTIC_SPACES = "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{ad}\x{34f}\x{61c}\x{180e}\x{fff9}-\x{fffb}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{fe00}-\x{fe0f}\x{e0001}-\x{e007f}]"
LEET = ("@$!|+0134578({692", "asiltoleastbccggz")
LOOKALIKES = (
    "АаВвСсЕеНнІіЈјКкМмОоРрЅѕТтХхУуЗ"
    "ΑαΒβΓΕεΗηΙιΚκΜμΝνΟοΡρΤτΧχΥυΖζ"
    "‐‑‒–—―−﹘﹣－",
    "AaBbCcEeHhIiJjKkMmOoPpSsTtXxYyZAaBbGEeHhIiKkMmNnOoPpTtXxYyZz----------",
)
KEPT_IN_REDACTION = "-. /\\_\u2013\u2014\u00a0"
# End of fixed values.


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def plain_spaces(text: Column) -> Column:
    return F.translate(text, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))


def unleet(text: Column) -> Column:
    return F.translate(text, *LEET)


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (digits != "") & F.call_function("luhn_check", digits)


def shown(text: Column) -> Column:
    """A value as reports show it."""
    return F.when(F.length(text) > 8, F.concat(F.left(text, F.lit(3)), F.lit("..."), F.right(text, F.lit(3)))).otherwise("***")


def truncated(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def redacted(text: Column, mark: str = "X") -> Column:
    """Printable characters become the mark, separators stay, others go."""
    bare = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")  # what Python calls printable stays
    return F.regexp_replace(bare, r"[^-. /\\_–—]", mark)


def edm_value(text: Column) -> Column:
    """The form in which exact values are compared (compatibility forms are the caller's matter)."""
    return F.regexp_replace(F.trim(F.lower(text)), r"[\s\-./()]+", "")


def fragment_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC, from two nested digests over the padded key."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def glob(pattern: str) -> str:
    """A Java expression for a shell pattern over a whole string."""
    out = ""
    for c in pattern:
        out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c.isspace() else "\\" + c
    return f"(?s)^{out}$"


def entropy(content: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for none. Bytes are counted as characters of a one-byte encoding."""
    chars, n = F.decode(content, "ISO-8859-1"), F.octet_length(content)
    share = F.transform(F.array_remove(F.array_distinct(F.split(chars, "")), ""), lambda c: (n - F.length(F.replace(chars, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def entropy_suspicious(bits: Column, threshold: float = 7.5, high: Column | None = None) -> Column:
    """Whether the bits reach the threshold, or pass the format's upper bound by more than half a bit."""
    out = bits >= threshold
    return out if high is None else out | F.coalesce(bits > high + 0.5, F.lit(False))


def entropy_class(bits: Column, high: Column | None = None) -> Column:
    """high: the upper bound that the file's format lets one expect."""
    out = F.when(bits >= 7.9, "likely_encrypted").when(bits >= 7.5, "compressed_or_encrypted")
    if high is not None:
        out = out.when(bits > high, "suspicious_for_format")
    return out.when(bits >= 6.0, "moderately_random").otherwise("normal")
