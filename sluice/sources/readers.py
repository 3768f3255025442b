"""Sources: rows and files to (doc_id, text)."""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits and names.
SNIFF, MAX_DEPTH, MAX_TOTAL, MAX_FILE = 8192, 5, 500 << 20, 100 << 20
SKIP_DIRS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build")
HIDDEN_HEADERS = ("authorization", "cookie", "set-cookie")
# End of fixed values.

FILES = "path string, modificationTime timestamp, length bigint, content binary"
EXTRACTED = "path string, item string, depth int, format string, text string, error string"


def texts(spark: SparkSession, values: list[str], ids: list[str] | None = None) -> DataFrame:
    if ids is not None and len(ids) != len(values):
        raise ValueError("as many ids as texts are needed")
    return spark.createDataFrame([(ids[i] if ids else str(i), t) for i, t in enumerate(values)], "doc_id string, text string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as rows, without directories that hold no documents."""
    df = spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(path)
    return df.where(~F.col("path").rlike("/(?:" + "|".join(map(re.escape, SKIP_DIRS)) + ")/"))


def is_binary(content: str = "content") -> Column:
    """A NUL within the first bytes."""
    return F.locate("\0", F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1")) > 0


def text_columns(df: DataFrame, columns: list[str] | None = None, prefix: str = "row", first: int = 1) -> DataFrame:
    """doc_id (prefix:N in the frame's order), text: the non-empty strings of a row joined by spaces."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    joined = F.concat_ws(" ", *[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names])
    # Numbering needs one order over all rows; unordered_text_columns() does without.
    n = F.row_number().over(W.orderBy(F.monotonically_increasing_id()))
    return df.select(joined.alias("text"), n.alias("n")).select(F.concat(F.lit(prefix + ":"), (F.col("n") - 1 + first).cast("string")).alias("doc_id"), "text")


def unordered_text_columns(df: DataFrame, key: Column, columns: list[str] | None = None) -> DataFrame:
    """As text_columns, with a key of the caller's: no numbering, so nothing is brought to one task."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(key.alias("doc_id"), F.concat_ws(" ", *[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names]).alias("text"))


def csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Ids are the path and the row's number from 1."""
    return text_columns(spark.read.csv(path, header=True, multiLine=True), columns, f"{path}:row")


def json_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An array, an object or lines; lines that are no JSON are left out."""
    lines = spark.read.text(path, wholetext=True)

    def parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for whole in pdf["value"]:
                try:
                    got = json.loads(whole)
                    got = got if isinstance(got, list) else [got]
                except ValueError:
                    got = []
                    for line in whole.splitlines():
                        try:
                            got.append(json.loads(line))
                        except ValueError:
                            continue
                rows = [(i, " ".join(v for k, v in r.items() if isinstance(v, str) and v and (columns is None or k in columns))) for i, r in enumerate(got) if isinstance(r, dict)]
                yield pd.DataFrame(rows, columns=["n", "text"])

    return lines.mapInPandas(parse, "n bigint, text string").select(F.concat(F.lit(f"{path}:record:"), F.col("n").cast("string")).alias("doc_id"), "text")


def query(spark: SparkSession, sql: str, url: str | None = None, **options) -> DataFrame:
    """Rows of a SELECT, of the session's tables or over JDBC."""
    if not re.match(r"(?is)^[\s(]*(?:select|with)\b", sql):
        raise ValueError("only SELECT is run")
    df = spark.sql(sql) if url is None else spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    cast = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return text_columns(cast, None, "db:row")


def added_lines(diff: DataFrame) -> DataFrame:
    """file, line, text of lines that a unified diff adds. diff: n (order), value (line of the diff)."""
    w = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    named = diff.withColumn("file", F.last(F.when(F.col("value").startswith("+++ b/"), F.substring("value", 7, 1 << 20)), True).over(w))
    start = F.regexp_extract("value", r"^@@ -\S+ \+(\d+)", 1)
    named = named.withColumn("hunk", F.last(F.when(start != "", F.col("n")), True).over(w)).withColumn("first", F.last(F.when(start != "", start.cast("int")), True).over(w))
    body = named.where(F.col("hunk").isNotNull() & (F.col("n") > F.col("hunk")) & ~F.col("value").rlike(r"^(?:\+\+\+|---|diff|index) "))
    inner = W.partitionBy("hunk").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("first") + F.coalesce(F.sum(F.when(F.col("value").startswith("-"), 0).otherwise(1)).over(inner), F.lit(0))
    return body.withColumn("line", at.cast("int")).where(F.col("value").startswith("+")).select("file", "line", F.substring("value", 2, 1 << 20).alias("text"))


def payload_text(value: object, depth: int = 64) -> str:
    """All strings in a JSON value, joined by newlines."""
    if depth < 0:
        return ""
    if isinstance(value, str):
        return value
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return "\n".join(t for t in (payload_text(v, depth - 1) for v in inner) if t)


def header_text(headers: str = "headers") -> Column:
    """Values of a map of headers, but for those that carry credentials by design."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*HIDDEN_HEADERS))
    return F.array_join(F.map_values(kept), "\n")


# Extraction of text from formats.


def rtf_text(data: bytes) -> str:
    out, stack, skip = [], [], False
    s = data.decode("latin-1")
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-zA-Z]+)(-?\d*) ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)", s):
        hexed, uni, word, _, sym, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sym == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"):
            skip = True
        elif skip:
            continue
        elif hexed:
            out.append(bytes.fromhex(hexed).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif sym in ("\\", "{", "}"):
            out.append(sym)
        elif text:
            out.append(text)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def eml_text(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    parts = [f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if m[h]]
    for p in m.walk():
        if p.get_content_type() == "text/plain":
            parts.append(p.get_content())
        elif p.get_content_type() == "text/html":
            parts.append(re.sub(r"<[^>]+>", " ", p.get_content()))
    return "\n".join(parts)


def _xml_text(data: bytes, paragraph: str, text: str) -> list[str]:
    root = ElementTree.fromstring(data)
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + text)) for p in root.iter() if p.tag.endswith("}" + paragraph)]


def office_text(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    if "word/document.xml" in names:
        return "\n".join(_xml_text(z.read("word/document.xml"), "p", "t"))
    if any(n.startswith("ppt/slides/slide") for n in names):
        return "\n".join(t for n in sorted(names) if re.match(r"ppt/slides/slide\d+\.xml", n) for t in _xml_text(z.read(n), "p", "t"))
    shared = _xml_text(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in names else []
    rows = []
    for n in sorted(names):
        if re.match(r"xl/worksheets/sheet\d+\.xml", n):
            for r in ElementTree.fromstring(z.read(n)).iter():
                if r.tag.endswith("}row"):
                    cells = []
                    for c in r:
                        v = next((x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t"))), "")
                        cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                    rows.append("\t".join(cells))
    return "\n".join(rows)


def sniff(name: str, data: bytes) -> str:
    """A format's name by extension, else by first bytes."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    head = data[:512]
    if ext in ("pdf", "rtf", "eml", "docx", "xlsx", "pptx", "doc", "xls", "ppt", "msg"):
        return ext
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if head.startswith(b"PK"):
        return "docx" if b"word/" in head else "xlsx" if b"xl/" in head else "pptx" if b"ppt/" in head else "zip"
    if head.startswith(b"\x1f\x8b"):
        return "gz"
    if head[257:262] == b"ustar":
        return "tar"
    return "text"


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"text": lambda b: b.decode("utf-8", "replace"), "rtf": rtf_text, "eml": eml_text, "docx": office_text, "xlsx": office_text, "pptx": office_text}


def unpacked(name: str, data: bytes, depth: int = 0, budget: list[int] | None = None) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(item, depth, data, error) of a file and what is packed in it, within limits of depth and size."""
    budget = budget if budget is not None else [MAX_TOTAL]
    kind = sniff(name, data)
    if depth >= MAX_DEPTH or kind not in ("zip", "gz", "tar"):
        yield name, depth, data, None
        return
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    if i.file_size > budget[0]:
                        yield i.filename.rpartition("/")[2], depth + 1, None, "declared size exceeds the limit"
                        continue
                    budget[0] -= i.file_size
                    yield from unpacked(i.filename.rpartition("/")[2], z.read(i), depth + 1, budget)
        elif kind == "gz":
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
                inner = g.read(budget[0] + 1)
            if len(inner) > budget[0]:
                yield name.removesuffix(".gz"), depth + 1, None, "size exceeds the limit"
                return
            budget[0] -= len(inner)
            yield from unpacked(name.removesuffix(".gz"), inner, depth + 1, budget)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    base = m.name.rpartition("/")[2]
                    if m.isfile() and not base.startswith(".") and m.size <= budget[0]:
                        budget[0] -= m.size
                        yield from unpacked(base, t.extractfile(m).read(), depth + 1, budget)
    except (OSError, ValueError, EOFError, zipfile.BadZipFile, tarfile.TarError) as e:
        yield name, depth, None, str(e)


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files (path, content) to EXTRACTED rows; what cannot be read has an error instead of a text."""
    known = {**EXTRACTORS, **(extractors or {})}

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                content = bytes(content or b"")
                if len(content) > MAX_FILE:
                    rows.append((path, path.rpartition("/")[2], 0, None, None, "file exceeds the limit"))
                    continue
                for item, depth, data, error in unpacked(path.rpartition("/")[2], content):
                    kind = sniff(item, data) if data is not None else None
                    text = None
                    if data is not None:
                        try:
                            text = known[kind](data)
                        except KeyError:
                            error = f"no extractor for {kind} is installed"
                        except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                            error = f"{type(e).__name__}: {e}"
                    rows.append((path, item, depth, kind, text, error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EXTRACTED.split(", ")])

    return files.select("path", "content").mapInPandas(run, EXTRACTED)
