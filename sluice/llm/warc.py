"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key into shards whose bounds follow from the data
alone (a histogram of payload bytes over equal key ranges), so a second run
writes the same bytes. Within a shard, files roll once they reach a compressed
size; every record is a gzip member of its own, with headers and digests
regenerated from its payload. A task writes under a name of its own attempt and
returns manifest rows; only the rows of attempts that Spark accepted reach the
manifest table, and the commit step renames exactly the files listed there
before it writes the final manifest. A lost executor leaves files that no
manifest names, which the commit removes.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

#: Compressed bytes at which a file is closed.
ROLL = 16 << 20
#: Payload bytes of a shard, about.
SHARD = 48 << 20
#: Ranges of the key histogram: at most so many rows reach the driver.
BINS = 16_384
#: Payloads of fewer bytes are never revisits.
LEAST = 1000

MANIFEST = "shard int, seq int, temp string, name string, records bigint, bytes bigint, sha256 string, first_key bigint, last_key bigint"
RECORD = "key bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def resolve_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """key, url, payload (binary), payload_bytes, payload_digest, refers_to.

    Of equal payloads of at least ``least`` bytes the largest key is the
    response (all rows that have that key, should it repeat); the others refer
    to it. A null payload is empty; null keys sort first and are never referred
    to while another holder has a key.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    recs = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    recs = recs.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    groups = recs.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("key").alias("top"))
    groups = stored(groups.where("n > 1").select("payload_digest", F.col("top").alias("top")), "warc-groups")
    # The copies' rows are matched without their payloads; AQE splits a digest that holds much of the table.
    refers = F.when(F.col("key").eqNullSafe(F.col("top")), F.lit(None).cast("bigint")).otherwise(F.col("top"))
    out = recs.alias("l").join(groups.alias("r"), (F.col("l.payload_digest") == F.col("r.payload_digest")) & (F.col("l.payload_bytes") >= least), "left")
    return out.select("l.key", "l.url", "l.payload", "l.payload_bytes", "l.payload_digest", refers.alias("refers_to"))


def shard_column(records: DataFrame, shard_bytes: int = SHARD) -> tuple[Column, int]:
    """The shard of a key as an expression, and the number of shards: ranges of the key with about equal bytes."""
    lo, hi = records.agg(F.min("key"), F.max("key")).first()
    if lo is None:
        return F.lit(0), 1
    width = max(1, -(-(hi - lo + 1) // BINS))
    bin_of = F.floor((F.col("key") - F.lit(lo)) / F.lit(width)).cast("int")
    sizes = records.where("key is not null").groupBy(bin_of.alias("bin")).agg(F.sum(F.col("payload_bytes") + 600).alias("size")).orderBy("bin").collect()
    bounds, filled = [], 0
    for b, n in sizes:
        if filled and filled + n > shard_bytes:
            bounds.append(lo + b * width)
            filled = 0
        filled += n
    if not bounds:
        return F.lit(0), 1
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in bounds]), lambda x: x <= F.col("key"))), F.lit(0)), len(bounds) + 1


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}')}>"


def warc_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = head if revisit else head + payload
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < "!" else c for c in url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        lines.append(f"X-Key: {key}")
    lines += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: {sha(payload)}", f"WARC-Block-Digest: {sha(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _writer(uri: str, roll: int, level: int, date: str):
    def write(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(f"{uri}/_temporary")
        store.create_dir(path, recursive=True)
        attempt, out, done, now = uuid.uuid4().hex, None, [], None

        def close() -> None:
            nonlocal out
            if out is not None:
                out["file"].close()
                done.append((now, out["seq"], out["temp"], f"part-{now:06d}-{out['seq']:05d}.warc.gz", out["n"], out["bytes"], out["sha"].hexdigest(), out["first"], out["last"]))
                out = None

        for pdf in pdfs:
            for shard, key, url, payload, refers, digest in zip(pdf["shard"], pdf["key"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["payload_digest"], strict=True):
                key, refers = None if pd.isna(key) else int(key), None if pd.isna(refers) else int(refers)
                if shard != now or out is not None and out["bytes"] >= roll:
                    seq = out["seq"] + 1 if shard == now and out is not None else 0
                    close()
                    now = int(shard)
                    temp = f"{attempt}-{now:06d}-{seq:05d}"
                    out = {"seq": seq, "temp": temp, "file": store.open_output_stream(f"{path}/{temp}", compression=None), "n": 0, "bytes": 0, "sha": hashlib.sha256(), "first": key, "last": key}
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(warc_record(key, url, bytes(payload), refers, digest, date)) + z.flush()
                out["file"].write(member)
                out["sha"].update(member)
                out["bytes"] += len(member)
                out["n"] += 1
                out["last"] = key
        close()
        if done:
            frame = pd.DataFrame(done, columns=[x.split()[0] for x in MANIFEST.split(", ")])
            yield frame.astype({"first_key": "Int64", "last_key": "Int64"})

    return write


def _commit(uri: str):
    def rename(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(uri)
        for pdf in pdfs:
            for temp, name in zip(pdf["temp"], pdf["name"], strict=True):
                # A retried task finds some files renamed already.
                if store.get_file_info(f"{path}/_temporary/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{path}/_temporary/{temp}", f"{path}/{name}")
            yield pdf

    return rename


def write_warc(records: DataFrame, uri: str, shard_bytes: int = SHARD, roll: int = ROLL, level: int = 5, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write records (as from resolve_revisits) under ``uri``; the manifest as a table.

    Files appear under their final names only once every shard is written;
    ``manifest.parquet`` and ``_COMMITTED.json`` come last. No records: no files,
    an empty manifest.
    """
    shard, shards = shard_column(records, shard_bytes)
    dealt = records.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "url", "payload_digest")
    spark = records.sparkSession
    dealt.mapInPandas(_writer(uri, roll, level, date), MANIFEST).write.parquet(f"{uri}/_temporary-manifest")
    listed = spark.read.schema(MANIFEST).parquet(f"{uri}/_temporary-manifest")
    listed.mapInPandas(_commit(uri), MANIFEST).write.parquet(f"{uri}/manifest.parquet")
    store, path = _store(uri)
    total = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest.parquet").agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    for gone in ("_temporary", "_temporary-manifest"):
        if store.get_file_info(f"{path}/{gone}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{gone}")
    with store.open_output_stream(f"{path}/_COMMITTED.json") as f:
        f.write(json.dumps({"files": total[0], "records": total[1], "bytes": total[2]}).encode())
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest.parquet")


def parse_warc(data: bytes) -> Iterator[tuple]:
    """(key, url, record_type, refers_to, payload_bytes, payload_digest, payload) of each record; digests are verified."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:] if at + (1 << 20) > len(data) else data[at : at + (1 << 20)])
        at += min(len(data) - at, 1 << 20) - len(z.unused_data)
        while not z.eof and at < len(data):
            piece = data[at : at + (1 << 20)]
            raw += z.decompress(piece)
            at += len(piece) - len(z.unused_data)
        yield _parsed(raw)


def _parsed(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(f["Content-Length"])]
    if f["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest of {f['WARC-Record-ID']} does not match")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, kind = base64.b32decode(f["WARC-Payload-Digest"].partition(":")[2]).hex(), f["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {f['WARC-Record-ID']} does not match")
    number = lambda k: int(f[k]) if k in f else None
    return number("X-Key"), f.get("WARC-Target-URI"), kind, number("X-Refers-To-Key"), int(f["X-Payload-Length"]), digest, payload if kind == "response" else None


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """All records of the committed files under ``uri``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")][: 7 if with_payload else 6]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for r in parse_warc(content.as_py()):
                    rows.append(r)
                    size += len(r[6] or b"")
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names=names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.warc.gz").load(uri)
    schema = RECORD if with_payload else RECORD.rpartition(",")[0]
    return files.select("content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages as an archive in the shared folder and read it back, without payloads."""
    uri = scratch(pages.sparkSession, "warc")
    write_warc(resolve_revisits(pages), uri, **options)
    return read_warc(pages.sparkSession, uri, with_payload=False)
