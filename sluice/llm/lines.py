"""Line dedup across documents by two Bloom filters.

Pass one: every task hashes its documents' lines into a filter of keys seen once
and a filter of keys seen twice; task filters are merged by segment
(once = a|b, twice = ta|tb|(a&b)), so the merged second filter holds every key
that two documents share. Pass two: only keys that are in the second filter
shuffle, as 128-bit digests, for exact counts and the choice of the document
that keeps the line. The filters are sized by the bytes that the plan says it
reads, up to 2 ** MOST_BITS: beyond that more keys become suspects and are
sorted out exactly, the result is the same at any size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored

#: Bits of each filter: 2 ** LOG_BITS (2 MB) at least, 2 ** MOST_BITS (64 MB) at most; only the number of suspects depends on it.
LOG_BITS, MOST_BITS = 24, 29
#: Parts in which filters are merged.
SEGMENTS = 64
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines, and for each its key, or None where that is shorter than ``least`` code points."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys: list[bytes | None] = []
    for x in lines:
        k = x.strip(_SPACE).lower()
        keys.append(k if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least) else None)
    return lines, keys


def _spots(hashes: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each hash."""
    return (hashes >> np.uint64(64 - log_bits)).astype(np.int64), (hashes & np.uint64((1 << log_bits) - 1)).astype(np.int64)


def filter_bits(docs: DataFrame) -> int:
    """log2 of a filter's bits: one for every eight bytes that the plan reads, thus eight for a line of 64 bytes; a plan that does not know gets four times the least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return LOG_BITS + 2 if size >> 60 else min(MOST_BITS, max(LOG_BITS, (size // 8).bit_length()))


def _has(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bits[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1 == 1


def _set(bits: np.ndarray, spots: np.ndarray) -> None:
    if len(spots):
        spots = np.sort(spots)
        at = np.flatnonzero(np.append(True, spots[1:] >> 3 != spots[:-1] >> 3))
        bits[spots[at] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, 7 - (spots & 7)).astype(np.uint8), at)


class Filters:
    """The once-seen and twice-seen filters, as packed bits."""

    def __init__(self, log_bits: int):
        self.log_bits = log_bits
        self.once = np.zeros(1 << log_bits >> 3, np.uint8)
        self.twice = np.zeros(1 << log_bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """hashes: each key once for each document that holds it."""
        u, n = np.unique(hashes, return_counts=True)
        a, b = _spots(u, self.log_bits)
        again = (n > 1) | (_has(self.once, a) & _has(self.once, b))
        _set(self.twice, np.concatenate([a[again], b[again]]))
        _set(self.once, np.concatenate([a, b]))


def _filled(log_bits: int, least: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, any_row = Filters(log_bits), False
        for b in batches:
            hashes: list[int] = []
            for text in b.column(1):
                hashes += [xxhash.xxh64_intdigest(k) for k in {*line_keys(text.as_py(), least)[1]} - {None}]
            if hashes:
                any_row = True
                f.add(np.array(hashes, np.uint64))
        if any_row:
            pack = lambda x: [zlib.compress(p.tobytes(), 1) for p in np.split(x, SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(pack(f.once), pa.binary()), pa.array(pack(f.twice), pa.binary())], names=["segment", "once", "twice"])

    return fill


def _merge(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by segment; one filter part is held at a time."""
    now, once, twice = None, None, None
    for pdf in rows:
        for seg, o, t in zip(pdf["segment"], pdf["once"], pdf["twice"], strict=True):
            o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
            if seg != now:
                if now is not None:
                    yield pd.DataFrame({"segment": [now], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})
                now, once, twice = seg, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if now is not None:
        yield pd.DataFrame({"segment": [now], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def twice_seen(docs: DataFrame, least: int = 20, log_bits: int = LOG_BITS) -> np.ndarray:
    """The merged twice-seen filter as packed bits: 2 ** log_bits / 8 bytes, whatever the corpus holds.

    Filters are merged in two rounds, so that a segment's second round has at
    most as many parts as the first round's dealing.
    """
    schema = "segment int, once binary, twice binary"
    parts = docs.select("doc_id", "text").mapInArrow(frugal(_filled(log_bits, least)), schema).withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(32)))
    first = parts.repartition(F.col("segment"), F.col("deal")).sortWithinPartitions("segment").select("segment", "once", "twice").mapInPandas(frugal(_merge), schema)
    merged = first.repartition(F.col("segment")).sortWithinPartitions("segment").mapInPandas(frugal(_merge), schema)
    bits = np.zeros(1 << log_bits >> 3, np.uint8)
    each = len(bits) // SEGMENTS
    for r in merged.select("segment", "twice").toLocalIterator():
        bits[r[0] * each : (r[0] + 1) * each] = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint8)
    return bits


def repeated_lines(docs: DataFrame, least: int = 20, copies: int = 3, log_bits: int | None = None) -> DataFrame:
    """Confirmed keys and where they go: doc_id, keys (digests whose lines that document loses)."""
    spark, log_bits = docs.sparkSession, log_bits or filter_bits(docs)
    seen = spark.sparkContext.broadcast(twice_seen(docs, least, log_bits).tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(seen.value, np.uint8)
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = list({*line_keys(text.as_py(), least)[1]} - {None})
                keys += own
                ids += [doc] * len(own)
            if keys:
                x, y = _spots(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), log_bits)
                at = np.flatnonzero(_has(bits, x) & _has(bits, y))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([digest(keys[i]) for i in at], pa.binary())], names=["doc_id", "key"])

    found = stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frugal(suspects), "doc_id bigint, key binary"), "line-suspects")
    confirmed = stored(found.groupBy("key", "doc_id").agg(F.lit(1).alias("_")).groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= copies).select("key", "keeper"), "line-keys")
    lost = found.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, least: int = 20, copies: int = 3, log_bits: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined) and the columns ``also``, for every row of docs.

    Null and empty texts are one empty line. Rows that share a doc_id are one
    document and are treated alike; rows without a doc_id are no documents that
    count, and lose a line whose other holders suffice. The set of keys that a
    document loses is no larger than its own number of lines.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, lost in zip(b.column(1), b.column(2), strict=True):
                text, lost = text.as_py(), lost.as_py()
                if not lost:
                    kept, n = text or "", (text or "").count("\n") + 1
                    texts.append(kept)
                    n_lines.append(n)
                    n_dropped.append(0)
                    continue
                lines, keys = line_keys(text, least)
                gone = {*lost}
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or digest(k) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                texts.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string()), *[b.column(3 + k) for k in range(len(also))]], names=["doc_id", "n_lines", "n_dropped", "text", *also])

    own = docs.select(F.col("doc_id").cast("bigint"), "text", *also)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for c in also for f in own.schema.fields if f.name == c)
    lost = stored(repeated_lines(docs, least, copies, log_bits), "line-lost")
    both = own.alias("l").join(lost.hint("merge").alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left").select("l.doc_id", "l.text", "r.keys", *[f"l.{c}" for c in also])
    return both.mapInArrow(frugal(drop), "doc_id bigint, n_lines bigint, n_dropped bigint, text string" + more)
