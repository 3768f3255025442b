"""Removal of repeated passages by a distributed, common-prefix-aware suffix sort.

Two lengths. Strings of ``length`` bytes that start again elsewhere are removed.
Shorter repeats, of ``passage`` bytes, come from the same sort and are only
counted, where they run over more than ``words`` words.

Which suffixes. A string of ``passage`` bytes holds windows of half as many; the
one of least hash is its anchor, and equal strings have their anchors at equal
places. So only suffixes at anchors are sorted, about one in sixty bytes, and of
those only anchors whose window occurs twice. A longer string has the anchor of
its first ``passage`` bytes.

Sort. A task sorts its suffixes (cut at ``length`` bytes) into runs, front-codes
them (common prefix with the suffix before, and the rest) and sends each run to
the partition of its window. There a loser tree merges the runs: every entry
carries its common prefix with the last output, entries with different prefixes
are decided by those numbers alone, and equal ones are compared from there on,
so that no known prefix is compared again.

Repeats. In the merged order, suffixes that share their first ``length - o``
bytes are neighbours. For each shift o, those that also share the o bytes to
their left, by a sort of the left sides, start the same string o bytes earlier:
it is removed in all of them.

Documents with equal bytes are one text; they repeat each other from end to end.
A window that more than ``HOT`` texts hold is settled by counting digests of its
strings instead, so no partition must hold an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, sized, stored

#: Suffixes of a sorted run, and of a merging partition, about.
RUN = 50_000
MERGE = 60_000
#: Texts that share a window beyond which its strings are counted by digest.
HOT = 40_000
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        inv = np.uint64(pow(int(_B), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_B, inv)]
    return _POWERS[0], _POWERS[1]


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill) -> np.ndarray:
    """op over every window of w values, by prefixes and suffixes of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    pre = op.accumulate(rows, axis=1).ravel()
    suf = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suf[: n - w + 1], pre[w - 1 : n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and window hashes of a text's anchors; none if it is shorter than ``length``."""
    n, k = len(text), length // 2
    if n < length:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        c = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * inverse[:n])])
        h = (c[k:] - c[:-k]) * power[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    w = length - k + 1
    least = _slide(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([pad, least, pad]), w, np.maximum, np.uint64(0)))
    return at.astype(np.int32), h[at].view(np.int64)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    while end - at > 1:
        mid = (at + end) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            end = mid
    return at


def merge(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Loser-tree merge of front-coded sorted runs, entries (prefix shared with the one before, rest).

    Yields (run, place in it, common prefix with the last output) in order.
    """
    k = len(runs)
    place, cur, lcp = [0] * k, [r[0][1] if r else None for r in runs], [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = cur[a], cur[b]
        if x is None:
            return b, a
        if y is None or lcp[a] > lcp[b]:
            return a, b
        if lcp[a] < lcp[b]:
            return b, a
        at = common(x, y, lcp[a])
        if x[at : at + 1] < y[at : at + 1] or at == len(x) and at == len(y) and a < b:
            lcp[b] = at
            return a, b
        lcp[a] = at
        return b, a

    losers = [0] * k
    won = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        won[node], losers[node] = play(won[2 * node], won[2 * node + 1])
    top = won[1] if k > 1 else 0
    while k and cur[top] is not None:
        yield top, place[top], lcp[top]
        place[top] += 1
        if place[top] < len(runs[top]):
            shared, rest = runs[top][place[top]]
            cur[top], lcp[top] = cur[top][:shared] + rest, shared
        else:
            cur[top] = None
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def front_code(sorted_suffixes: list[bytes]) -> list[tuple[int, bytes]]:
    out, last = [], b""
    for s in sorted_suffixes:
        n = common(last, s, 0)
        out.append((n, s[n:]))
        last = s
    return out


_RUNS = "target int, lcp binary, size binary, rest binary, left_size binary, left_bytes binary, digest binary, pos binary"


def _run_rows(length: int, k: int, targets: int):
    """Rows of texts (digest, text, pos) into front-coded sorted runs, one row for each run and target."""

    def flush(recs: list[tuple]) -> pa.RecordBatch:
        recs.sort()
        cols: list[list] = [[] for _ in range(8)]
        at = 0
        while at < len(recs):
            end = at
            while end < len(recs) and recs[end][0] == recs[at][0]:
                end += 1
            part = recs[at:end]
            coded = front_code([r[1] for r in part])
            row = (part[0][0], np.array([c[0] for c in coded], np.int32).tobytes(), np.array([len(c[1]) for c in coded], np.int32).tobytes(), b"".join(c[1] for c in coded), np.array([len(r[2]) for r in part], np.int32).tobytes(), b"".join(r[2] for r in part), b"".join(r[3] for r in part), np.array([r[4] for r in part], np.int32).tobytes())
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            at = end
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=[x.split()[0] for x in _RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs: list[tuple] = []
        for b in batches:
            for digest, text, pos in zip(b.column(0), b.column(1), b.column(2), strict=True):
                digest, data = digest.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                for a in pos.as_py():
                    recs.append((xxhash.xxh64_intdigest(data[a : a + k]) % targets, data[a : a + length], data[max(0, a - k) : a], digest, a))
                if len(recs) >= RUN:
                    yield flush(recs)
                    recs = []
        if recs:
            yield flush(recs)

    return run


def left_order(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and in it how many first bytes a row shares with the one before."""
    m, k = left.shape
    padded = np.zeros((m, -(-k // 8) * 8), np.uint8)
    padded[:, :k] = left
    order = np.lexsort(padded.view(">u8").T[::-1])
    rows = left[order]
    differ = rows[1:] != rows[:-1]
    return order, np.append(0, np.where(differ.any(1), differ.argmax(1), k))


def shared_starts(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, have: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of shifts (members, firsts, lasts) for which a string that starts that many bytes before the suffix occurs twice.

    lcp: with the suffix before, in sorted order; right: suffix lengths; left:
    bytes before each, nearest first; have: how many there are.
    """
    m, k = left.shape
    since = np.full(m, -1)
    order, shared = left_order(left)
    side = np.zeros(m, np.int64)
    for o in range(k + 1):
        side[order] = np.cumsum(shared < o)
        group = np.cumsum(lcp < length - o)
        ok = np.flatnonzero((have >= o) & (right >= length - o))
        twice = np.zeros(m, bool)
        if len(ok):
            g = group[ok]
            # Alone in its group: no partner.
            near = np.zeros(len(ok), bool)
            near[1:] |= g[1:] == g[:-1]
            near[:-1] |= g[1:] == g[:-1]
            ok, g = ok[near], g[near]
            key = g * (m + 1) + side[ok]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            hit = np.zeros(len(ok), bool)
            hit[1:] |= same
            hit[:-1] |= same
            twice[ok[by[hit]]] = True
        end = np.flatnonzero(~twice & (since >= 0))
        if len(end):
            yield end, since[end], np.full(len(end), o - 1)
        since[end] = -1
        since[twice & (since < 0)] = o
    end = np.flatnonzero(since >= 0)
    if len(end):
        yield end, since[end], np.full(len(end), k)


_SPANS = "digest binary, s int, e int, long boolean"


def _merged(length: int, passage: int):
    k = passage // 2

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, lefts, digests, places = [], [], [], []
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                lcp, size, left = (np.frombuffer(x, np.int32) for x in (r.lcp, r.size, r.left_size))
                ends, lends = np.cumsum(size), np.cumsum(left)
                rest, body = bytes(r.rest), bytes(r.left_bytes)
                runs.append([(int(n), rest[e - z : e]) for n, e, z in zip(lcp, ends, size, strict=True)])
                lefts.append([body[e - z : e] for e, z in zip(lends, left, strict=True)])
                digests.append(bytes(r.digest))
                places.append(np.frombuffer(r.pos, np.int32))
        if not runs:
            return
        total = sum(map(len, runs))
        lcps, right, have, pos = (np.zeros(total, np.int64) for _ in range(4))
        left, names, last = np.zeros((total, k), np.uint8), [], 0
        lengths = [np.zeros(len(r), np.int64) for r in runs]
        for q, r in enumerate(runs):
            lengths[q][:] = [n + len(x) for n, x in r]
        for i, (q, at, n) in enumerate(merge(runs)):
            before = lefts[q][at]
            lcps[i], right[i], have[i], pos[i] = n if i else 0, lengths[q][at], len(before), places[q][at]
            left[i, : len(before)] = np.frombuffer(before, np.uint8)[::-1]
            names.append(digests[q][20 * at : 20 * at + 20])
            last = i
        assert last == total - 1
        for size in sorted({length, passage}):
            parts = list(shared_starts(lcps, right, left, have, size))
            if parts:
                who, first, end = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"digest": [names[i] for i in who], "s": (pos[who] - end).astype(np.int32), "e": (pos[who] - first + size).astype(np.int32), "long": size == length})

    return run


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT, *, passage: int | None = None) -> DataFrame:
    """digest (SHA-1 of a text), s, e, long: byte ranges of strings that start again elsewhere among different texts or in the same one; long: of ``length`` bytes, else of ``passage`` (five eighths of it if not given). Ranges may overlap."""
    passage = min(passage or length * 5 // 8, length)
    k = passage // 2

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [anchors(t.as_py().encode("utf-8", "surrogatepass"), passage) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["digest", "pos", "hash"])

    texts = docs.where(F.octet_length("text") >= passage).select(F.unhex(F.sha1("text")).alias("digest"), "text")
    own = texts.mapInArrow(frugal(found), "digest binary, pos array<int>, hash array<bigint>")
    # A number for each text, given once and written: anchors are many, and a number is shorter than a digest.
    own = own.groupBy("digest").agg(F.first("pos").alias("pos"), F.first("hash").alias("hash")).withColumn("no", F.monotonically_increasing_id())
    own = stored(own, "anchors")
    each = own.select("no", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("no", "x.pos", "x.hash")
    twice = stored(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "anchor-hashes")
    places = each.join(twice, "hash").groupBy("no", (F.col("n") > hot).alias("hot")).agg(F.collect_list("pos").alias("pos"))
    cands = stored(places.join(own.select("no", "digest"), "no").select("digest", "hot", "pos"), "anchor-places")

    def with_text(places: DataFrame) -> DataFrame:
        some = texts.join(sized(places.select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
        return some.join(places, "digest").select("digest", "text", "pos")

    plain, full = cands.where("not hot").select("digest", "pos"), cands.where("hot").select("digest", "pos")
    n = plain.agg(F.sum(F.size("pos"))).first()[0] or 0
    targets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // MERGE))
    runs = with_text(plain).mapInArrow(frugal(_run_rows(length, k, targets)), _RUNS)
    spans = runs.repartitionById(targets, F.col("target")).mapInPandas(frugal(_merged(length, passage)), _SPANS)
    if full.isEmpty():
        return spans

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text, pos in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for size in {length, passage}:
                    starts = sorted({p for a in pos.as_py() for p in range(max(0, a - k), min(a, len(data) - size) + 1)})
                    for at in range(0, len(starts), 4096):
                        part = starts[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(data[p : p + size], digest_size=16).digest() for p in part], pa.binary()), pa.array([digest] * len(part), pa.binary()), pa.array(part, pa.int32()), pa.array([p + size for p in part], pa.int32()), pa.array([size == length] * len(part), pa.bool_())], names=["string", "digest", "s", "e", "long"])

    rows = stored(with_text(full).mapInArrow(frugal(strings), "string binary, digest binary, s int, e int, long boolean"), "strings")
    again = stored(rows.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"), "strings-again")
    return spans.unionAll(rows.join(again, "string").select("digest", "s", "e", "long"))


def _joined(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def whole_words(data: bytes, s: int, e: int) -> int:
    """Words of data that lie within s and e, not cut at either end."""
    cut = (s > 0 and not data[s - 1 : s].isspace() and not data[s : s + 1].isspace()) + (e < len(data) and not data[e - 1 : e].isspace() and not data[e : e + 1].isspace())
    return max(0, len(data[s:e].split()) - cut)


def remove_repeats(docs: DataFrame, length: int = 400, passage: int | None = None, words: int = 50) -> DataFrame:
    """For every row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), n_passages.

    Null text is empty. Rows with equal texts of ``length`` bytes or more (a
    repeated row too) lose all of it, as each string starts again in the other;
    shorter texts lose nothing. kept may split a character. n_passages counts
    the runs of more than ``words`` words, made of strings of ``passage`` bytes
    that start again elsewhere (five eighths of ``length`` if not given); nothing is
    removed for them.
    """
    passage = min(passage or length * 5 // 8, length)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.unhex(F.sha1("text"))
    copies = docs.where(F.octet_length("text") >= passage).groupBy(sha.alias("digest")).agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("copied"))
    spans = repeated_spans(docs, length, passage=passage).groupBy("digest").agg(F.collect_set(F.struct("s", "e", "long")).alias("spans"))
    lost = stored(copies.join(spans, "digest", "full_outer").select("digest", F.coalesce("copied", F.lit(False)).alias("copied"), "spans"), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept, n_passages = [], [], [], [], []
            for text, copied, spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                whole = [(0, len(data))] if copied else []
                runs = _joined(whole if len(data) >= length else ()) if copied else _joined((x["s"], x["e"]) for x in spans or () if x["long"])
                again = whole if copied else _joined((x["s"], x["e"]) for x in spans or ())
                edges = [0, *[y for x in runs for y in x], len(data)]
                stay = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(stay))
                n_spans.append(len(runs))
                kept.append(stay)
                n_passages.append(sum(whole_words(data, s, e) > words for s, e in again))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary()), pa.array(n_passages, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages"])

    both = docs.withColumn("digest", sha).join(lost, "digest", "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "copied", "spans")
    return both.mapInArrow(frugal(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_passages bigint")
