"""SimHash near-dedup with bit-sliced comparison.

A bucket of fingerprints is stored vertically: plane b holds bit b of all
members, 64 members to a word. One XOR of a plane with a query's bit yields one
differing bit for 64 members at once; carry-save counters (one word per binary
digit) add it to 64 distances, and words whose members have all passed the
radius are abandoned.

Buckets. For an exact radius r = 2, a pair agrees on one of three blocks of the
64 bits, and again on one of three parts of what is left: nine keys of about 36
bits. A bucket with more than ``HOT`` members is cut twice more in the same way,
after which at most 14 bits are free: distinct fingerprints then fill at most
16,384 places, so no bucket is unbounded, and no link is lost on the way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, sized, stored
from .components import components

#: Members of a bucket beyond which it is cut further.
HOT = 4096
#: Queries compared with a bucket's planes at a time.
CHUNK = 256


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    s, h = b" ".join, xxhash.xxh64_intdigest
    return np.fromiter((h(s(w[i : i + size]), 42) for i in range(len(w) - size + 1)), np.uint64, len(w) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frugal(run), "doc_id bigint, fp bigint")


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def block_masks(levels: int) -> list[int]:
    """Masks of bits held equal: three for each level, nested; a pair within two bits agrees on one of them whole."""
    out = [(0, list(range(64)))]
    for _ in range(levels):
        out = [(mask | sum(1 << b for b in part), [b for b in rest if b not in part]) for mask, rest in out for part in _thirds(rest)]
    return [mask for mask, _ in out]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compare(fps: np.ndarray, radius: int, bits: list[int] | None = None, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance) of a bucket with i != j and distance <= radius, chunk of queries by chunk.

    bits: the planes that can differ; asked: the members i, all if not given. Each distance is counted in carry-save
    form, saturating in ``over`` once it passes what the digits hold.
    """
    m, words = len(fps), -(-len(fps) // 64)
    bits = list(range(64)) if bits is None else bits
    padded = np.zeros(words * 64, np.uint64)
    padded[:m] = fps
    planes = _planes(padded, bits)
    digits = max(1, radius.bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = np.arange(m) if asked is None else asked
    for at in range(0, len(asked), CHUNK):
        q = fps[asked[at : at + CHUNK]]
        live = np.arange(words)
        count = np.zeros((digits, len(q), words), np.uint64)
        over = np.zeros((len(q), words), np.uint64)
        for k, b in enumerate(bits):
            flip = np.where((q >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None]
            carry = planes[k][live][None, :] ^ flip
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
            if k % 8 == 7 and len(live) > 1:
                past = _past(count, over, radius)
                keep = np.flatnonzero((past != full).any(0))
                if len(keep) < len(live):
                    live, count, over = live[keep], np.ascontiguousarray(count[:, :, keep]), np.ascontiguousarray(over[:, keep])
                    if not len(live):
                        break
        if not len(live):
            continue
        near = np.ascontiguousarray(~_past(count, over, radius))
        i, w = np.nonzero(near)
        if not len(i):
            continue
        hit = np.unpackbits(near[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(hit)
        dist = sum((((count[d][i[r], w[r]] >> c.astype(np.uint64)) & np.uint64(1)) << np.uint64(d)) for d in range(digits)).astype(np.int64)
        i, j = asked[i[r] + at], live[w[r]] * 64 + c
        ok = (j < m) & (i != j)
        if ok.any():
            yield i[ok], j[ok], dist[ok]


def compare_words(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance) with j < i and distance <= radius within buckets of at most 64 members, which stand one after another.

    Each bucket is one word of the planes, and every member is held against its own bucket's word only, all buckets at
    once; members whose word has wholly passed the radius are abandoned.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    slot = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.zeros(len(sizes) * 64, np.uint64)
    padded[word * 64 + slot] = fps
    planes = _planes(padded, list(range(64)))
    digits = max(1, radius.bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(fps))
    count = np.zeros((digits, len(fps)), np.uint64)
    over = ~((np.uint64(1) << slot.astype(np.uint64)) - np.uint64(1))  # only members before one's own are asked for
    for b in range(64):
        carry = planes[b][word[live]] ^ np.where((fps[live] >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b % 8 == 7:
            keep = np.flatnonzero(_past(count, over, radius) != full)
            if len(keep) < len(live):
                live, count, over = live[keep], np.ascontiguousarray(count[:, keep]), over[keep]
    hit = np.unpackbits((~_past(count, over, radius)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(hit)
    dist = sum((((count[d][r] >> c.astype(np.uint64)) & np.uint64(1)) << np.uint64(d)) for d in range(digits)).astype(np.int64)
    i = live[r]
    return i, i - slot[i] + c, dist


def _planes(padded: np.ndarray, bits: list[int]) -> np.ndarray:
    """A row for each bit, with a word for each 64 members."""
    rows = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in bits]
    return np.stack(rows) if rows else np.zeros((0, len(padded) // 64), np.uint64)


def _past(count: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of members whose count is greater than the radius."""
    more, equal = over.copy(), ~over
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            equal &= count[d]
        else:
            more |= equal & count[d]
            equal &= ~count[d]
    return more


def forest(fps: np.ndarray, radius: int, bits: list[int]) -> np.ndarray:
    """For each member of a bucket the first member of its class (linked within the radius, directly or on)."""
    m = len(fps)
    label = np.arange(m)
    if m == 2:
        return np.array([0, 0 if int(fps[0] ^ fps[1]).bit_count() <= radius else 1])
    for i, j, _ in compare(fps, radius, bits):
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while ((up := label[label]) != label).any():
                label = up
    while ((up := label[label]) != label).any():
        label = up
    return label


def buckets(pdfs: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole buckets of two or more rows, from batches that come sorted by the keys; batches are joined at their ends."""
    rest = None
    for pdf in pdfs:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        rest = pdf[last]
        yield pdf[~last]
    if rest is not None:
        yield rest


def _linked(radius: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in buckets(pdfs, ["mask", "part"]):
            if len(pdf) < 2:
                continue
            mask, part = pdf["mask"].to_numpy(), pdf["part"].to_numpy()
            fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(pdf))
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                if e - s > 1:
                    fixed = int(mask[s])
                    label = forest(fp[s:e], radius, [x for x in range(64) if not fixed >> x & 1])
                    tied = np.flatnonzero(label != np.arange(e - s))
                    a.append(rep[s:e][tied])
                    b.append(rep[s:e][label[tied]])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Spanning links (a, b) between representatives of distinct fingerprints within the radius (at most 2).

    distinct: fp, rep. No bucket's pairs are written out: a bucket yields one
    row for each member but the first of its class.
    """
    if radius > 2:
        raise ValueError("three blocks find pairs within two bits")

    def keyed(df: DataFrame, levels: int) -> DataFrame:
        masks = F.array(*[F.lit(_signed(m)) for m in block_masks(levels)])
        return df.select("fp", "rep", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))

    near = keyed(distinct, 2)
    size = stored(near.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    large = size.where(F.col("n") > hot)
    shared = near.join(size.where(F.col("n") <= hot).select("mask", "part"), ["mask", "part"])
    deep = keyed(near.join(large.select("mask", "part"), ["mask", "part"], "left_semi").select("fp", "rep").distinct(), 4)
    shared = shared.select("mask", "part", "fp", "rep").unionAll(deep.select("mask", "part", "fp", "rep"))
    dealt = shared.repartition(F.col("mask"), F.col("part")).sortWithinPartitions("mask", "part", "rep")
    return dealt.mapInPandas(frugal(_linked(radius)), "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component (smallest doc_id reachable over fingerprints that differ in at most ``radius`` bits).

    A null text has no words and fingerprint zero; equal fingerprints are
    linked. Rows without a doc_id link like any other, so that they can bridge
    two documents, but count in no class's smallest id; a class of such rows
    alone has none.
    """
    own = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    rooted = stored(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "fingerprint-roots")
    classes = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    return own.join(classes, "fp").select("doc_id", "fp", "component")


# Groups of similar documents: word shingles and a similarity, where fingerprints alone are too coarse.

#: Bands and values of each band: a pair of Jaccard similarity 0.8 shares one with probability 0.9998.
BANDS, ROWS = 12, 3
#: Differing bits up to which a member's nearest are sought before the rest of its bucket; no pair is dropped by it.
NEAR_BITS = 20
#: Members of a block of an open bucket; a task holds two blocks at a time.
BLOCK = 512
_SIGNED = "doc_id bigint, th bigint, sig binary, fp bigint, bands array<bigint>"


@functools.cache
def _multipliers() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"row %d" % i) | 1 for i in range(BANDS * ROWS)], np.uint64)


def signature(hashes: np.ndarray) -> tuple[bytes, int, list[int]]:
    """Of a text's shingle hashes: digest of their set, fingerprint of the set, band keys."""
    own = np.unique(hashes)
    fp = fingerprint(own)
    if not len(own):
        return b"", fp, []
    with np.errstate(over="ignore"):
        parts = [(own[None, at : at + 16384] * _multipliers()[:, None]).min(1) for at in range(0, len(own), 16384)]
        least = np.minimum.reduce(parts).reshape(BANDS, ROWS)
    return xxhash.xxh3_128_digest(own.tobytes()), fp, [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(least)]


def _nearest(radius: int, most: int):
    """For each member of a bucket its ``most`` nearest members of smaller id within the radius: (a, b, d)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in buckets(pdfs, ["band", "part"]):
            if len(pdf) < 2:
                continue
            band, part = pdf["band"].to_numpy(), pdf["part"].to_numpy()
            fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
            cut = np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1
            out = []
            starts, ends = np.append(0, cut), np.append(cut, len(pdf))
            sizes = ends - starts
            few = (sizes > 1) & (sizes <= 64)
            if few.any():
                at = np.flatnonzero(np.repeat(few, sizes))
                i, j, d = compare_words(fp[at], sizes[few], radius)
                order = np.lexsort((j, d, i))
                i, j, d = i[order], j[order], d[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < most
                out.append((rep[at][i[best]], rep[at][j[best]], d[best]))
            for s, e in zip(starts[sizes > 64], ends[sizes > 64], strict=True):
                # A member with enough neighbours within a smaller radius needs no larger one: its nearest are among them.
                left = np.arange(e - s)
                for near in (*[r for r in (2, 5, 9, 14) if r < radius], radius):
                    done = []
                    for i, j, d in compare(fp[s:e], near, None, left):
                        ok = j < i  # members come sorted by id
                        i, j, d = i[ok], j[ok], d[ok]
                        order = np.lexsort((j, d, i))
                        i, j, d = i[order], j[order], d[order]
                        rank = np.arange(len(i)) - np.searchsorted(i, i)
                        best = (rank < most) & ((near == radius) | np.isin(i, i[rank == most - 1]))
                        out.append((rep[s:e][i[best]], rep[s:e][j[best]], d[best]))
                        done.append(i[rank == most - 1])
                    left = np.setdiff1d(left, np.concatenate(done)) if done else left
            if out:
                a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b, "d": d})

    return run


def open_links(component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join components of a bucket wherever sets of two of them are as similar; a forest, not all pairs.

    Each member is held against all that lie outside its component as grown so far; those within are linked already.
    With two sides, only members of different sides are held against each other.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.append(0, np.cumsum(sizes))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, bool)
    _, own = np.unique(component, return_inverse=True)
    order, ends = np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))
    groups = np.split(order, ends[:-1])
    outside = np.ones(len(sets), bool)
    two = side.any()
    out = []
    for g in sorted(groups, key=len):  # the largest is last, when hardly any is left outside
        if not outside[g[0]]:
            continue
        outside[g] = False
        queue = list(g)
        while queue:
            i = queue.pop()
            ok = outside & (sizes >= similarity * sizes[i]) & (sizes[i] >= similarity * sizes)
            if two:
                ok &= side != side[i]
            j = np.flatnonzero(ok)
            if not len(j):
                continue
            mark[ids[starts[i] : starts[i + 1]]] = True
            held = mark[np.concatenate([ids[starts[k] : starts[k + 1]] for k in j])]
            mark[ids[starts[i] : starts[i + 1]]] = False
            both = np.add.reduceat(held, np.append(0, np.cumsum(sizes[j])[:-1]), dtype=np.int64)
            for k in j[both >= similarity * (sizes[i] + sizes[j] - both)]:
                if outside[k]:
                    out.append((i, k))
                    outside[groups[own[k]]] = False
                    queue.extend(groups[own[k]])
    return out


def _opened(similarity: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in buckets(pdfs, ["band", "part", "x", "y"]):
            if len(pdf) < 2:
                continue
            key = pdf[["band", "part", "x", "y"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            rep, component, side = (pdf[c].to_numpy() for c in ("rep", "component", "side"))
            a, b = [], []
            for s, e in zip(np.append(0, cut), np.append(cut, len(pdf)), strict=True):
                if e - s > 1 and (component[s:e] != component[s]).any():
                    sets = [np.frombuffer(x, np.uint32) for x in pdf["set"].iloc[s:e]]
                    for i, j in open_links(component[s:e], side[s:e], sets, similarity):
                        a.append(rep[s + i])
                        b.append(rep[s + j])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return run


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """band, part, x, y, side, rep, component: members of buckets with several components, dealt by pairs of blocks.

    A component of more than ``block`` members has blocks of its own, which are not paired with each other; the others
    share blocks. Every two members of a bucket in different components meet in a pair of blocks (x, y).
    """
    each = stored(placed.groupBy("band", "part", "component").agg(F.count("*").alias("m")), "bucket-components")
    large = F.col("m") > block
    number = F.ceil(F.col("m") / block).cast("int")
    few = F.ceil(F.coalesce(F.sum(F.when(~large, F.col("m"))), F.lit(0)) / block).cast("int").alias("few")
    by = each.groupBy("band", "part").agg(F.count("*").alias("components"), few, F.collect_list(F.when(large, F.struct("component", number.alias("n")))).alias("large")).where("components > 1")
    own = "transform(filter(sequence(0, few), k -> k < few), k -> named_struct('own', false, 'of', 0L, 'k', k))"
    theirs = "flatten(transform(large, l -> transform(sequence(0, l.n - 1), k -> named_struct('own', true, 'of', l.component, 'k', k))))"
    by = stored(by.select("band", "part", "few", F.expr(f"concat({own}, {theirs})").alias("blocks")), "open-buckets")
    rows = placed.join(each, ["band", "part", "component"]).join(by, ["band", "part"])
    mine = F.struct(large.alias("own"), F.when(large, F.col("component")).otherwise(F.lit(0)).cast("bigint").alias("of"), F.pmod(F.xxhash64("rep"), F.when(large, number).otherwise(F.col("few"))).cast("int").alias("k"))
    rows = rows.withColumn("mine", mine).withColumn("at", F.expr("cast(array_position(blocks, mine) - 1 as int)"))
    rows = rows.select("band", "part", "rep", "component", "mine", "at", F.posexplode("blocks").alias("to", "other"))
    rows = rows.where(~(F.col("mine.own") & F.col("other.own") & (F.col("mine.of") == F.col("other.of"))))
    return rows.select("band", "part", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), (F.col("at") > F.col("to")).cast("int").alias("side"), "rep", "component")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = NEAR_BITS, hot: int = 4 * HOT, most: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, th (xxhash64 of the text), component: documents of one group are linked by Jaccard similarity of word shingles.

    Equal shingle sets are one member. Members that share a band are candidates.
    First each is held, shingle by shingle, against its ``most`` nearest by
    fingerprint of smaller id, which links most groups. Then each bucket that
    still holds several components is gone through whole: every two members of
    different components are held against each other, unless links found there
    have joined them. For the nearest, buckets of more than ``hot`` different
    sets are cut into pieces, other ones in each band; the second pass takes
    them uncut, so the cut loses no pair. Texts without words are one group. A
    null doc_id never leads a group that has another.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [signature(shingle_hashes(t.as_py(), size)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.binary()), pa.array(np.array([g[1] for g in got], np.uint64).view(np.int64)), pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["doc_id", "th", "sig", "fp", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique((shingle_hashes(t.as_py(), size) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["rep", "set"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    own = stored(rows.mapInArrow(frugal(signed), _SIGNED), "signatures")
    members = stored(own.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "members")

    def shingled(ends: DataFrame) -> DataFrame:
        """rep, set of the members named in ends (rep)."""
        ends = stored(ends.distinct(), "near-ends")
        chosen = own.join(ends, F.col("doc_id") == F.col("rep")).join(members.select("sig", F.col("rep").alias("of")), "sig").where("of = rep").select("rep", "th").distinct()
        texts = rows.join(sized(stored(chosen, "near-texts")).alias("c"), (F.col("doc_id") == F.col("rep")) & (rows["th"] == F.col("c.th"))).dropDuplicates(["rep"]).select("rep", "text")
        return stored(texts.mapInArrow(frugal(sets), "rep bigint, set binary"), "near-sets")

    each = members.where("rep is not null").select("rep", "fp", "bands", F.posexplode("bands").alias("band", "part"))
    counts = stored(each.groupBy("band", "part").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    plain = each.join(counts.where(F.col("n") <= hot), ["band", "part"]).select("band", "part", "rep", "fp")
    piece = F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("n") / hot))
    cut = each.join(counts.where(F.col("n") > hot), ["band", "part"]).select((F.col("band") + BANDS).alias("band"), F.xxhash64("part", piece).alias("part"), "rep", "fp")
    dealt = plain.unionAll(cut).repartition(F.col("band"), F.col("part")).sortWithinPartitions("band", "part", "rep")
    near = dealt.mapInPandas(frugal(_nearest(radius, most)), "a bigint, b bigint, d bigint")
    near = near.groupBy("a", "b").agg(F.min("d").alias("d")).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, most).alias("x"))
    pairs = stored(near.select("a", F.explode("x").alias("x")).select("a", "x.b"), "near-pairs")
    shingles = shingled(pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    both = pairs.join(shingles.select(F.col("rep").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(shingles.select(F.col("rep").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    found = stored(components(stored(both.select("a", "b", "x", "y").mapInArrow(frugal(verified), "a bigint, b bigint"), "near-links")), "near-components")
    # Buckets that hold several components yet: the rest of their candidates.
    placed = each.join(counts, ["band", "part"]).select("band", "part", "rep").join(found, F.col("rep") == F.col("node"), "left").select("band", "part", "rep", F.coalesce("component", "rep").alias("component"))
    left = stored(_blocks(placed, block), "open-members")
    shingles = shingled(left.select("rep"))
    left = left.join(shingles.hint("merge"), "rep").repartition(F.col("band"), F.col("part"), F.col("x"), F.col("y")).sortWithinPartitions("band", "part", "x", "y", "rep")
    more = stored(left.mapInPandas(frugal(_opened(similarity)), "a bigint, b bigint").distinct(), "open-links")
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    classes = stored(members.join(found, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("component")), "near-classes")
    return own.join(classes, "sig").select("doc_id", "th", "component")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of similar_groups: that of smallest doc_id; of equal rows one. All columns stay."""
    groups = similar_groups(docs, **options)
    gone = stored(groups.where(~F.col("doc_id").eqNullSafe(F.col("component"))).select("doc_id", "th").distinct(), "copies")
    left = docs.withColumn("_th", F.xxhash64("text")).alias("l").join(sized(gone).alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._th") == F.col("r.th")), "left_anti")
    # Rows left with an id twice: equal rows, or other texts under the same id, which are no copies.
    twice = stored(left.groupBy("doc_id", "_th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "_th"), "rows-twice")
    if twice.isEmpty():
        return left.drop("_th")
    same = F.col("l.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("l._th") == F.col("t._th"))
    more = left.alias("l").join(sized(twice).alias("t"), same, "left_semi").dropDuplicates(["doc_id", "_th"])
    return left.alias("l").join(sized(twice).alias("t"), same, "left_anti").unionByName(more).drop("_th")
