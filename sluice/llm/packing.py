"""Best-fit packing of token pieces into sequences, finished by a swap-based local search.

Documents are tokenized on the executors, only over-long ones are cut, and the
pieces are dealt by a hash into groups of about ``GROUP`` pieces. Each group is
packed by best fit (longest first), then a local search over the bins that are
not full moves documents, exchanges one for one, and exchanges two for one.
Every accepted step shifts tokens from an emptier bin to a fuller one, so the
sum of squared fills rises strictly and the search ends; bins that become empty
go. A group's size is bounded whatever the corpus holds, so no task grows with
it, and what the split into groups can cost is less than one bin a group.
"""

from __future__ import annotations

import bisect
import functools
import json
import operator
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored

#: Pieces in a packing group, about.
GROUP = 65_536
#: Repeated words whose ids a task remembers, some 200 bytes each, and bytes of text that it tokenizes at a time.
WORDS, CHUNK = 100_000, 4 << 20

_id = operator.attrgetter("id")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Letters whose lower case and composition are beyond doubt, then marks that never join them.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?()%*#$&|+=/-]*)")
#: The normalizer and the pre-tokenizer by whose rules a text's ids are those of its words in turn, and a word's those of its lower-cased letters, then of its marks.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's description has the rules that WordIds builds upon; its added tokens are kept apart by their marks."""
    rules = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and (spec["pre_tokenizer"] or {}).get("pretokenizers") == _SPLIT
    apart = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and re.fullmatch(r"<\|\w+\|>", x["content"], re.ASCII) for x in spec["added_tokens"])
    return rules and apart and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and spec["truncation"] is None


@functools.cache
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = sorted({*range(256)} - shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@functools.cache
def _tokenizer(path: str):
    """The tokenizer and whether it goes by words; one for each worker process."""
    # A task has one core; the library's own threads would only spin.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return found, by_words(json.loads(found.to_str()))


class WordIds:
    """Ids of texts, by way of their distinct words.

    Texts are split at ASCII white space and their words numbered by Arrow, so
    that only a chunk's distinct words are tokenized; numpy lays the ids of the
    words out as texts again. Words found twice in a chunk are remembered, at
    most ``WORDS``, until the task ends. A tokenizer of other rules gets whole
    texts.
    """

    def __init__(self, path: str):
        self.tokenizer, self.by_words = _tokenizer(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def run(self, letters: str) -> bytes:
        """Ids of one run of lower-case letters or of marks."""
        return array("I", map(_id, self.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(byte_letters())))).tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        out, other = [], []
        for w in words:
            if w.isascii() and w.isalpha():
                out.append(self.run(w.lower()))
                continue
            m = _PLAIN.fullmatch(w)
            if m is None:
                other.append(len(out))
                out.append(b"")
                continue
            if (marks := m[2]) and marks not in self.marks and len(self.marks) < WORDS:
                self.marks[marks] = self.run(marks)
            out.append(self.run(m[1].lower()) + (marks and (self.marks.get(marks) or self.run(marks)) or b""))
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, "<u4") for t in texts]
        lists = pc.ascii_split_whitespace(texts)
        each = lists.flatten().dictionary_encode()
        words, codes = each.dictionary.to_pylist(), each.indices.to_numpy()
        ids = [self.known.get(w) for w in words]
        new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self.encode([words[k] for k in new]), strict=True):
            ids[k] = x
        if len(self.known) > WORDS:
            self.known.clear()
        count = np.bincount(codes, minlength=len(words))
        self.known.update((words[k], ids[k]) for k in new if count[k] > 1)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        start = np.cumsum(size) - size
        flat, of = np.frombuffer(b"".join(ids), "<u4"), size[codes]
        end = np.append(0, np.cumsum(of))
        at = np.repeat(start[codes] - end[:-1], of) + np.arange(end[-1])
        edge = end[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        flat = flat[at]
        return [flat[s:e] for s, e in zip(edge, edge[1:], strict=False)]

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def word_ids(path: str) -> WordIds:
    return WordIds(path)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts of about ``most`` bytes, with their places."""
    size = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most)))
        yield at, texts.slice(at, end - at)
        at = end


def token_pieces(docs: DataFrame, path: str, cap: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece of each document's ids and the closing id: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for b in batches:
            out: list[tuple] = []
            docs = b.column(0).to_pylist()
            for doc, own in ((d, x) for at, texts in chunks(b.column(1)) for d, x in zip(docs[at : at + len(texts)], words.batch(texts), strict=True)):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                out += [(doc, k, s, len(x := ids[s : s + cap]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), cap))]
            if out:
                d, k, s, n, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frugal(cut), PIECES)


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Bins of indexes: longest first, each to the fullest bin that has room. A bit set of free sizes finds that bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(cap + 1)]
    has = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = has >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = free[room].pop()
            if not free[room]:
                has &= ~(1 << room)
        else:
            room, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            free[room - n].append(b)
            has |= 1 << (room - n)
    return bins


def swap_search(bins: list[list[int]], lengths: list[int], cap: int) -> list[list[int]]:
    """Local search over the underfull bins: move, one-for-one, two-for-one, each raising squared fill.

    Bins are emptied from the least full on, round after round, until the
    number of bins is the least possible or a round finds no step.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // cap)
    left = sum(1 for b in bins if b)
    # By length, what the underfull bins hold, by room. Length 0: nothing, for moves.
    held: dict[int, list[tuple[int, int, int]]] = {}

    def entries(a: int) -> list[tuple[int, tuple[int, int, int]]]:
        room = cap - fill[a]
        return [(0, (room, a, -1)), *((n, (room, a, i)) for n, i in {lengths[i]: i for i in bins[a]}.items())]

    def enter(a: int) -> None:
        if bins[a] and fill[a] < cap:
            for n, x in entries(a):
                bisect.insort(held.setdefault(n, []), x)

    def leave(a: int) -> None:
        if bins[a] and fill[a] < cap:
            for n, x in entries(a):
                del held[n][bisect.bisect_left(held[n], x)]
                if not held[n]:
                    del held[n]

    if left <= least:
        return [b for b in bins if b]
    for a in range(len(bins)):
        enter(a)
    moved = True
    while moved and left > least:
        moved = False
        for t in sorted((a for a in range(len(bins)) if bins[a] and fill[a] < cap), key=lambda a: fill[a]):
            if left <= least:
                break
            if fill[t] == cap:  # filled meanwhile
                continue
            leave(t)
            while bins[t] and (step := _step(bins[t], lengths, held, cap, fill[t])):
                a, give, take = step
                leave(a)
                for i in give:
                    bins[t].remove(i)
                for i in take:
                    bins[a].remove(i)
                bins[a] += give
                bins[t] += take
                d = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                fill[a], fill[t], moved = fill[a] + d, fill[t] - d, True
                enter(a)
            left -= not bins[t]
            enter(t)
    return [b for b in bins if b]


def _step(items: list[int], lengths: list[int], held: dict[int, list[tuple[int, int, int]]], cap: int, fill: int):
    """The exchange (bin, given, taken) that raises squared fill most: one or two given, none or one taken."""
    found, most = None, 0
    own = sorted(items, key=lambda i: -lengths[i])
    gifts = [[i] for i in own] + [[i, j] for k, i in enumerate(own) for j in own[k + 1 : k + 9]]
    for give in gifts:
        size = sum(lengths[i] for i in give)
        for x, bins in held.items():
            d = size - x
            if d <= 0 or x == 0 and len(give) > 1:
                continue
            at = bisect.bisect_left(bins, (d,))
            if at < len(bins) and bins[at][0] <= cap - fill:
                room, a, i = bins[at]
                gain = d * (cap - room - fill + d)
                if gain > most:
                    found, most = (a, give, [i] if i >= 0 else []), gain
    return found


def pack(pieces: DataFrame, cap: int = 2048, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (1 to cap).

    Gapless from 0 in each sequence. Rows with the same doc_id and piece are
    different pieces; null ids are packed like any other. No rows give no rows.
    """
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    out = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = swap_search(best_fit(lengths, cap), lengths, cap)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        first = int(pdf["_g"].iloc[0]) << 32
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = first + k, at
                at += lengths[i]
        return pdf.drop(columns="_g").assign(sequence_id=seq, offset=off)

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(one, f"{out}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, cap: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """Tokenize and pack whole documents (null text: only the closing id)."""
    return pack(token_pieces(docs, path or tokenizer_path(), cap, end_id), cap, group)
