"""Benchmark decontamination by a distributed positional inverted index.

1. Frequencies of the benchmark's terms over all documents.
2. Every window of an item is anchored at its two rarest terms; the index
   stores postings (term, document, position) of the anchor terms.
3. Posting lists meet with their offsets taken off, so that equal alignments of
   an item in a document coincide; a window whose two anchors share an
   alignment is a candidate.
4. Candidates are checked word for word in the documents that have any.

Only DataFrame functions are used. The side that is small by nature (terms,
anchors) is broadcast only after its rows are counted; beyond ``sized``'s bound
the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words of a text as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAKS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; the built-in lower() does that for ASCII words."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, th (the text's hash: tells rows apart that share a doc_id), pos (from 0); of all terms or those in ``terms`` (term)."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    own = own.select("doc_id", "th", "pos", lowered(F.col("word")).alias("term"))
    return own if terms is None else own.join(sized(terms), "term")


def item_windows(items: DataFrame, freq: DataFrame, n: int) -> DataFrame:
    """item, item_id, start, len, phrase, and the window's two rarest places with their terms; windows with a term that no document has are left out."""
    words = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), F.posexplode(raw_words(F.col("text"))).alias("ipos", "word")).select("item_id", "item", "ipos", lowered(F.col("word")).alias("term")).distinct()
    words = words.join(freq, "term", "left").select("item_id", "item", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "ipos", "term").alias("w"))
    # An item's own words, whose number its text bounds.
    whole = words.groupBy("item", "item_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: a["ipos"] - b["ipos"]).alias("ws"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0)))
    w = whole.select("item", "item_id", "ws", F.explode(starts).alias("start")).withColumn("in", F.slice("ws", F.col("start") + 1, n))
    w = w.where(~F.exists("in", lambda x: x["n"] == 0)).withColumn("rare", F.slice(F.sort_array("in"), 1, 2))
    return w.select("item", "item_id", "start", F.size("in").alias("len"), F.array_join(F.transform("in", lambda x: x["term"]), " ").alias("phrase"), F.transform("rare", lambda x: F.struct(x["term"].alias("term"), x["ipos"].alias("ipos"))).alias("rare"))


def phrase_matches(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, th, matches: all places (item_id, start, len) where a window of n words of an item (all of a shorter one) stands in the document.

    Rows of docs with equal doc_id and text give one row. Matches of a document
    are bounded by its words times the items that stand there.
    """
    terms = stored(items.select(F.explode(raw_words(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term")).distinct(), "terms")
    freq = stored(postings(docs, terms).groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    windows = stored(item_windows(items, freq, n), "windows")
    anchors = stored(windows.select("item", F.explode("rare").alias("r")).select("item", "r.term", "r.ipos").distinct(), "anchors")
    index = stored(postings(docs, anchors.select("term").distinct()).select("term", "doc_id", "th", "pos"), "postings")
    aligned = index.join(sized(anchors), "term").select("doc_id", "th", "item", (F.col("pos") - F.col("ipos")).alias("align"), "ipos")
    aligned = aligned.groupBy("doc_id", "th", "item", "align").agg(F.collect_set("ipos").alias("at"))
    both = F.forall("rare", lambda r: F.array_contains("at", r["ipos"]))
    found = aligned.join(sized(windows), "item").where(both & (F.col("align") + F.col("start") >= 0))
    found = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", (F.col("align") + F.col("start")).alias("start"), "len", "phrase")).alias("cands"))
    found = stored(found, "candidates")
    keys = found.select("doc_id", "th")
    some = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    some = some.alias("l").join(sized(keys).alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th")), "left_semi").dropDuplicates(["doc_id", "th"])
    some = some.select("doc_id", "th", F.transform(raw_words(F.col("text")), lowered).alias("ws"))
    true = F.filter("cands", lambda c: F.array_join(F.slice("ws", c["start"] + 1, c["len"]), " ") == c["phrase"])
    out = found.alias("f").join(some.alias("s"), F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.th") == F.col("s.th")))
    out = out.select("f.doc_id", "f.th", true.alias("m"))
    return out.where(F.size("m") > 0).select("doc_id", "th", F.transform("m", lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"), c["len"].alias("len"))).alias("matches"))


def hits(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, item_ids (sorted as strings). No items: nothing is hit."""
    m = phrase_matches(docs, items, n)
    places = F.array_distinct(F.flatten(F.transform("matches", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    m = stored(m.select("doc_id", "th", F.size(places).alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda c: c["item_id"].cast("string")))).alias("item_ids")), "hits")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(raw_words(F.col("text"))).cast("bigint").alias("n_words"))
    out = own.alias("l").join(m.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th")), "left")
    return out.select("l.doc_id", "l.n_words", F.coalesce("r.n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("r.item_ids", F.array().cast("array<string>")).alias("item_ids"))


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Places where both terms of a pair (a, b) stand within ``slop`` words: a, b, doc_id, th, pos_a, pos_b.

    A range join by buckets of ``slop`` words; a term meets only its own and the
    neighbouring buckets of the same document.
    """
    wide = max(1, slop)
    left = pairs.select("a", "b").distinct().join(index, F.col("a") == F.col("term")).select("a", "b", "doc_id", "th", F.col("pos").alias("pos_a"), F.explode(F.array(*[F.floor(F.col("pos") / wide) + d for d in (-1, 0, 1)])).alias("bucket"))
    right = index.select(F.col("term").alias("b"), "doc_id", "th", F.col("pos").alias("pos_b"), F.floor(F.col("pos") / wide).alias("bucket"))
    return left.join(right, ["b", "doc_id", "th", "bucket"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= slop).where((F.col("a") != F.col("b")) | (F.col("pos_a") < F.col("pos_b"))).select("a", "b", "doc_id", "th", "pos_a", "pos_b")
