"""A training corpus from the documents table, in five stages.

Quality rules, line dedup, near-dedup, decontamination, packing. A stage works
on all rows that the one before kept; what one stage writes as Parquet is the
next one's input, so that a lost executor or a restart costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontam, lines, packing, quality, simhash
from sluice.llm.common import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned decision list reject go."""
    docs = docs.select(*COLUMNS)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, rules, also=COLUMNS).where("kept").select(*COLUMNS)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one; n_chars follows the text. Every document keeps its row."""
    return lines.dedup_lines(docs, also=("lang", "source")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in their five-word shingles (Jaccard 0.8 or more) the one with the smallest id stays."""
    return simhash.without_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item stand (or all of a shorter item) go."""
    docs = docs.select(*COLUMNS)
    found = decontam.phrase_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "th")
    own = docs.withColumn("_th", F.xxhash64("text")).alias("l")
    return own.join(found.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._th") == F.col("r.th")), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", by_quality),
    ("lines", lines_once),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Tokens, learned rules and shingle groups are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
