"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (a shared store), never to a machine's own disk, so
that a lost executor costs a re-read and not the job.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session; where none is set, a temporary one on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, keeps Catalyst's file pruning."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow or mapInPandas; when it ends, its worker, which lives on, gives back what the task held."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


#: Rows of short terms or keys that may be broadcast.
BROADCAST = 200_000


def sized(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df, marked for broadcast only if it is counted to be small; else its joins shuffle. df must be cheap to count (a stored table)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(df: DataFrame) -> DataFrame:
    """df's rows and columns behind a generator of one row, past which no filter is pushed.

    Catalyst would write a filter's columns out in full below the projections,
    and so evaluate nested array expressions once for every element.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))))
