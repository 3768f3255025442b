"""How rows lie: small inputs over all cores, tables that several steps read, sides small enough to broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes a core up to which an input is small; above that its own splits are many.
SMALL = 128 << 20
#: Rows of short keys that may be broadcast.
BROADCAST = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt over all cores, if the plan reads so little that a few splits, or one row group, hold it all.

    A large input is left as it is: its splits outnumber the cores, and a
    shuffle of whole texts would cost more than it evens out.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def kept(df: DataFrame, what: str) -> DataFrame:
    """df computed once, for steps that read it several times: a table in ``spark.checkpoint.dir``, or where none is named Spark's own cache."""
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not named:
        return df.persist()
    path = f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most ``most`` rows; else its joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
