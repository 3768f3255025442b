"""Sketches in relational form: rows of counters and registers, merged by aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _little_endian(hexed: Column, n_bytes: int) -> Column:
    """The first bytes of a hex digest as an unsigned little-endian number."""
    turned = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(n_bytes))])
    return F.conv(turned, 16, 10)


def cms_cells(keys: DataFrame, key: str = "key", width: int = 10_000, depth: int = 7) -> DataFrame:
    """Count-Min as rows (row, idx, count); partial counts merge before they shuffle."""
    return keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).select(F.explode(_cells(key, width, depth)).alias("c"), "n").groupBy("c.row", "c.idx").agg(F.sum("n").alias("count"))


def _cells(key: str, width: int, depth: int) -> Column:
    four = lambda i: F.unhex(F.lit(i.to_bytes(4, "little").hex()))
    return F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(_little_endian(F.md5(F.concat(F.col(key).cast("binary"), four(i))), 4).cast("bigint"), F.lit(width)).cast("int").alias("idx")) for i in range(depth)])


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "idx").agg(F.sum("count").alias("count"))


def cms_estimate(keys: DataFrame, cells: DataFrame, key: str = "key", width: int = 10_000, depth: int = 7) -> DataFrame:
    """key, estimate for each distinct key."""
    asked = keys.select(key).distinct().select(key, F.explode(_cells(key, width, depth)).alias("c")).select(key, "c.row", "c.idx")
    return asked.join(cells, ["row", "idx"], "left").groupBy(key).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def cms_settled(estimates: DataFrame, keys: DataFrame, key: str = "key", width: int = 10_000, depth: int = 7) -> DataFrame:
    """estimates of all of ``keys``, with exact counts for the keys that a sketch may count too high.

    These are the keys with no cell of their own, and the null key, which cells leave out.
    """
    own = keys.where(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(_cells(key, width, depth)).alias("c")).select(key, "c.row", "c.idx")
    alone = own.groupBy("row", "idx").agg(F.count("*").alias("n")).where("n = 1").select("row", "idx")
    sure = own.join(alone, ["row", "idx"], "left_semi").select(key).distinct()
    exact = keys.groupBy(key).agg(F.count("*").alias("_exact")).join(sure, key, "left_anti").withColumnRenamed(key, "_key")
    return estimates.join(exact, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("_exact", "estimate").alias("estimate"))


def hll_registers(values: DataFrame, value: str, by: tuple[str, ...] = (), p: int = 14) -> DataFrame:
    """by, idx, rho: HyperLogLog registers over SHA-256."""
    h = F.substring(F.sha2(F.col(value).cast("string"), 256), 1, 16)
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
    bits = F.lpad(F.concat(F.lpad(F.bin(F.conv(F.substring(turned, 1, 8), 16, 10).cast("bigint")), 32, "0"), F.lpad(F.bin(F.conv(F.substring(turned, 9, 8), 16, 10).cast("bigint")), 32, "0")), 64, "0")
    idx = F.conv(F.substring(bits, 64 - p + 1, p), 2, 10).cast("int")
    rest = F.substring(bits, 1, 64 - p)
    rho = F.length(rest) - F.length(F.ltrim(rest, F.lit("0"))) + 1
    return values.where(F.col(value).isNotNull()).select(*by, idx.alias("idx"), rho.alias("rho")).groupBy(*by, "idx").agg(F.max("rho").alias("rho"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    by = [c for c in a.columns if c != "rho"]
    return a.unionByName(b).groupBy(*by).agg(F.max("rho").alias("rho"))


def hll_count(registers: DataFrame, by: tuple[str, ...] = (), p: int = 14) -> DataFrame:
    """by, estimate; small counts by the empty registers."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    got = registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"), F.count("*").alias("used"))
    raw = F.lit(alpha * m * m) / (F.col("s") + (m - F.col("used")))
    small = F.when(F.col("used") < m, F.lit(float(m)) * F.log(F.lit(float(m)) / (m - F.col("used")))).otherwise(raw)
    return got.select(*by, F.floor(F.when(raw <= 2.5 * m, small).otherwise(raw) + 0.5).cast("bigint").alias("estimate"))


def hll_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << p)


def contains(values: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Exact set membership, where a filter would err: values with ``found``."""
    return values.join(members.select(on).distinct().withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
