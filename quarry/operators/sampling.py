"""Deterministic samples, shards and orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def sample_size(n: int, factor: int = 16) -> int:
    return min(1 + int(factor * math.sqrt(n)), n)


def partitions_for(n: int, factor: int = 16) -> int:
    """The power of two at or below factor * sqrt(n)."""
    return 1 << int(math.floor(math.log2(factor * math.sqrt(n)))) if n else 1


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, by the hash of their key, numbered by ``order`` in key order."""
    picked = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return picked.withColumn("order", F.row_number().over(Window.orderBy(key)))  # n rows


def contiguous_shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds ``shard``: equal contiguous ranges of rows in key order, the last also takes the remainder.

    Positions come from the sizes of range partitions, so no task sees more
    than its own rows.
    """
    total = df.count()
    size = max(1, total // n)
    return numbered(df, key).withColumn("shard", F.least(F.lit(n - 1), F.floor(F.col("position") / size).cast("int"))).drop("position")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``position``, from 0 in key order: rows are range-partitioned, and each partition starts where the ones before end."""
    parts = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = sizes.select("_part", before.alias("_start"))  # one row a partition
    return parts.join(F.broadcast(starts), part == F.col("_part")).withColumn("position", F.col("_start") + row).drop("_id", "_part", "_start")


def worker_of(position: Column, world_size: int, workers: int = 1) -> Column:
    """Which reader of a line-sharded stream takes the line: rank * workers + worker."""
    return F.pmod(position, F.lit(world_size * workers)).cast("int")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Rows in an order that depends on key, seed and epoch only."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(epoch)), key)


def pick(array: Column, key: Column, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """One of the first ``n`` elements, by arithmetic on the key, so that every engine picks the same; null from an empty array."""
    size = F.least(F.lit(n), F.size(array))
    return F.when(size > 0, F.get(array, F.pmod(key * 31 + seed + epoch * 17, size).cast("int")))
