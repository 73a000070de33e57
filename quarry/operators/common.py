"""Helpers that several operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut

BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 4096


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About the memory that a value takes."""
    zero = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), zero) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(c, zero, lambda a, x: a + _bytes(x, kind.elementType)), zero) + 24
        return F.coalesce(8 * F.size(c).cast("long"), zero) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), zero)
    return F.lit(8).cast("long")


def sized(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written down once, and marked for broadcast if its values take at most ``max_bytes``; else its join is shuffled."""
    held = cut(df)
    total = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))
    return F.broadcast(held) if (held.agg(F.sum(total)).first()[0] or 0) <= max_bytes else held


def top_k(df: DataFrame, by: list[str], score: str, tie: list[str], k: int, ascending: bool = False) -> DataFrame:
    """The best ``k`` rows of each group with their ``rank``; equal scores go by ``tie``. Spark limits each task's groups before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, *tie))).filter(F.col("rank") <= k)


def blocks_of(df: DataFrame, key: str, rows: int = BLOCK_ROWS) -> Iterator[list]:
    """The rows of a query set, collected a bounded block at a time."""
    n = max(1, math.ceil(df.count() / rows))
    for k in range(n):
        block = df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)
        yield block.collect()


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
