"""Bucket codes of residuals and their packing into bytes, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketise(values: Column, cutoffs: list[float]) -> Column:
    """Number of cutoffs below each value."""
    return F.transform(values, lambda x: sum(((x > c).cast("int") for c in cutoffs), F.lit(0)))


def unbucketise(codes: Column, weights: list[float]) -> Column:
    table = F.array(*map(F.lit, weights))
    return F.transform(codes, lambda c: F.get(table, c))


def pack(codes: Column, nbits: int) -> Column:
    """Bytes as ints, the first code of each in the highest bits."""
    per = 8 // nbits

    def byte(j: Column) -> Column:
        return sum((F.coalesce(F.get(codes, j * per + i), F.lit(0)) * F.lit(1 << (8 - nbits * (i + 1))) for i in range(per)), F.lit(0))

    n = F.ceil(F.size(codes) / F.lit(per)).cast("int")
    return F.when(F.size(codes) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))


def unpack(packed: Column, nbits: int) -> Column:
    """Codes of ``pack``; codes that do not fill the last byte come back as zeros behind."""
    per = 8 // nbits
    return F.flatten(F.transform(packed, lambda b: F.array(*[F.shiftright(b, 8 - nbits * (i + 1)).bitwiseAND((1 << nbits) - 1) for i in range(per)])))


def unpacked(packed: np.ndarray, nbits: int) -> np.ndarray:
    """``unpack`` of a matrix of bytes, one row a vector; with 0 bits they are codes already."""
    if not nbits:
        return packed
    per = 8 // nbits
    shifts = 8 - nbits * np.arange(1, per + 1)
    return (packed[:, :, None] >> shifts & (1 << nbits) - 1).reshape(len(packed), -1)
