"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import cut, spread

__all__ = ["cut", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of few files is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def slices(batches, rows: int = 512):
    """Arrow batches a few rows at a time, so that only these become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
