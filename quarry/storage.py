"""Intermediate results in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and forget its lineage.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a session
    whose executors are threads of the driver gets a temporary one if that is
    unset; any other must name a folder that all its machines share.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from a few small files: such a file is one row group, and so one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(df.inputFiles()) < cores // 2 and df._jdf.queryExecution().toRdd().getNumPartitions() <= 4 * cores
    return df.repartition(cores) if few else df
