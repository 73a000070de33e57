"""Search over queries that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexical
from ..sources import schema as S


def query_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """JSON Lines queries (query_id, text), a bounded number of files at a time."""
    return spark.readStream.schema(S.QUERY).option("maxFilesPerTrigger", per_trigger).json(folder).withColumnRenamed("id", "query_id")


def search_stream(queries: DataFrame, index: lexical.Index, out: str, checkpoint: str, k: int = 1000, once: bool = True) -> StreamingQuery:
    """Answer each batch of queries into ``out`` as parquet. A batch that is tried again replaces its own folder, so results are exactly once."""

    def answer(batch: DataFrame, number: int) -> None:
        lexical.search(index, batch, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
