"""Writers. Nothing is gathered on the driver; a run or metrics file is one row of JSON a query or metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import nested
from .readers import grouped_in_order


def strings(df: DataFrame, *ids: str) -> DataFrame:
    """Id columns as strings, as the file formats have them."""
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def write_jsonl(df: DataFrame, path: str, *ids: str) -> None:
    """JSON Lines, ids as strings, characters beyond ASCII as they are."""
    strings(df, *ids).write.mode("overwrite").json(path)


def run_json(run: DataFrame) -> DataFrame:
    """(query_id, json): ``{"query": ["doc", ...]}`` in rank order."""
    listed = grouped_in_order(strings(run, "query_id", "doc_id"))
    return listed.select("query_id", F.to_json(F.map_from_arrays(F.array("query_id"), F.array("doc_ids"))).alias("json"))


def write_run(run: DataFrame, path: str) -> None:
    run_json(run).select("json").write.mode("overwrite").text(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(metric, json): ``{"k": value, ...}``, values rounded to 4 places and written without an exponent."""
    plain = lambda v: F.coalesce(F.regexp_replace(v.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1"), F.lit("null"))
    entries = F.transform(F.map_entries("values"), lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('":'), plain(e["value"])))
    return nested(metrics).select("metric", F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("json"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics_json(metrics).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
