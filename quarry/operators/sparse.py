"""Learned-sparse retrieval over (id, token, weight) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import impact
from .common import sized, top_k


def activate(logits: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, token, weight): the largest ln(1 + relu(logit)) of each token; ``logits`` is (id, token, logit). Zero weights are dropped."""
    weight = F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0)))
    return logits.groupBy(id_col, "token").agg(F.max(weight).alias("weight")).filter("weight > 0")


def to_sparse(dense: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """Places of dense rows that are not zero, negative ones too; a row without any vanishes."""
    return dense.select(id_col, F.posexplode(vector).alias("token", "weight")).filter("weight <> 0")


def prune(vectors: DataFrame, n: int = 200, id_col: str = "id") -> DataFrame:
    """The ``n`` heaviest tokens of each id; equal weights go by token."""
    return top_k(vectors, [id_col], "weight", ["token"], n).drop("rank")


def write(postings: DataFrame, path: str) -> None:
    """Postings sorted by token, for searches that read only their tokens' row groups."""
    postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def search(queries: DataFrame, postings: DataFrame, k: int = 1000) -> DataFrame:
    """(query_id, doc_id, score, rank) by dot product of ``queries`` (query_id, token, weight) with ``postings`` (doc_id, token, weight).

    A query without tokens has no hits; documents that share no token are not listed.
    """
    return impact.search(postings.select("doc_id", "token", F.col("weight").alias("impact")), queries, k)


def rerank(candidates: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id) by dot product; a pair that shares no token scores 0."""
    pairs = candidates.select("query_id", "doc_id").distinct()
    q = queries.select("query_id", "token", F.col("weight").alias("qw"))
    hits = pairs.join(sized(q), "query_id").join(postings.select("doc_id", "token", F.col("weight").alias("dw")), ["doc_id", "token"], "left")
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.coalesce(F.sum(F.col("qw") * F.col("dw")), F.lit(0.0)), 9).alias("score"))
    return top_k(scores, ["query_id"], "score", ["doc_id"], 1 << 30)


def mean_terms(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: mean number of terms of an id that has any."""
    return vectors.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_terms"))


def flops_weight(step: int, full: float, ramp: int = 50_000) -> float:
    """The weight of the activation penalty at a training step: grows with the square of the step to ``full``."""
    return full * min(1.0, max(0, step) / ramp) ** 2


def flops(vectors: DataFrame, n_rows: int) -> DataFrame:
    """One row: the sum over tokens of their squared mean activation over ``n_rows`` rows."""
    return vectors.groupBy("token").agg((F.sum("weight") / n_rows).alias("mean")).agg(F.sum(F.col("mean") * F.col("mean")).alias("flops"))
