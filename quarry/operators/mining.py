"""Hard negatives and training triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .sampling import pick


def hard_negatives(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, pos_id, neg_ids): the best ``k`` hits that are not relevant, in rank order, and the first relevant document.

    ``run`` is (query_id, doc_id, rank), ``qrels`` (query_id, doc_id,
    relevance, line_no); first is by line_no. Queries without a relevant
    document are left out; one whose hits are all relevant has no negatives.
    """
    run, relevant = cut(run), cut(qrels.filter("relevance > 0"))  # each is read twice
    first = relevant.groupBy("query_id").agg(F.min_by("doc_id", F.struct("line_no", "doc_id")).alias("pos_id"))
    negative = run.filter(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    listed = negative.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("neg_ids"))  # k rows
    empty = F.array().cast(listed.schema["neg_ids"].dataType)
    found = run.select("query_id").distinct().join(first, "query_id").join(listed, "query_id", "left")
    return found.select("query_id", "pos_id", F.coalesce("neg_ids", empty).alias("neg_ids"))


def triples(candidates: DataFrame, n_negative: int = 100, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(query_id, pos_id, neg_id): one of the first ``n_negative`` negatives of each query; numeric query ids."""
    chosen = pick(F.col("neg_ids"), F.col("query_id"), n_negative, seed, epoch)
    return candidates.select("query_id", "pos_id", chosen.alias("neg_id")).filter("neg_id is not null")


def with_texts(ids: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """Triples with the texts of query, positive and negative; ``queries`` (query_id, text), ``collection`` (doc_id, text). An unknown id drops the triple."""
    q = queries.select("query_id", F.col("text").alias("query"))
    p = collection.select(F.col("doc_id").alias("pos_id"), F.col("text").alias("positive"))
    n = collection.select(F.col("doc_id").alias("neg_id"), F.col("text").alias("negative"))
    return ids.join(q, "query_id").join(p, "pos_id").join(n, "neg_id").select("query_id", "pos_id", "neg_id", "query", "positive", "negative")


def lookup(candidates: DataFrame, collection: DataFrame, strict: bool = True) -> DataFrame:
    """Candidates (query_id, doc_id, rank) with their texts; ``strict`` fails on an id that the collection lacks."""
    joined = candidates.join(collection.select("doc_id", "text", F.lit(True).alias("known")), "doc_id", "left" if strict else "inner")
    missing = F.raise_error(F.concat(F.lit("unknown document: "), F.col("doc_id").cast("string")))
    text = F.when(F.col("known"), F.col("text")).otherwise(missing.cast("string")) if strict else F.col("text")
    return joined.select("query_id", "doc_id", "rank", text.alias("text"))


def in_batch_passages(triples_: DataFrame) -> DataFrame:
    """Positives, then negatives, of each batch as one array: (batch_id, passages); a batch has a fixed size."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("query_id", c))), lambda x: x[c])
    return triples_.groupBy("batch_id").agg(F.concat(order("pos_id"), order("neg_id")).alias("passages"))
