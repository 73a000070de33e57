"""Recall, nDCG and MRR at k of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import sized

KS = (1, 5, 10, 20, 50, 100, 1000)


def per_query(run: DataFrame, qrels: DataFrame, ks=KS, distinct: bool = False) -> DataFrame:
    """query_id, and recall_k, ndcg_k, mrr_k, for the queries that both ``run`` and ``qrels`` have.

    ``run`` is (query_id, doc_id, rank), ``qrels`` (query_id, doc_id,
    relevance); relevance above 0 counts. A repeated judgement counts as often
    as it stands, unless ``distinct``; a document twice in a run is two hits.
    """
    relevant = cut(qrels.filter("relevance > 0").select("query_id", "doc_id"))  # read twice
    n_rel = relevant.groupBy("query_id").agg((F.countDistinct("doc_id") if distinct else F.count("*")).alias("n_rel"))
    pairs = relevant.select("query_id", "doc_id", F.lit(True).alias("hit")).distinct()
    return _each(run.join(pairs, ["query_id", "doc_id"], "left"), n_rel, ks)


def per_query_by_class(run: DataFrame, queries: DataFrame, docs: DataFrame, ks=KS, distinct: bool = False) -> DataFrame:
    """``per_query``, relevant being every row of ``docs`` (doc_id, class) that shares the class of a row of ``queries`` (query_id, class), but for the query's own id.

    Such judgements are as many as the pairs of a class; they are counted from
    the sizes of the classes and looked up for the run only, never listed.
    """
    queries, docs = (x.select(i, "class").filter(f"{i} is not null and class is not null") for x, i in ((queries, "query_id"), (docs, "doc_id")))
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("class")).alias("asked"))  # one class, unless an id is repeated
    held = docs.groupBy("doc_id").agg(F.array_sort(F.collect_set("class")).alias("held"))
    shares = F.arrays_overlap("asked", "held")
    if distinct:
        kinds = held.groupBy("held").agg(F.count("*").alias("n")).select(F.explode("held").alias("class"), "held", "n")
        each = queries.distinct().join(kinds, "class").select("query_id", "held", "n").distinct().groupBy("query_id").agg(F.sum("n").alias("n"))
        own = asked.join(held.withColumnRenamed("doc_id", "query_id"), "query_id").filter(shares).select("query_id", F.lit(1).alias("own"))
        n_rel = each.join(own, "query_id", "left").select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_rel"))
    else:
        sizes = docs.groupBy("class").agg(F.count("*").alias("n"))
        own = docs.groupBy(F.col("doc_id").alias("query_id"), "class").agg(F.count("*").alias("own"))
        times = queries.groupBy("query_id", "class").agg(F.count("*").alias("times"))
        each = times.join(sizes, "class").join(own, ["query_id", "class"], "left")
        n_rel = each.groupBy("query_id").agg(F.sum(F.col("times") * (F.col("n") - F.coalesce("own", F.lit(0)))).alias("n_rel"))
    marked = run.join(sized(asked), "query_id", "left").join(sized(held), "doc_id", "left")
    return _each(marked.select("query_id", "rank", (shares & (F.col("query_id") != F.col("doc_id"))).alias("hit")), n_rel.filter("n_rel > 0"), ks)


def _each(marked: DataFrame, n_rel: DataFrame, ks) -> DataFrame:
    """Metrics of a run (query_id, rank, hit) for the queries of ``n_rel``."""
    gain = 1 / F.log2(F.col("rank") + 1)
    sums = []
    for k in ks:
        hit = F.col("hit") & (F.col("rank") <= k)
        sums += [F.count(F.when(hit, 1)).alias(f"hits_{k}"), F.sum(F.when(hit, gain).otherwise(0.0)).alias(f"dcg_{k}"), F.min(F.when(hit, F.col("rank"))).alias(f"first_{k}")]
    found = marked.groupBy("query_id").agg(*sums).join(n_rel, "query_id")
    out = [F.col("query_id")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [
            (F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_{k}"),
            F.when(ideal > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0).alias(f"ndcg_{k}"),
            F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)).alias(f"mrr_{k}"),
        ]
    return found.select(*out)


def evaluate(run: DataFrame, qrels: DataFrame, ks=KS, distinct: bool = False) -> DataFrame:
    """(metric, k, value): unweighted means over the evaluated queries, 0 without any."""
    return _means(per_query(run, qrels, ks, distinct), ks)


def evaluate_by_class(run: DataFrame, queries: DataFrame, docs: DataFrame, ks=KS, distinct: bool = False) -> DataFrame:
    """``evaluate`` with the judgements of ``per_query_by_class``."""
    return _means(per_query_by_class(run, queries, docs, ks, distinct), ks)


def _means(each: DataFrame, ks) -> DataFrame:
    names = [(m, k) for m in ("recall", "ndcg", "mrr") for k in ks]
    means = each.agg(*[F.coalesce(F.avg(f"{m}_{k}"), F.lit(0.0)).alias(f"{m}_{k}") for m, k in names])
    label = {"recall": "Recall", "ndcg": "nDCG", "mrr": "MRR"}
    rows = F.array(*[F.struct(F.lit(label[m]).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for m, k in names])
    return means.select(F.inline(rows))


def nested(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """(metric, values): a map from k to the rounded value."""
    scaled = F.abs("value") * 10**digits  # a half is what the product says, as in SQL
    rounded = F.signum("value") * (F.floor(scaled) + (scaled - F.floor(scaled) >= 0.5).cast("int")) / 10**digits
    entries = F.array_sort(F.collect_list(F.struct("k", rounded.alias("v"))))  # a handful
    return metrics.groupBy("metric").agg(F.map_from_entries(entries).alias("values"))
