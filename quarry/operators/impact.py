"""Top-k by summed impacts: the scoring that lexical and sparse retrieval share.

A posting (doc_id, token, impact) adds impact times the query's weight of the
token to the document's score. A bounded block of the query set goes to the
executors; postings of its tokens are dealt by document, and a task adds up
whole matrices of documents by queries, keeping its own top k. So what is
shuffled is one row a posting, whatever the number of queries, and then k rows
a query and task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best import Best, id_kinds, merged
from .common import union_all

QUERY_BLOCK = 1024
CELLS = 1 << 22


def _scored(postings: DataFrame, block: list, k: int, kinds: tuple, schema: str, token_kind: str) -> DataFrame:
    """Packed candidates for the (query_id, token, weight) rows of a block."""
    spark = postings.sparkSession
    names = sorted({r["query_id"] for r in block})
    row = {n: i for i, n in enumerate(names)}
    number: dict = {}
    for r in block:
        number.setdefault(r["token"], len(number))
    at = np.array([number[r["token"]] for r in block], np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(number) + 1))
    q = np.array([row[r["query_id"]] for r in block], np.int64)[order]
    w = np.array([r["weight"] for r in block], float)[order]
    sent = spark.sparkContext.broadcast((names, starts, q, w))
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), f"token {token_kind}, n int"))  # the block's tokens
    dealt = postings.join(numbers, "token").select("doc_id", "n", F.col("impact").cast("double").alias("impact")).repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        names, starts, q, w = sent.value
        best = Best(len(names), k)

        def add(ids, n, impact):
            """Score a run of whole documents."""
            edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            code = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            step = max(1, CELLS // len(names))
            for lo in range(0, len(edges) - 1, step):
                a, b = edges[lo], edges[min(lo + step, len(edges) - 1)]
                count = starts[n[a:b] + 1] - starts[n[a:b]]
                p = np.repeat(np.arange(a, b), count)
                e = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + starts[n[p]]
                docs = min(step, len(edges) - 1 - lo)
                s = np.bincount((code[p] - lo) * len(names) + q[e], impact[p] * w[e], docs * len(names)).reshape(docs, -1)
                hit = np.bincount((code[p] - lo) * len(names) + q[e], minlength=docs * len(names)).reshape(docs, -1) > 0
                best.add(s.T, ids[edges[lo : lo + docs]], hit.T)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
            if last:
                add(*(x[:last] for x in now))
            held = [x[last:] for x in now]
        if held is not None:
            add(*held)
        yield from best.packed(names, kinds)

    return dealt.mapInArrow(run, schema)


def search(postings: DataFrame, weights: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) of ``postings`` (doc_id, token, impact) for ``weights`` (query_id, token, weight).

    Scores are rounded to 9 places before ranking, equal ones go by doc_id.
    Documents that share no token with a query are not listed.
    """
    kinds, schema = id_kinds(weights, postings)
    token_kind = postings.schema["token"].dataType.simpleString()
    weights = weights.filter("query_id is not null and token is not null").select("query_id", "token", "weight").persist()
    try:
        n = max(1, math.ceil(weights.select("query_id").distinct().count() / block))
        found = []
        for j in range(n):
            rows = (weights if n == 1 else weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == j)).collect()  # block queries
            if rows:
                found.append(_scored(postings, rows, k, kinds, schema, token_kind))
    finally:
        weights.unpersist()
    hits = union_all(found) if found else postings.sparkSession.createDataFrame([], schema)
    return merged(hits, k)
