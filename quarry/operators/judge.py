"""Relevance judgements derived from the collection itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pieces, tokens
from ..storage import cut, spread
from .common import blocks_of, sized, union_all
from .lexical import TOKENS_AT_ONCE
from .multivector import tiles

GRAM = 4
GRAMS_AT_ONCE = 1 << 17


def _mixed(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the GRAM words from each place on; equal words give equal ones."""
    out = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        out = (out + codes[at + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def containment(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance = 1): documents (doc_id, text) that contain a query's text as it stands.

    Each query of 6 tokens or more is found by the gram of its second to fifth
    token; only pairs that share one are compared, so no text meets all
    queries. Shorter ones, which may be part of any word, are looked for in
    every text, a bounded block of queries at a time. A null text contains
    nothing and is contained in nothing; an empty query is in every text.
    """
    docs = spread(docs.select("doc_id", "text"))
    q = cut(queries.filter("text is not null").select("query_id", F.col("text").alias("qtext"), tokens(F.col("text")).alias("ts")))
    short, q = q.filter(F.size("ts") < GRAM + 2).select("query_id", "qtext"), q.filter(F.size("ts") >= GRAM + 2)
    ts, schema = docs.select("doc_id", pieces(F.col("text")).alias("ts")), docs.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {schema}"
    grams = q.select("query_id", F.slice("ts", 2, GRAM).alias("gram"))
    found = [_sharing(ts, block, schema) for block in blocks_of(grams, "query_id", GRAMS_AT_ONCE) if block]
    pairs = (union_all(found) if found else docs.sparkSession.createDataFrame([], schema)).distinct()
    near = pairs.join(sized(q.select("query_id", "qtext")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    found = near.filter(F.contains("text", "qtext")).select("query_id", "doc_id")
    for block in blocks_of(short, "query_id"):
        if block:
            found = found.unionByName(_holding(docs, block, found.schema))
    return found.select("query_id", "doc_id", F.lit(1).alias("relevance"))


def _sharing(docs: DataFrame, block: list, schema: str) -> DataFrame:
    """(query_id, doc_id) of the split texts that may have the gram of one of a block of queries: words are numbered, and the numbers of a gram mixed."""
    words = pa.array(sorted({w for r in block for w in r["gram"]}), pa.string())
    number = {w: i for i, w in enumerate(words.to_pylist())}
    keys = _mixed(np.array([number[w] for r in block for w in r["gram"]], np.int64), np.arange(0, GRAM * len(block), GRAM))
    order = np.argsort(keys, kind="stable")
    names = [block[i]["query_id"] for i in order]
    sent = docs.sparkSession.sparkContext.broadcast((words, keys[order], names, pa.array(names).type))

    def run(batches):
        words, keys, names, kind = sent.value
        for batch in batches:
            lengths, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten()
            for lo, hi, a, b in tiles(lengths, TOKENS_AT_ONCE):
                part = flat.slice(a, b - a)
                kept = pc.not_equal(part, "").to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(part, words), -1).to_numpy()[kept]
                doc = np.repeat(np.arange(lo, hi), lengths[lo:hi])[kept]
                last = max(0, len(code) - GRAM + 1)
                whole = doc[:last] == doc[len(doc) - last :]
                for i in range(GRAM):
                    whole &= code[i : i + last] >= 0
                at = np.flatnonzero(whole)
                mixed = _mixed(code.astype(np.int64), at)
                first, end = np.searchsorted(keys, mixed), np.searchsorted(keys, mixed, "right")
                count = end - first
                asked = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                pairs = np.unique(np.stack([np.repeat(doc[at], count), asked]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in pairs[1]], kind), batch.column(0).take(pa.array(pairs[0]))], names=["query_id", "doc_id"])

    return docs.mapInArrow(run, schema)


def _holding(docs: DataFrame, block: list, schema) -> DataFrame:
    """(query_id, doc_id) of the texts that hold one of a block of query texts."""
    sent = docs.sparkSession.sparkContext.broadcast([(r["query_id"], r["qtext"]) for r in block])
    kinds = [pa.array([q for q, _ in sent.value]).type, None]

    def run(batches):
        for batch in batches:
            q, at = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                held = [name for name, said in sent.value if said in text] if text is not None else []
                q += held
                at += [k] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), batch.column(0).take(pa.array(at, pa.int64()))], names=["query_id", "doc_id"])

    return docs.mapInArrow(run, schema)
