"""Indexes on disk, by kind: write one, load it, search it.

``flat`` and ``ivf`` hold one vector a document (doc_id, v), ``sparse`` weighted
tokens (doc_id, token, weight), ``late`` the token vectors of passages
(doc_id, pos, v), coded, beside the vectors themselves for exact reranking.
Every part is a parquet folder, sorted by what a search looks for; a small
``meta`` folder names the kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from . import dense, ivf, multivector, sparse

KINDS = ("flat", "ivf", "sparse", "late")


@dataclass
class Stored:
    """A kind and its parts by name."""

    kind: str
    parts: dict[str, DataFrame]
    codec: ivf.Codec | None = None


def known(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind!r}: one of {', '.join(KINDS)}")
    return kind


def unique_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows``; a null or repeated id is an error."""
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).first()
    if bad is not None:
        raise ValueError(f"{key} {bad[0]!r} stands {bad['n']} times; ids must be unique and not null")
    return rows


def _put(df: DataFrame, path: str, *by: str) -> None:
    df = df.repartitionByRange(by[0]).sortWithinPartitions(*by) if by else df
    df.write.mode("overwrite").parquet(path)


def write(kind: str, rows: DataFrame, path: str, n_lists: int | None = None, nbits: int = 2) -> None:
    """Build an index of ``rows`` at ``path``. ``n_lists`` is by default what the number of rows suggests."""
    known(kind)
    codec = None
    if kind == "flat":
        _put(unique_ids(rows).select("doc_id", "v"), f"{path}/vectors")
    elif kind == "sparse":
        sparse.write(rows.select("doc_id", "token", "weight"), f"{path}/postings")
    else:
        train = rows.select((F.col("doc_id") if kind == "ivf" else F.struct("doc_id", "pos")).alias("id"), "v")
        _put(ivf.train_centroids(train, n_lists), f"{path}/centroids")
        centroids = rows.sparkSession.read.parquet(f"{path}/centroids")
        if kind == "ivf":
            _put(ivf.lists(unique_ids(rows), centroids), f"{path}/lists", "centroid_id", "doc_id")
        else:
            tokens = rows.select(F.col("doc_id").alias("pid"), "pos", "v")
            codec = ivf.fit_codec(ivf.residuals(ivf.assign(tokens, centroids), centroids), nbits, exact=False)
            ivf.write(ivf.build(tokens, centroids, codec), f"{path}/lists")
            _put(rows.select("doc_id", "pos", "v"), f"{path}/vectors", "doc_id", "pos")
    meta = (kind, *((codec.cutoffs, codec.weights, codec.scales) if codec else (None, None, None)))
    rows.sparkSession.createDataFrame([meta], "kind string, cutoffs array<double>, weights array<double>, scales array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


PARTS = {"flat": ("vectors",), "ivf": ("centroids", "lists"), "sparse": ("postings",), "late": ("centroids", "lists", "vectors")}


def load(spark: SparkSession, path: str) -> Stored:
    meta = spark.read.parquet(f"{path}/meta").first()
    codec = ivf.Codec(list(meta["cutoffs"]), list(meta["weights"]), list(meta["scales"])) if meta["cutoffs"] else None
    return Stored(known(meta["kind"]), {name: spark.read.parquet(f"{path}/{name}") for name in PARTS[meta["kind"]]}, codec)


def search(index: Stored, queries: DataFrame, k: int = 1000, nprobe: int = 32, metric: str = "ip", rerank: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank). ``queries`` are rows like the index's with query_id: (v), (token, weight) or (pos, v).

    ``late`` finds passages by their codes and, with ``rerank``, ranks them
    again by their vectors.
    """
    p = index.parts
    if index.kind == "flat":
        return dense.search(queries, p["vectors"], k, metric)
    if index.kind == "ivf":
        return ivf.search_lists(queries, p["lists"], p["centroids"], k, nprobe, metric)
    if index.kind == "sparse":
        return sparse.search(queries, p["postings"], k)
    found = ivf.search(queries, p["lists"], p["centroids"], index.codec, k, nprobe)
    return multivector.rerank(found, queries, p["vectors"]) if rerank else found


def totals(index: Stored) -> DataFrame:
    """One row (n_rows, n_docs): what the index holds, postings or vectors, and of how many documents."""
    rows = index.parts.get("vectors", index.parts.get("postings", index.parts.get("lists")))
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"))


def vector_rows(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc_id, v) as indexes take them."""
    return vectors.select(F.col(id_col).alias("doc_id"), doubles(F.col("v")).alias("v"))
