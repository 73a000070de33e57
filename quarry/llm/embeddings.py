"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one node with a count. The distinct ones are dealt into
blocks of a bounded number of rows, and a task holds two blocks: every pair of
blocks meets once. A task returns each vector's number of links and what the
links join, never the pairs. Inside, a vector x of unit length is stored as int8 numbers
q with scale s and the exact length e of its rounding error x - s q. Then
``|x.y - s t (q.p)| <= e |t p| + f |s q| + e f``, so the integer product of a
tile decides nearly every pair; only pairs possibly at the threshold or above
are computed again in double precision.

Tiles are products of int8 numbers held as float32, which is exact here: each
sum stays below 2**24 (``127 * 127 * dimensions``; more dimensions are summed
in slices).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

BLOCK_ROWS = 8192
TILE = 1024
EXACT_DIMS = 1024  # 127 * 127 * 1024 < 2**24


def usable(c):
    """Vectors that can link: no null, none of its components null or not finite, not zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x.cast("double") != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 numbers (as float32), scales, bounds on the rounding errors' lengths, and lengths of the scaled numbers."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None])
    # the slack covers double rounding in x, s and the lengths themselves
    return q.astype(np.float32), s, np.linalg.norm(x - s[:, None] * q, axis=1) + 1e-12, np.linalg.norm(q, axis=1) * s + 1e-12


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yield (rows of a, rows of b) whose cosine in double precision reaches the threshold; ``same``: only pairs i < j of one block."""
    qa, sa, ea, na = quantise(a)
    qb, sb, eb, nb = (qa, sa, ea, na) if same else quantise(b)
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            k, m = slice(i, i + TILE), slice(j, j + TILE)
            dot = np.zeros((len(qa[k]), len(qb[m])))
            for d in range(0, a.shape[1], EXACT_DIMS):
                dot += qa[k, d : d + EXACT_DIMS] @ qb[m, d : d + EXACT_DIMS].T
            dot *= sa[k, None]
            dot *= sb[m]
            dot += ea[k, None] * nb[m]  # now an upper bound of the cosine
            dot += (na[k] + ea[k])[:, None] * eb[m]
            x, y = np.nonzero(dot >= threshold - 1e-12)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 1 << 16):
                u, v = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                ok = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
                if ok.any():
                    yield u[ok], v[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; their largest components are taken out first, so that no square is lost at either end of the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Put each ``u[k]`` and ``v[k]`` under one root, the smaller; ``root`` holds every place's root before and after."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root[:] = above


def blocks_for(n: int, cores: int, block_rows: int) -> int:
    """Blocks of at most ``block_rows`` rows, and so many that their pairs are a few tasks for each core if rows allow it."""
    wanted = 1
    while wanted * (wanted + 1) // 2 < 4 * cores and n // (wanted + 1) >= TILE:
        wanted += 1
    return max(1, -(-n // block_rows), wanted)


def links(nodes: DataFrame, threshold: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, n) of the pairs of ``nodes`` (node, v, w: a weight) with cosine >= threshold.

    Rows with ``a = b`` give parts of a node's sum of the weights of what it
    links with. The others are links, or what links imply: ``a`` and ``b`` are
    joined by pairs of one task. So a task returns no more rows than it has
    nodes, twice, however many pairs there are.
    """
    n = nodes.count()
    blocks = blocks_for(n, nodes.sparkSession.sparkContext.defaultParallelism, block_rows)
    rows = nodes.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("int"))
    # each row goes to the tasks of its block with every block: pair (i, j), i <= j, is task i * blocks + j
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("with", other).select((F.least("block", "with") * F.lit(blocks).cast("long") + F.greatest("block", "with")).alias("task"), F.col("block"), "node", "w", "v")

    def compare(key: tuple, batch: pa.Table) -> pa.Table:
        task = key[0].as_py()
        i, j = divmod(task, blocks)
        block, node, w = (batch.column(c).to_numpy() for c in ("block", "node", "w"))
        vectors = batch.column("v").combine_chunks()
        x = unit(np.asarray(vectors.flatten(), float).reshape(len(node), -1))
        own, far = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root, sums = np.arange(len(node)), np.zeros(len(node), np.int64)
        if len(own) and len(far):
            for u, v in tile_pairs(x[own], x[far], threshold, i == j):
                u, v = own[u], far[v]
                np.add.at(sums, u, w[v])
                np.add.at(sums, v, w[u])
                join(root, u, v)
        linked, below = np.flatnonzero(sums), np.flatnonzero(root != np.arange(len(node)))
        none = np.zeros(len(below), np.int64)
        return pa.table({"a": np.r_[node[linked], node[root[below]]], "b": np.r_[node[linked], node[below]], "n": np.r_[sums[linked], none]})

    tasks = blocks * (blocks + 1) // 2
    return dealt.repartition(min(tasks, 100_000), "task").groupBy("task").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors link if their cosine is the threshold or more; those of different
    lengths never do. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing and is its own component. Repeated
    rows are separate vectors that link with each other. Other columns are not
    read; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    stored = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", stored.alias("v")).withColumn("ok", usable(F.col("v")))
    good = rows.filter("ok")
    nodes = cut(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n_equal")).withColumn("node", F.monotonically_increasing_id()))
    of = good.select("vec_id", "v").join(nodes.select("v", "node"), "v").select("vec_id", "node")
    found = []
    for r in nodes.select(F.size("v").alias("d")).distinct().collect():  # vectors' lengths
        found.append(links(nodes.filter(F.size("v") == r["d"]).select("node", "v", F.col("n_equal").alias("w")), threshold, block_rows))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = cut(every)
    degree = every.filter("a = b").groupBy("a").agg(F.sum("n").alias("far"))
    parts = components(every.filter("a <> b").select("a", "b"))
    small = nodes.select("node", "least", "n_equal").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut(small.groupBy("component").agg(F.min("least").alias("component_id")))
    state = small.join(least, "component").join(degree, small["node"] == degree["a"], "left").select("node", (F.col("n_equal") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id")
    linked = of.join(state, "node").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
