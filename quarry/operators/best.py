"""The best k of each query: kept in tasks, shuffled as one row a query, cut again.

A task hands over (query_id, ids, scores) and no rows of one hit each, so that
nothing is sorted hit by hit: what a task holds is bounded by k and the block
of queries it was sent, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

PLACES = 9
CELLS = 1 << 20
PACKED_ROWS = 64


def order_of(scores: np.ndarray, ids: np.ndarray, k: int | None = None) -> np.ndarray:
    """Places of the ``k`` largest scores in order, as they are published, to PLACES places; equal ones go by id."""
    r = np.round(scores, PLACES)
    if k is None or len(r) <= k:
        return np.lexsort((ids, -r))
    pick = np.flatnonzero(~(r < np.partition(r, len(r) - k)[len(r) - k]))
    return pick[np.lexsort((ids[pick], -r[pick]))[:k]]


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries so far; larger is better."""

    def __init__(self, n: int, k: int):
        self.k, self.most = k, max(2 * k, 256)
        self.held, self.count, self.least = [[] for _ in range(n)], [0] * n, np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, hit: np.ndarray | None = None, rows: np.ndarray | None = None) -> None:
        """``scores``: one row a query, or the query that ``rows`` names, one column an id; only what ``hit`` marks counts."""
        step = max(1, CELLS // max(1, scores.shape[1]))
        for lo in range(0, len(scores), step):
            s = scores[lo : lo + step]
            number = np.arange(lo, lo + len(s)) if rows is None else rows[lo : lo + step]
            some = ~(s < (self.least[number] - 10.0**-PLACES)[:, None])
            q, at = np.nonzero(some if hit is None else some & hit[lo : lo + step])
            picked, names, edges = s[q, at], ids[at], np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else []
            for a, b in zip(edges[:-1], edges[1:]):
                self.add_one(number[q[a]], picked[a:b].copy(), names[a:b].copy())

    def add_one(self, q: int, s: np.ndarray, ids: np.ndarray) -> None:
        if len(s):
            self.held[q].append((s, ids))
            self.count[q] += len(s)
            if self.count[q] >= self.most:
                self.cut(q)

    def cut(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        s, ids = (np.concatenate(x) for x in zip(*self.held[q]))
        order = order_of(s, ids, self.k)
        s, ids = s[order], ids[order]
        self.held[q], self.count[q] = [(s, ids)], len(s)
        if len(s) == self.k:
            self.least[q] = np.round(s[-1], PLACES)
        return s, ids

    def packed(self, names: list, kinds: tuple) -> Iterator[pa.RecordBatch]:
        """Rows for ``merged``; ``kinds`` are ``id_kinds``."""
        some = [q for q in range(len(names)) if self.held[q]]
        for lo in range(0, len(some), PACKED_ROWS):
            rows = [(names[q], *self.cut(q)) for q in some[lo : lo + PACKED_ROWS]]
            yield pack([r[0] for r in rows], [len(r[1]) for r in rows], np.concatenate([r[2] for r in rows]), np.concatenate([r[1] for r in rows]), kinds)


def id_kinds(queries: DataFrame, docs: DataFrame) -> tuple[tuple, str]:
    """Types of query_id and doc_id for Arrow, and the schema of packed rows."""
    q, d = queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType
    return (to_arrow_type(q), to_arrow_type(d)), f"query_id {q.simpleString()}, ids array<{d.simpleString()}>, scores array<double>"


def pack(names: list, counts, ids: np.ndarray, scores: np.ndarray, kinds: tuple) -> pa.RecordBatch:
    """One row a name, with so many of ``ids`` and ``scores`` each."""
    edges = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(x, kind)) for x, kind in ((ids, kinds[1]), (scores, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(names, kinds[0]), *lists], names=["query_id", "ids", "scores"])


def merged(found: DataFrame, k: int | None, ascending: bool = False, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of packed rows, the best ``k`` of each query or all; ``ascending``: scores are distances, packed as their negatives."""
    q, d = found.schema["query_id"].dataType, found.schema["ids"].dataType.elementType
    kind = to_arrow_type(q)

    def cut(table: pa.Table) -> pa.Table:
        ids, s = (pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) for name in ("ids", "scores"))
        names, s, name = ids.to_numpy(zero_copy_only=False), s.to_numpy(), table.column("query_id")[0].as_py()
        kept = np.flatnonzero(names != name) if exclude_self else np.arange(len(s))
        order = kept[order_of(s[kept], names[kept], k)]
        scores = np.round(-s[order] if ascending else s[order], PLACES) + 0.0  # no -0
        return pa.table([pa.array([name] * len(order), kind), ids.take(pa.array(order)), pa.array(scores), pa.array(np.arange(1, len(order) + 1, dtype=np.int32))], names=["query_id", "doc_id", "score", "rank"])

    return found.groupBy("query_id").applyInArrow(cut, f"query_id {q.simpleString()}, doc_id {d.simpleString()}, score double, rank int")
