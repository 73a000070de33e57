"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits, cut into 16 segments of 4 bits on a ring. If two of
them differ in at most 4 bits, the pigeonring principle promises a segment
from which every chain of consecutive segments keeps to its share of the
budget: a chain of n segments differs in at most ``n * 4 / 16`` bits. So the
first three segments of that chain are equal and the next four differ in one
bit at most, hence three of these four are equal too.

The index follows from that: each fingerprint is filed under every ring start
and every one of the four segments that may differ, by the other six segments
of the chain (24 bits). Very many fingerprints are filed by longer chains (see
``chains``), lest unrelated ones meet. Fingerprints that meet under a key are candidates; the
whole chain condition prunes them before the full Hamming check.

Equal fingerprints are one node with a count, so copies never multiply. In a
key's group the links are reduced to a spanning forest as they are found. A
group beyond ``group_limit`` is not compared pairwise: its fingerprints are
linked through midpoints instead (two fingerprints at distance 4 or less have
a common fingerprint at distance 2 or less from both; all that share a
midpoint are within 4 of each other), which costs a constant per fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table
from .components import components

SEGMENTS, WIDTH = 16, 4
GROUP_LIMIT = 4096
LEVEL_1 = 1 << 27  # distinct fingerprints, eight to a key of 24 bits
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the XXH64 of every shingle; no words give 0."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(id, fp) for every row of ``docs`` (id, text)."""

    def run(batches):
        for batch in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def chains(level: int) -> list[tuple[int, ...]]:
    """Which places of a chain make up a key, one tuple for each way in which its segments may differ.

    Level 1: the first three are equal and one of the next four may differ
    (24 bits). Level 2: of the next eight two may differ, not both of the
    first four (36 bits).
    """
    if level == 1:
        return [(0, 1, 2, *(p for p in range(3, 7) if p != k)) for k in range(3, 7)]
    apart = [(a, b) for a, b in combinations(range(3, 11), 2) if b > 6]
    return [(0, 1, 2, *(p for p in range(3, 11) if p not in pair)) for pair in apart]


def level_for(n: int) -> int:
    """Keys so long that ``n`` unrelated fingerprints seldom meet under one; either level finds all links."""
    return 1 if n <= LEVEL_1 else 2


def ring_keys(fps: np.ndarray, level: int = 1) -> np.ndarray:
    """Index keys, one row for each fingerprint: the segments of a chain, the ring start and the way (the lowest 12 bits)."""
    seg = (fps[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH))) & np.uint64(15)
    ways = chains(level)
    out = np.empty((len(fps), SEGMENTS * len(ways)), np.int64)
    for start in range(SEGMENTS):
        for w, places in enumerate(ways):
            key = np.zeros(len(fps), np.uint64)
            for p in places:
                key = (key << np.uint64(WIDTH)) | seg[:, (start + p) % SEGMENTS]
            out[:, start * len(ways) + w] = ((key << np.uint64(12)) | np.uint64(start << 8 | w)).view(np.int64)
    return out


def ring_pass(x: np.ndarray, start: int, budget: int = 4) -> np.ndarray:
    """Which XORs keep every chain from ``start`` within its share of the budget."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n in range(1, SEGMENTS + 1):
        s = (start + n - 1) % SEGMENTS
        total += np.bitwise_count((x >> np.uint64(s * WIDTH)) & np.uint64(15))
        ok &= total <= n * budget // SEGMENTS
    return ok


def linked(x: np.ndarray, start: int, budget: int = 4) -> np.ndarray:
    """The chain condition first, then the full Hamming check on what it leaves."""
    ok = np.flatnonzero(ring_pass(x, start, budget))
    return ok[np.bitwise_count(x[ok]) <= budget]


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect what the group's links connect. A member is compared with those only that it isn't joined to yet."""
    root = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        apart = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        found = apart[linked(fps[apart] ^ fps[i], start)]
        if len(found):
            roots, first = np.unique(root[found], return_index=True)
            out += [(i, int(j)) for j in found[first]]
            root[np.isin(root, roots)] = root[i]
    return out


MIDPOINT_FLIPS = np.array([0, *(1 << a for a in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))], np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def links(distinct: DataFrame, group_limit: int = GROUP_LIMIT, level: int | None = None) -> DataFrame:
    """(a, b) fingerprints whose closure is that of all pairs at distance 4 or less."""
    level = level or level_for(distinct.count())
    ways = SEGMENTS * len(chains(level))

    def file(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1024):
                part = fps[at : at + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(ring_keys(part, level).ravel()), _signed(np.repeat(part, ways))], names=["k", "fp"])

    def compare(batches):
        key, held, full = None, [], False

        def ended():
            fps = np.array(held, np.int64).view(np.uint64)
            start = (key >> 8) & 15
            return [(int(fps[i]), int(fps[j])) for i, j in forest(fps, start)]

        for batch in batches:
            ks, fs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1], True])
            a, b = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if key is not None and ks[lo] != key:
                    if not full and len(held) > 1:
                        for x, y in ended():
                            a.append(x), b.append(y)
                    held, full = [], False
                key = int(ks[lo])
                if full:
                    a += fs[lo:hi].view(np.uint64).tolist()
                    b += fs[lo:hi].view(np.uint64).tolist()
                    continue
                held += fs[lo:hi].tolist()
                if len(held) > group_limit:  # a fingerprint linked to itself asks for midpoints
                    wide = np.array(held, np.int64).view(np.uint64).tolist()
                    a += wide
                    b += wide
                    held, full = [], True
            yield pa.RecordBatch.from_arrays([_signed(np.array(a, np.uint64)), _signed(np.array(b, np.uint64))], names=["a", "b"])
        if key is not None and not full and len(held) > 1 and (last := ended()):
            yield pa.RecordBatch.from_arrays([_signed(np.array([x for x, _ in last], np.uint64)), _signed(np.array([y for _, y in last], np.uint64))], names=["a", "b"])

    def midpoints(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64]
                yield pa.RecordBatch.from_arrays([_signed((part[:, None] ^ MIDPOINT_FLIPS).ravel()), _signed(np.repeat(part, len(MIDPOINT_FLIPS)))], names=["m", "fp"])

    keys = distinct.mapInArrow(file, "k long, fp long")
    found = cut(keys.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(compare, "a long, b long").distinct())
    wide = found.filter("a = b").select(F.col("a").alias("fp"))
    stars = wide.mapInArrow(midpoints, "m long, fp long").groupBy("m").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).filter("n > 1")
    through = wide.mapInArrow(midpoints, "m long, fp long").join(stars.select("m", "a"), "m").filter("fp > a").select("a", F.col("fp").alias("b")).distinct()
    return found.filter("a <> b").unionByName(through)


def near_duplicates(docs: DataFrame, shingle: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """id, fp, component_id, n_equal (rows of that fingerprint) for every row of ``docs`` (id, text).

    ``component_id`` is the smallest id reachable over links of 4 bits or
    less. Null, empty and blank texts have fingerprint 0 and link like any
    other. Repeated rows are kept and share a component; a null id is never
    the smallest unless a component has no other. An empty table gives an
    empty result.
    """
    fps = cut(fingerprints(docs, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_equal")))
    found = components(links(distinct.select("fp"), group_limit))
    nodes = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", "n_equal", F.coalesce("component", "fp").alias("component"))
    of = cut(nodes.groupBy("component").agg(F.min("least").alias("component_id")))  # a table of its own, so that a large component is split in the join
    return fps.join(nodes.join(of, "component").select("fp", "n_equal", "component_id"), "fp").select("id", "fp", "component_id", "n_equal")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_equal")
