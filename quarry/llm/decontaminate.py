"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of documents is a shard. Its words become numbers of the
benchmark's vocabulary (0 for any other word), and the suffixes that could
begin a window are sorted by their leading words: the shard's suffix array.
Every test suffix is then binary-searched in it; the range it finds holds all
places where its window occurs word for word, and neighbouring finds on one
diagonal join into the longest verbatim match.

The benchmark is sent to the executors in blocks of ``block_bytes`` of text at
most, so no broadcast grows with it; documents are never shuffled.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

WINDOW = 13
BLOCK_BYTES = 32 << 20
SHARD_WORDS = 2_000_000


@lru_cache(maxsize=1)
def _fold() -> bytes:
    """Bytes as they count: A-Z lower-cased, what separates words a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out)


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_fold()).split()


class Tests:
    """The windows of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        rows, where = [], []
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for item, (name, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1) if n else ():
                rows.append(ids[at : at + n] + [0] * (window - n))
                where.append((n, number[name], item, at))
        self.keys = np.array(rows, np.uint32).reshape(len(rows), window)
        self.length, self.name, self.item, self.at = (np.array([x[k] for x in where], np.int64) for k in range(4))
        self.low = _packed(self.keys)
        self.high = _packed(np.where(np.arange(window) < self.length[:, None], self.keys, np.uint32(0xFFFFFFFF)))
        self.starts = [(int(n), np.unique(self.keys[self.length == n, 0])) for n in np.unique(self.length)]


def _packed(keys: np.ndarray) -> np.ndarray:
    """Rows of word numbers as strings of bytes that sort as the rows do."""
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * keys.shape[1]}").ravel() if len(keys) else np.empty(0, f"S{4 * keys.shape[1]}")


def suffix_array(ids: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ids`` where a window could begin, sorted by their leading words, and those words packed."""
    n, window = len(ids), tests.window
    gaps = np.flatnonzero(ids == 0)
    run = gaps[np.searchsorted(gaps, np.arange(n))] - np.arange(n)  # known words from here on; the last id is a gap
    possible = np.zeros(n, bool)
    lead = np.zeros(len(tests.vocabulary) + 1, bool)
    for length, starts in tests.starts:
        lead[:] = False
        lead[starts] = True
        possible |= (run >= length) & lead[ids]
    places = np.flatnonzero(possible)
    keys = np.zeros((len(places), window), np.uint32)
    for k in range(window):
        ok = run[places] > k
        keys[ok, k] = ids[places[ok] + k]
    packed = _packed(keys)
    order = np.argsort(packed, kind="stable")
    return places[order], packed[order]


def search(ids: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(place, test) of every occurrence of a window."""
    places, packed = suffix_array(ids, tests)
    lo, hi = np.searchsorted(packed, tests.low, "left"), np.searchsorted(packed, tests.high, "right")
    found = hi - lo
    test = np.repeat(np.arange(len(lo)), found)
    offset = np.arange(len(test)) - np.repeat(np.cumsum(found) - found, found)
    return places[lo[test] + offset], test


def longest(place: np.ndarray, test: np.ndarray, tests: Tests) -> np.ndarray:
    """Of each occurrence, the words of the verbatim match it is part of."""
    if not len(place):
        return place
    item, at, n = tests.item[test], tests.at[test], tests.length[test]
    order = np.lexsort((place, place - at, item))
    p, d, i = place[order], (place - at)[order], item[order]
    begins = np.r_[True, (np.diff(p) != 1) | (np.diff(d) != 0) | (np.diff(i) != 0)]
    run = np.cumsum(begins) - 1
    out = np.empty(len(place), np.int64)
    out[order] = (np.bincount(run) - 1)[run] + n[order]
    return out


def _scan(texts: list[str | None], tests: Tests) -> list[tuple[int, list[int], list[str], int]]:
    """Of each text: number of words, hit spans as flat (from, to) pairs, items found, longest match."""
    numbered = [np.fromiter((tests.vocabulary.get(w, 0) for w in ws), np.int64, len(ws)) for ws in map(words, texts)]
    sizes = np.array([len(x) for x in numbered], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, x in zip(base, numbered):
        ids[b : b + len(x)] = x
    place, test = search(ids, tests) if len(tests.low) else (np.empty(0, np.int64),) * 2
    match = longest(place, test, tests)
    out: list = [(int(n), [], [], 0) for n in sizes]
    if len(place):
        doc = np.searchsorted(base, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0, True])
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            d = int(doc[own[0]])
            marks = np.zeros(int(sizes[d]) + 1, np.int64)
            np.add.at(marks, place[own] - base[d], 1)
            np.add.at(marks, place[own] - base[d] + tests.length[test[own]], -1)
            hit = np.diff(np.r_[0, (np.cumsum(marks) > 0).astype(np.int8), 0])
            spans = np.column_stack([np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)]).ravel().tolist()
            out[d] = (int(sizes[d]), spans, [tests.names[k] for k in np.unique(tests.name[test[own]])], int(match[own].max()))
    return out


def _joined(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of flat spans."""
    spans = sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])])
    out: list[int] = []
    for lo, hi in spans:
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, text, n_words, hit_spans (flat from/to word pairs), items, longest_match, for every row of ``docs`` (id, text).

    A null or empty text has no words; an item without words finds nothing; a
    null item_id is named "null"; items of one id count once. Documents and
    items may repeat. Empty tables give no rows, or rows without hits.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    sc = docs.sparkSession.sparkContext
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text string, n_words long, hit_spans array<int>, items array<string>, longest_match int"
    found = docs.select("id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest_match"))
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent = sc.broadcast([(r["item"], r["text"]) for r in block.collect()])  # block_bytes on average

        def run(batches, sent=sent):
            tests = Tests(sent.value, window)
            for batch in slices(batches, 4096):
                lengths = batch.column(1).to_pylist()
                at = 0
                while at < len(lengths):
                    end, chars = at, 0
                    while end < len(lengths) and chars < 4 * SHARD_WORDS:
                        chars += len(lengths[end] or "")
                        end += 1
                    part = batch.slice(at, end - at)
                    got = _scan(lengths[at:end], tests)
                    had = zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist())
                    now = [(n, _joined(s0, s), sorted({*i0, *i}), max(m0, m)) for (n, s, i, m), (s0, i0, m0) in zip(got, had)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *(pa.array([x[j] for x in now], t) for j, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())))],
                        names=["id", "text", "n_words", "hit_spans", "items", "longest_match"],
                    )
                    at = end

        found = found.mapInArrow(run, schema)
        if k + 1 < blocks:
            found = cut(found)
    return found


def _judged(found: DataFrame) -> DataFrame:
    signed = F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One digest row per document: hits, items found, verdict, longest match."""
    found = _judged(find(docs.select(F.col("doc_id").alias("id"), "text"), benchmark, window))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest_match",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.0) -> DataFrame:
    """The documents without a benchmark hit, with all their columns.

    Every document that holds a window of an item goes, however long it is. A
    ``min_share`` above 0 spares those of whose words a smaller share is hit.
    Null and empty texts stay; an empty benchmark keeps everything.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    others = [docs[c].alias(n) for c, n in zip(docs.columns, names) if c != "text"]
    rows = docs.select(F.struct(*others).alias("id"), docs["text"].alias("text"))
    kept = _judged(find(rows, benchmark, window)).filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(min_share) * F.col("n_words")))
    return kept.select(*[(F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"id.{n}")).alias(c) for c, n in zip(docs.columns, names)])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), t AS (
  SELECT item, n, array_to_string(w[i:i + n - 1], ' ') AS seq FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS seq FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t))
), h AS (
  SELECT DISTINCT doc_id, i, n, item FROM s JOIN t USING (n, seq)
), g AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS word FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)
"""
