"""Substring dedup by relative Lempel-Ziv parsing over words.

The corpus is its own reference, indexed in blocks (the buckets of the sparse
phrase index in ``repeats``). A document is factored against all of them at
once: each phrase of ``window`` words that stands elsewhere has a source there,
a text and a place. A factor begins at such a phrase and greedily goes on while
the next phrase has its source right behind; there the factor ends, and is a
verbatim copy of what its source holds. Phrases across a factor's end are looked
up like any other and begin the next one, so no window that straddles two
factors is missed. All factors have ``window`` words or more, and their words
are the duplicate spans.

The source of a phrase is the first of its places in its block (the second for
the first one itself), by text and place, so phrases that follow one another in
several texts have sources that do so too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .repeats import Scheme, repeated, unpacked

SCHEME = Scheme(words=True, window=35, gram=6, block=10)


def factors(found: list[int] | None, others: list[int] | None, ats: list[int] | None, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors: (from word, to word, source text, source word). They may overlap by less than a window."""
    out: list[list[int]] = []  # from, past the last phrase, source, source word
    for packed, other, at in sorted(zip(found or (), others or (), ats or ())):
        lo, hi = packed >> 32, (packed >> 32) + ((packed >> 16) & 0xFFFF)  # phrases lo .. hi - 1 have sources
        if out and lo < out[-1][1]:
            lo, at = out[-1][1], at + out[-1][1] - lo
            if lo >= hi:
                continue
        if out and lo == out[-1][1] and (other, at - lo) == (out[-1][2], out[-1][3] - out[-1][0]):
            out[-1][1] = hi
        else:
            out.append([lo, hi, other, at])
    return [(lo, hi - 1 + window, other, at) for lo, hi, other, at in out]


FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])


def deduplicate(docs: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """id, n_words, n_removed, factors, kept, kept_sha256 per row of ``docs`` (id, text).

    ``factors`` are structs (start, end, source, source_start) in words;
    ``source`` is the XXH64 of the source's id and text, as Spark computes it.
    Words are runs of anything but ASCII white space, unchanged; kept ones are
    joined by one space. A null text has none. Texts shorter than the window
    lose nothing; equal rows lose what they share, and may be each other's
    source. An empty table gives an empty result.
    """

    def run(batches):
        for batch in slices(batches):
            out = []
            for z, *found in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                words = unpacked(z).split()
                parsed = factors(*found, scheme.window)
                gone = np.zeros(len(words), bool)
                for lo, hi, *_ in parsed:
                    gone[lo:hi] = True
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if parsed else b" ".join(words)
                named = [dict(zip(("start", "end", "source", "source_start"), f)) for f in parsed]
                out.append((len(words), int(gone.sum()), named, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(FACTOR), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["id", "n_words", "n_removed", "factors", "kept", "kept_sha256"])

    kind = docs.schema["id"].dataType.simpleString()
    return repeated(docs, scheme).mapInArrow(run, f"id {kind}, n_words long, n_removed long, factors array<struct<start:int,end:int,source:long,source_start:int>>, kept string, kept_sha256 string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY seq) > 1
), g AS (
  SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM r
), k AS (
  SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
