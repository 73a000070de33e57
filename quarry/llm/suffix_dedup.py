"""Suffix-array dedup of bytes.

A sparse suffix array over UTF-8 bytes (see ``repeats``): sampled splitters
range-partition the suffixes by leading bytes, buckets sort locally key by key,
and neighbours are compared inside buckets and across their boundaries. Every
byte covered by a ``window``-byte string that also starts elsewhere goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .repeats import Scheme, covered, repeated, spans, unpacked

SCHEME = Scheme(words=False, window=400, gram=32, block=64)


def deduplicate(docs: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (from, to), kept (binary), kept_sha256 per row of ``docs`` (id, text).

    A null text is empty. Texts shorter than the window lose nothing; equal
    rows lose what they share; strings never cross texts and are judged on the
    input. What is kept may split a character, so it is binary. An empty table
    gives an empty result.
    """

    def run(batches):
        for batch in slices(batches):
            out = []
            for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer(unpacked(z), np.uint8)
                mask = covered(found, len(raw), scheme.window)
                runs = spans(mask)
                kept = raw[~mask].tobytes()
                out.append((len(raw), int(mask.sum()), len(runs), runs.ravel().tolist(), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    kind = docs.schema["id"].dataType.simpleString()
    return repeated(docs, scheme).mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary, kept_sha256 string")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)
), r AS (
  SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1
), b AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS begins FROM r
), n AS (
  SELECT doc_id, i, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b
), p AS (
  SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM n GROUP BY doc_id, span
), q AS (
  SELECT doc_id, span, lo, hi, x, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY span), 0) AS past FROM p JOIN d USING (doc_id)
), k AS (
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * past + 1, 2 * (lo - past)), '' ORDER BY span) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM q GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
