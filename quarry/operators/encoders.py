"""Pluggable encoders, run over Arrow batches."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


class Encoder(Protocol):
    """Anything that turns texts into vectors; it is sent to the executors once."""

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row a text."""


class HashingEncoder:
    """A model-free encoder: signed feature hashing of words, at unit length."""

    def __init__(self, dims: int = 64, seed: int = 0):
        self.dims, self.seed = dims, seed

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word, self.seed)
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class BiEncoder:
    """Queries and passages by one shared encoder, or by two."""

    def __init__(self, query: Encoder, passage: Encoder | None = None):
        self.query, self.passage = query, passage or query


class Projection:
    """Linear map to fewer dimensions, then unit length; masked rows become zero."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.asarray(weights, float)

    def __call__(self, vectors: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        out = vectors @ self.weights.T
        out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out if mask is None else out * np.asarray(mask, float)[:, None]


def project(vectors: DataFrame, projection: Projection, vector: str = "v", mask: str | None = None) -> DataFrame:
    """``vectors`` with ``vector`` projected to fewer dimensions at unit length; rows that ``mask`` has at 0 become zero vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(projection)
    at, names = vectors.columns.index(vector), vectors.columns

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            if batch.num_rows:
                keep = None if mask is None else batch.column(names.index(mask)).to_numpy(zero_copy_only=False)
                v = sent.value(np.asarray(column.flatten(), float).reshape(batch.num_rows, -1), keep)
                column = pa.array(list(v), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(len(names))], names=names)

    kinds = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.filter(F.col(vector).isNotNull()).mapInArrow(run, kinds)


def encode_tokens(df: DataFrame, encoder: Encoder, id_col: str = "id", text_col: str = "text", limit: int = 220) -> DataFrame:
    """(id, pos, v): a vector for each of the first ``limit`` tokens of a text."""
    each = df.select(id_col, F.posexplode(F.slice(tokens(F.col(text_col)), 1, limit)).alias("pos", "token"))
    return encode(each.select(F.struct(id_col, "pos").alias("at"), "token"), encoder, "at", "token").select(f"at.{id_col}", "at.pos", "v")


def encode(df: DataFrame, encoder: Encoder, id_col: str = "id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id, v) of every row; a null text is encoded as an empty one."""
    sent = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                texts = [t or "" for t in rows.column(1).slice(at, batch).to_pylist()]  # as Python strings only a batch at a time
                v = np.asarray(sent.value.encode(texts), np.float32)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(at, batch), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "v"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, v array<float>").withColumnRenamed("id", id_col)
