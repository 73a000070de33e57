"""Byte-level BPE over Arrow batches.

The ``tokenizers`` library works on printable characters, one per byte (the
byte table below); ids are the ranks of the ``.tiktoken`` file of the same
vocabulary. Token offsets come from the byte lengths of the tokens and a
byte-to-character map of the text. Decoding reverses the byte table, so tokens
that split a character join again before UTF-8 is read.

Texts are cut, for bounded memory only, at places where the split pattern
always ends a match (a letter or digit of ASCII before a space or line break),
so long texts give the ids they would give in one piece. Since every match of
the pattern is encoded separately, texts of Latin script are split here, and
each worker asks the library once for a match it has met before; texts with
other characters, of which Unicode versions may differ, go to it whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

PIECE_CHARS = 1 << 16
CALL_CHARS = 1 << 18
KNOWN_MATCHES = 200_000
_CUT = re.compile(r"(?<=[0-9A-Za-z])[ \n]")
_BEYOND = re.compile("[^\x00-\u024f]")
_SPACE = "\\t-\\r \\x85\\xa0"  # of the characters that are split here
#: The split pattern of the vocabulary (fixed value), white space written out.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_table() -> dict[str, int]:
    """Printable stand-in of each byte: itself if Latin-1 prints it, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load(model: str, ranks: str):
    """The tokenizer, its ids as ranks, and the bytes of every rank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.encode_special_tokens = True  # special strings in a text are ordinary text
    with open(ranks, "rb") as f:
        rank_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    table_ = byte_table()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    as_rank = np.zeros(max(vocabulary.values()) + 1, np.uint32)
    for token, i in vocabulary.items():
        if all(c in table_ for c in token) and (raw := bytes(table_[c] for c in token)) in rank_of:
            as_rank[i] = rank_of[raw]
    spelled = [b""] * (max(rank_of.values()) + 1)
    for raw, rank in rank_of.items():
        spelled[rank] = raw
    return tokenizer, as_rank, spelled


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Matches(dict):
    """Ids of matches met before, as little-endian bytes; those not met again for a while are forgotten."""

    def __init__(self, model: str, ranks: str):
        self.tokenizer, as_rank, _ = load(model, ranks)
        self.as_rank = None if (as_rank == np.arange(len(as_rank))).all() else as_rank
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        got = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.as_rank is not None:
            return [self.as_rank[np.array(x, np.int64)].astype("<u4").tobytes() for x in got]
        return [x.tobytes() for x in got] if sys.byteorder == "little" else [np.array(x, "<u4").tobytes() for x in got]

    def learn(self, matches: set[str]) -> None:
        """Have the ids of all ``matches``."""
        if len(self) > KNOWN_MATCHES:
            self.old = dict(self)
            self.clear()
        new = []
        for m in matches.difference(self):
            if m in self.old:
                self[m] = self.old[m]
            else:
                new.append(m)
        for at in range(0, len(new), 4096):
            self.update(zip(new[at : at + 4096], self.ids(new[at : at + 4096])))


@lru_cache(maxsize=1)
def _matches(model: str, ranks: str) -> Matches:
    return Matches(model, ranks)


def encode_texts(texts: list[str | None], model: str, ranks: str) -> Iterator[np.ndarray]:
    """The ids of each text, in order; None counts as empty."""
    known = _matches(model, ranks)
    pending: list[tuple[str, bool]] = []
    open_: list[bytes] = []
    chars = 0

    def flush():
        split = [None if _BEYOND.search(p) else _SPLIT.findall(p) for p, _ in pending]
        whole = iter(known.ids([p for (p, _), m in zip(pending, split) if m is None]))
        known.learn({x for m in split if m for x in m})
        for (_, last), m in zip(pending, split):
            open_.append(next(whole) if m is None else b"".join(map(known.__getitem__, m)))
            if last:
                yield np.frombuffer(b"".join(open_), "<u4")
                open_.clear()
        pending.clear()

    for text in texts:
        pieces = list(_pieces(text or ""))
        for k, piece in enumerate(pieces):
            pending.append((piece, k == len(pieces) - 1))
            chars += len(piece)
            if chars >= CALL_CHARS or len(pending) >= 1024:
                yield from flush()
                chars = 0
    yield from flush()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def decode_ids(ids: list[int], spelled: list[bytes]) -> bytes:
    return b"".join(map(spelled.__getitem__, ids))


def offsets(raw: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First and past-the-end character of each token, and how many tokens begin or end inside a character.

    ``raw`` is the text in UTF-8, ``lengths`` the bytes of every rank. A token
    that holds part of a character covers all of it.
    """
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    char_of = np.cumsum(begins, dtype=np.int32) - 1  # of each byte
    whole = begins[starts] & np.r_[begins, True][ends]
    return char_of[starts], char_of[ends - 1] + 1, int(len(ids) - whole.sum())


def _lengths(spelled: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in spelled], np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, ranks: str | None = None) -> DataFrame:
    """id, ids, starts and ends (character offsets) per row; a null text has no ids. Rows are kept as they are, repeated ones too."""
    model, ranks = model or default_paths()[0], ranks or default_paths()[1]

    def run(batches):
        lengths = _lengths(load(model, ranks)[2])
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            got = [x.astype(np.int32) for x in encode_texts(texts, model, ranks)]
            spans = [offsets(_bytes(t), i, lengths) for t, i in zip(texts, got)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got, pa.list_(pa.int32())), *(pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1))], names=["id", "ids", "starts", "ends"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, model: str | None = None) -> DataFrame:
    """id and text per row. Null ids give a null text; bytes that are not UTF-8 as a whole become U+FFFD."""
    model, ranks = model or default_paths()[0], ranks or default_paths()[1]

    def run(batches):
        _, _, spelled = load(model, ranks)
        for batch in slices(batches):
            texts = [None if ids is None else decode_ids(ids, spelled).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, ranks: str | None = None) -> DataFrame:
    """Encode every text, decode its ids, and digest both: id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, n_split.

    ``offsets_sha256`` is that of the tokens' first and past-the-end characters
    (little-endian unsigned 32-bit integers, all starts, then all ends),
    ``n_split`` counts the tokens that begin or end inside a character. A null text counts as empty; the ids of any id column are passed through,
    nulls too; an empty table gives an empty result.
    """
    model, ranks = model or default_paths()[0], ranks or default_paths()[1]

    def run(batches):
        _, _, spelled = load(model, ranks)
        lengths = _lengths(spelled)
        for batch in slices(batches):
            out = []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, encode_texts(texts, model, ranks)):
                starts, ends, split = offsets(_bytes(text), ids, lengths)
                places = np.concatenate([starts, ends]).astype("<u4").tobytes()
                decoded = decode_ids(ids.tolist(), spelled)
                out.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), decoded, places)), split))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long").withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
