"""Which windows of W tokens also start anywhere else, over a whole corpus.

Shared by the byte and the word operator. All decisions come from a sparse
suffix array: suffixes are taken at places that the text itself chooses, are
range-partitioned by sampled splitters of their leading tokens, sorted inside
their bucket, and compared with their neighbours, across bucket boundaries too.

1.  In every window the gram with the smallest hash is the window's anchor, so
    equal windows have equal anchors. Windows of one anchor are taken in blocks
    of ``block`` consecutive starts. A block has a core (what all its windows
    contain) and a whole (what they cover together); its suffix starts with the
    core. Sorted neighbours then tell that the whole is repeated (all windows
    are), that the core is not (no window is), or neither: an edge.
2.  Only the windows of edge blocks, and of one block for each repeated whole
    that shares its core with others, become suffixes of their own, which are
    partitioned, sorted and compared in the same way.
3.  The windows found are joined back to the texts. Texts travel compressed,
    one by one, which is less than what shuffles make of them.

A suffix is represented by its leading tokens and fingerprints of its longer
prefixes (96 bits and more), so a row has a fixed size. Splitters hold a salt
as their last key: a suffix that is a third of all rows is spread over as many
buckets as it fills. No step gathers a suffix's occurrences; every row needs
its two neighbours only. Of each bucket, two rows go to the driver. There are
as many buckets as BUCKET_ROWS asks for, MAX_BUCKETS at most: a tenfold bucket
(10**12 suffixes, some 30 TB of text) is still one array of 36 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 30
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 21  # texts longer than this are taken a piece at a time
BUCKET_ROWS = 100_000
MAX_BUCKETS = 1_000_000
SAMPLE_PER_BUCKET = 50
SAMPLE_ROWS = 4_000_000  # at most; they go to the driver
SAMPLE_TEXTS = 2500  # at least, and two thousandths of all


@dataclass(frozen=True)
class Scheme:
    words: bool  # tokens are words, else bytes
    window: int
    gram: int
    block: int

    @property
    def span(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            _powers[k] = np.r_[U64(1), np.multiply.accumulate(np.full(max(n, 2 * CHUNK_BYTES), b, U64))]
    return _powers[0], _powers[1]


class Rolling:
    """Fingerprints of any range of a token array."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens) + 1)
        self.sums = np.empty(len(tokens) + 1, U64)
        self.sums[0] = 0
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def tokenise(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in one array, where each text's tokens begin (and the last ones end), and 32 leading bits at each token.

    These bits are the first four bytes, or 16 bits of the first two words' hashes each.
    """
    if not words:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        return BYTE_HASH[raw], np.cumsum([0, *map(len, texts)]), _leading(raw, 8, 4)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = np.r_[False, (raw != 32) & ((raw < 9) | (raw > 13)), False]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = flips[::2], flips[1::2]
    tokens = mix(Rolling(BYTE_HASH[raw])(lo, hi) + (hi - lo).astype(U64))
    return tokens, np.searchsorted(lo, text_at), _leading((tokens >> U64(48)).astype(np.uint32), 16, 2)


def _leading(tokens: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The next ``count`` tokens at each place, ``bits`` of each, the first one highest; zeros behind the last."""
    padded = np.concatenate([tokens.astype(np.uint32), np.zeros(count, np.uint32)])
    out = np.zeros(len(tokens), np.uint32)
    for k in range(count):
        out = (out << np.uint32(bits)) | padded[k : k + len(tokens)]
    return out


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _parts(raw: bytes, words: bool) -> Iterator[bytes]:
    """A long text in parts that no word crosses."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        if words and end < len(raw):
            m = _BLANK.search(raw, end)
            end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end


def long_tokens(raw: bytes, scheme: Scheme, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens lo .. hi of a long text of bytes, with their leading bits."""
    tokens, _, leading = tokenise([raw[lo : hi + 3]], False)
    return tokens[: hi - lo], leading[: hi - lo]


def long_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All word tokens of a long text, with their leading bits: twelve bytes a word."""
    tokens = np.concatenate([tokenise([part], True)[0] for part in _parts(raw, True)])
    return tokens, _leading((tokens >> U64(48)).astype(np.uint32), 16, 2)


def long_blocks(raw: bytes, scheme: Scheme) -> Iterator[dict[str, np.ndarray]]:
    """``blocks`` of one long text, a piece at a time. Each piece sees what surrounds it, so blocks come out as from the whole."""
    around = 2 * scheme.window + scheme.block
    tokens, leading = long_words(raw) if scheme.words else (None, None)
    n = len(tokens) if scheme.words else len(raw)
    for lo in range(0, n, PIECE_BYTES):
        hi = min(n, lo + PIECE_BYTES)
        a, b = max(0, lo - around), min(n, hi + around)
        t, l = (tokens[a:b], leading[a:b]) if scheme.words else long_tokens(raw, scheme, a, b)
        got = blocks(t, np.array([0, len(t)]), l, scheme)
        if got is not None:
            first = got["first"] + a
            own = (first >= lo) & (first < hi)
            yield {k: (first if k == "first" else v)[own] for k, v in got.items()}


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def blocks(tokens: np.ndarray, starts: np.ndarray, leading: np.ndarray, scheme: Scheme) -> dict[str, np.ndarray] | None:
    """Blocks of windows: text number, first window (in its text), number of windows, core and whole fingerprints."""
    n, w, c, k = len(tokens), scheme.window, scheme.block, scheme.gram
    if n < w:
        return None
    hash_ = Rolling(tokens)
    at = np.arange(n - k + 1)
    grams = hash_(at, at + k)
    low = U64((1 << PLACE_BITS) - 1)
    anchor = (sliding_min((grams & ~low) | at.astype(U64), scheme.span) & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    i = np.flatnonzero(text[: n - w + 1] == text[w - 1 :])
    if not len(i):
        return None
    a = anchor[i]
    b = (a - i) // c
    first = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(i) != 1)])
    count = np.diff(np.r_[first, len(i)])
    a, b, t, lead = a[first], b[first], text[i[first]], i[first]
    late, early = a - c * b, a - np.minimum(c * (b + 1) - 1, scheme.span - 1)
    core = _behind(leading[late], hash_(late, early + w))
    inside = (early >= starts[t]) & (late + w <= starts[t + 1])
    whole = hash_(np.where(inside, early, lead), np.where(inside, late, lead) + w)
    return {"text": t, "first": lead - starts[t], "count": count, "core": core, "whole": whole, "inside": inside}


def _behind(leading: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """32 bits of a fingerprint behind 32 bits of the leading tokens, so that suffixes sort by these first."""
    return (leading.astype(U64) << U64(32)) | (print_ >> U64(32))


def parcels(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts compressed: (id, uid, tag, z)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            z = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(z, pa.binary())], names=["id", "uid", "tag", "z"])

    return docs.select("id", "uid", "tag", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, uid long, tag int, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _chunks(batches, n_columns: int):
    """Lists of the columns, some CHUNK_BYTES of text at a time; the last column is the text, or its parcel."""
    held, size = [], 0
    for batch in slices(batches):
        for row in zip(*(batch.column(k).to_pylist() for k in range(n_columns))):
            text = unpacked(row[-1]) if isinstance(row[-1], bytes) else (row[-1] or "").encode("utf-8", "surrogatepass")
            if len(text) > PIECE_BYTES:
                yield [(x,) for x in (*row[:-1], text)]
                continue
            held.append((*row[:-1], text))
            size += len(text)
            if size >= CHUNK_BYTES:
                yield list(zip(*held))
                held, size = [], 0
    if held:
        yield list(zip(*held))


def _packed(first, count, tag) -> np.ndarray:
    return (np.asarray(first, np.int64) << 32) | (np.asarray(count, np.int64) << 16) | np.asarray(tag, np.int64)


def _sortable(*keys: np.ndarray) -> np.ndarray:
    return np.column_stack(keys).astype(">u8").view(f"S{8 * len(keys)}").ravel()


ROWS = "bucket int, core long, whole long, uid long, packed long"


def _rows(core, whole, uid, packed, splitters: np.ndarray | None) -> pa.RecordBatch:
    salt = mix(uid.view(U64) ^ packed.view(U64))
    bucket = np.zeros(len(core), np.int32) if splitters is None else np.searchsorted(splitters, _sortable(core, whole, salt), "right").astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, core.view(np.int64), whole.view(np.int64), uid, packed)], names=["bucket", "core", "whole", "uid", "packed"])


def block_rows(docs: DataFrame, scheme: Scheme, splitters=None) -> DataFrame:
    """Suffixes at the blocks of ``docs`` (uid, tag, text)."""

    def run(batches):
        cuts = None if splitters is None else splitters.value
        for uid, tag, texts in _chunks(batches, 3):
            if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
                parts = long_blocks(texts[0], scheme)
            else:
                parts = filter(None, [blocks(*tokenise(list(texts), scheme.words), scheme)])
            for got in parts:
                uids, tags = np.array(uid, np.int64)[got["text"]], np.array(tag, np.int64)[got["text"]]
                packed = _packed(got["first"], got["count"], tags)
                own = mix(uids.view(U64) * U64(3) + packed.view(U64))  # a block at a text's edge has no whole to share
                yield _rows(got["core"], np.where(got["inside"], got["whole"], own), uids, packed, cuts)

    return docs.select("uid", "tag", "text").mapInArrow(run, ROWS)


def window_rows(docs: DataFrame, scheme: Scheme, splitters=None) -> DataFrame:
    """Suffixes at every window of the edge blocks of ``docs`` (uid, tag, edges, z)."""

    def run(batches):
        cuts = None if splitters is None else splitters.value
        for uid, tag, edges, texts in _chunks(batches, 4):
            spans = np.concatenate([np.array(e, np.int64) for e in edges])
            owner = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
            first, count = spans >> 32, (spans >> 16) & 0xFFFF
            row = np.repeat(np.arange(len(spans)), count)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            own, uids, tags = owner[row], np.array(uid, np.int64), np.array(tag, np.int64)
            if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
                at = np.sort(at)
                words_ = long_words(texts[0]) if scheme.words else None
                for lo in range(0, int(at[-1]) + 1, PIECE_BYTES):
                    here = at[(at >= lo) & (at < lo + PIECE_BYTES)]
                    if len(here):
                        end = int(here[-1]) + scheme.window
                        tokens, leading = (x[lo:end] for x in words_) if scheme.words else long_tokens(texts[0], scheme, lo, end)
                        yield from _window_rows(Rolling(tokens), leading, here - lo, here, np.zeros(len(here), np.int64), uids, tags, scheme, cuts)
            else:
                tokens, starts, leading = tokenise(list(texts), scheme.words)
                yield from _window_rows(Rolling(tokens), leading, at + starts[own], at, own, uids, tags, scheme, cuts)

    return docs.select("uid", "tag", "edges", "z").mapInArrow(run, ROWS)


def _window_rows(hash_: Rolling, leading, i, first, own, uids, tags, scheme: Scheme, cuts) -> Iterator[pa.RecordBatch]:
    """Rows of the windows at places ``i`` of the tokens, which are the ``first``-th of text ``own``."""
    for lo in range(0, len(i), 1 << 18):
        k = slice(lo, lo + (1 << 18))
        core = _behind(leading[i[k]], hash_(i[k], i[k] + scheme.window))
        yield _rows(core, hash_(i[k], i[k] + scheme.window // 2), uids[own[k]], _packed(first[k], 1, tags[own[k]]), cuts)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; each further key is looked at only where all before it tie."""
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        tied = np.r_[same, False] | np.r_[False, same]
        run = np.cumsum(np.r_[True, ~same])[tied]
        part = order[tied]
        order[tied] = part[np.lexsort((key[part], run))]
        same &= key[order][1:] == key[order][:-1]
    return order


EDGE, MATCHED, FIRST, LAST = 0, 1, 2, 3
FOUND = "kind int, bucket int, core long, whole long, uid long, packed long"
SOURCE = ", other long, at long"


def _compared(bucket: pa.Table, sources: bool = False) -> pa.Table:
    """Blocks of a bucket that are repeated inside it, and its first and last suffix.

    With ``sources``, each has another place (text and first window) of its
    whole: the first one by text and window, for that one the second.
    """
    core, whole, uid, packed = (bucket.column(c).to_numpy() for c in ("core", "whole", "uid", "packed"))
    order = multikey_order([core.view(U64), whole.view(U64), *((uid, packed) if sources else ())])
    core, whole, uid, packed = (x[order] for x in (core, whole, uid, packed))
    core_same = core[1:] == core[:-1]
    whole_same = core_same & (whole[1:] == whole[:-1])
    known = np.r_[core_same, False] | np.r_[False, core_same]
    kind = np.where(np.r_[whole_same, False] | np.r_[False, whole_same], MATCHED, EDGE)
    # one of each repeated whole stands in for it if its core has other wholes too
    core_run, whole_run = np.cumsum(np.r_[0, ~core_same]), np.cumsum(np.r_[0, ~whole_same])
    mixed = np.bincount(core_run)[core_run] > np.bincount(whole_run)[whole_run]
    stand_in = np.flatnonzero(mixed & (kind == MATCHED) & np.r_[True, ~whole_same])
    pick = np.r_[np.flatnonzero(known), stand_in, 0, len(core) - 1]
    kind = np.r_[kind[known], np.full(len(stand_in), EDGE), FIRST, LAST].astype(np.int32)
    number = np.full(len(pick), bucket.column("bucket")[0].as_py(), np.int32)
    out = {"kind": kind, "bucket": number, "core": core[pick], "whole": whole[pick], "uid": uid[pick], "packed": packed[pick]}
    if sources:
        begins = np.flatnonzero(np.r_[True, ~whole_same])[whole_run]
        second = begins + np.r_[whole_same, False][begins]
        place = np.where(begins == np.arange(len(core)), second, begins)[pick]
        out |= {"other": uid[place], "at": packed[place] >> 32}
    return pa.table(out)


def neighbours(rows, sample: DataFrame, share: float, exact: bool, sources: bool = False) -> DataFrame:
    """(kind, uid, packed) of every suffix whose core, or with ``exact`` core and whole, is repeated; with ``sources`` also another place (other, at) of its whole.

    ``rows(splitters)`` makes the suffixes; ``sample`` is a ``share`` of them
    (by text), from which the splitters are drawn.
    """
    spark = sample.sparkSession
    n = sample.count()
    buckets = int(min(MAX_BUCKETS, max(24, n / share / BUCKET_ROWS)))
    thin = min(1.0, buckets * SAMPLE_PER_BUCKET / max(1, n), SAMPLE_ROWS / max(1, n))
    got = sample.select("core", "whole", "uid", "packed").filter(F.pmod(F.xxhash64("uid", "packed"), F.lit(1 << 20)) < int(thin * (1 << 20))).toPandas()  # SAMPLE_PER_BUCKET rows a bucket
    core, whole, uid, packed = (got[c].to_numpy(np.int64) for c in got.columns)
    keys = np.sort(_sortable(core.view(U64), whole.view(U64), mix(uid.view(U64) ^ packed.view(U64))))
    cuts = keys[np.linspace(0, len(keys), buckets + 1)[1:-1].astype(int)] if len(keys) >= buckets else keys
    found = cut(rows(spark.sparkContext.broadcast(cuts)).groupBy("bucket").applyInArrow(lambda bucket: _compared(bucket, sources), FOUND + SOURCE * sources))
    names = ["kind", "uid", "packed", *(["other", "at"] if sources else [])]
    ends = found.filter(F.col("kind") >= FIRST).toPandas().sort_values(["bucket", "kind"])  # two rows a bucket
    x, y = ends[ends["kind"] == LAST].iloc[:-1].reset_index(drop=True), ends[ends["kind"] == FIRST].iloc[1:].reset_index(drop=True)
    across = x["core"] == y["core"]
    kind = np.where(x["whole"] == y["whole"], MATCHED, EDGE)
    fixed = pd.concat([a.assign(kind=kind, other=b["uid"], at=b["packed"] // (1 << 32))[across][names] for a, b in ((x, y), (y, x))]).astype("int64")
    fixed = spark.createDataFrame(fixed, ", ".join(f"{c} long" for c in names)).withColumn("kind", F.col("kind").cast("int"))
    found = found.filter(F.col("kind") < FIRST).select(*names).unionByName(fixed)
    return found.filter(F.col("kind") == MATCHED) if exact else found


def _listed(found: DataFrame, name: str) -> DataFrame:
    tag = F.col("packed").bitwiseAND(0xFFFF).cast("int")
    lists = [F.collect_list(c).alias(n) for c, n in (("packed", name), ("other", "others"), ("at", "ats")) if c in found.columns]
    return found.groupBy("uid", tag.alias("tag")).agg(*lists)  # a text's own blocks


def repeated(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, z, found) of ``docs`` (id, text): each text as a parcel, and packed runs of its windows that also start elsewhere (null: none).

    For words there are also ``others`` and ``ats``, of each run another place
    where it stands: the text, as XXH64 of id and text, and the first window.

    Rows equal in id and text are told apart as little as they need to be:
    each has its windows repeated in the other. A null text has no tokens.
    """
    text = F.col("text").cast("string")
    docs = docs.select("id", text.alias("text"), F.xxhash64("id", text).alias("uid"), F.coalesce(F.crc32(text.cast("binary")).bitwiseAND(0xFFFF).cast("int"), F.lit(0)).alias("tag"))
    share = min(1.0, max(0.002, SAMPLE_TEXTS / max(1, docs.count())))

    def sampled(d: DataFrame) -> DataFrame:
        return d.filter(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))

    first = cut(neighbours(lambda s: block_rows(docs, scheme, s), block_rows(sampled(docs), scheme), share, False, scheme.words))
    edges = _listed(first.filter(F.col("kind") == EDGE).select("uid", "packed").distinct(), "edges")
    sample = window_rows(parcels(sampled(docs)).join(sampled(edges).hint("shuffle_hash"), ["uid", "tag"]), scheme)
    second = neighbours(lambda s: window_rows(parcels(docs).join(edges.hint("shuffle_hash"), ["uid", "tag"]), scheme, s), sample, share, True, scheme.words)
    found = _listed(first.filter(F.col("kind") == MATCHED).unionByName(second), "found")
    return parcels(docs).join(found.hint("shuffle_hash"), ["uid", "tag"], "left").select("id", "z", "found", *(["others", "ats"] if scheme.words else []))


def covered(found: list[int] | None, n: int, window: int) -> np.ndarray:
    """Which of a text's ``n`` tokens lie in a window that was found."""
    if not found:
        return np.zeros(n, bool)
    runs = np.array(found, np.int64)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, runs >> 32, 1)
    np.add.at(marks, (runs >> 32) + ((runs >> 16) & 0xFFFF) - 1 + window, -1)
    return np.cumsum(marks[:-1], dtype=np.int32) > 0


def spans(mask: np.ndarray) -> np.ndarray:
    """Maximal covered runs as (from, to) rows."""
    flips = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return flips.reshape(-1, 2)
