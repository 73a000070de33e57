"""The near-dedup stage: SimHash links and what a fingerprint cannot reach, both checked by similarity.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Rows with equal sets are one node. Candidates are

1.  the links of the SimHash operator over the same shingles (``simhash.links``:
    pigeonring index, chain filter, Hamming check), and
2.  nodes that share one band of a MinHash signature (40 bands of 5 minima),
    because at similarity 0.8 fingerprints are some ten bits of 64 apart, which
    no index of fingerprints serves: a pair at 0.8 shares no band with a chance
    of 1.3e-7, at 0.85 with 2e-10.

No link counts before it is verified on the whole sets. A band's members are
first tied to one of them, the one that shares most bands with others, and what
verifies is joined into components. Of bands that then hold several components,
the pairs that lie in different ones are left. They are bounded before their
sets are fetched: of a node's shingles only those that another such node holds
too can be common, and these are counted in ``PARTS`` parts by hash, so the sum
of the lesser counts bounds what a pair shares. Only pairs that the bound lets
through are verified; none that reaches the threshold is left out. Members of a
large group of copies are thus compared with one of them, and texts that have
too much of their own with none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import components
from .simhash import links as simhash_links
from .simhash import majority

BANDS, ROWS = 40, 5
SHINGLE = 5
THRESHOLD = (4, 5)
PARTS = 64
_rng = np.random.default_rng(42)
_FLIPS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The XXH64 of the distinct shingles, sorted; fewer words than ``size`` are one shingle, no words none."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[size - 1 :].tolist() if len(words) >= size else [len(joined)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """One key for each band of the MinHash signature of a set; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, node, n, fp, bands): the digest of each row's set of shingles, its size, its SimHash and its band keys."""

    def run(batches):
        for batch in slices(batches):
            node, n, prints, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                prints.append(majority(found))
                keys.append(np.array(bands(found), np.uint64).view(np.int64))
            as_longs = (np.array(x, np.uint64).view(np.int64) for x in (node, prints))
            node, prints = map(pa.array, as_longs)
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(n, pa.int64()), prints, pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "n", "fp", "bands"])

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node long, n long, fp long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, found): the shingles of ``texts`` (node, text)."""

    def run(batches):
        for batch in slices(batches):
            found = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    return texts.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, found array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Which of ``pairs`` (a, b) are as similar as THRESHOLD or more."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("found").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.filter(_enough(F.col("common"), F.col("total"))).select("a", "b")


def _enough(common, total):
    """Whether sets of ``total`` shingles together, ``common`` of them shared, reach the threshold."""
    return common * (THRESHOLD[0] + THRESHOLD[1]) >= total * THRESHOLD[0]


def _counted(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, parts): of each member's shingles those that another member holds too, counted by hash in PARTS parts. Members for whom even all of these are too few are left out."""

    def run(batches):
        for batch in slices(batches):
            shared = batch.column(2)
            flat, ends = np.asarray(shared.flatten()), np.cumsum([0, *(len(x) for x in shared)])
            parts = [np.bincount(flat[a:b] & (PARTS - 1), minlength=PARTS).astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], names=["node", "n_shared", "parts"])

    each = sets.join(members, "node").select("node", F.size("found").alias("n"), F.explode("found").alias("x"))
    shared = each.groupBy("x").agg(F.count("*").alias("holders")).filter("holders > 1").select("x")
    mine = each.join(shared, "x").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("n_shared"), F.collect_list("x").alias("shared"))  # one text's shingles
    mine = mine.filter(F.col("n_shared") * THRESHOLD[1] >= F.col("n") * THRESHOLD[0])
    return mine.select("node", "n_shared", "shared").mapInArrow(run, "node long, n_shared long, parts array<int>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """id, component_id, n_equal (rows of that id) for every row of ``docs`` (id, text): the smallest id reachable over links.

    Null, empty and blank texts have no shingles and are equal. Repeated rows
    are kept and share a component. An empty table gives an empty result.
    """
    keyed = cut(_keyed(docs))
    nodes = cut(keyed.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    by_print = simhash_links(nodes.select("fp").distinct())
    one = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    of_print = lambda c: one.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    near = by_print.join(of_print("a"), "a").join(of_print("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    near = cut(near.unionByName(nodes.join(one.withColumnRenamed("node", "b"), "fp").filter("node > b").select(F.col("b").alias("a"), F.col("node").alias("b"))))

    filed = nodes.select(F.explode("bands").alias("band"), "node", "n")
    members = filed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    filed = cut(filed.join(members, "band"))
    standing = filed.groupBy("node").agg(F.sum("members").alias("standing"))
    filed = filed.join(standing, "node").select("band", "node", "n", "standing")
    hubs = filed.groupBy("band").agg(F.max(F.struct("standing", "node", "n")).alias("c")).select("band", F.col("c.node").alias("hub"), F.col("c.n").alias("hub_n"))
    met = standing.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.select("node", "least"), "node")
    sets = cut(_sets(docs.join(met, docs["id"].eqNullSafe(met["least"])).select("node", docs["text"]).dropDuplicates(["node"])))

    tied = filed.join(hubs, "band").filter((F.col("node") != F.col("hub")) & _sizes_allow(F.col("n"), F.col("hub_n"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    tied = cut(tied.unionByName(near).distinct())
    links = cut(_verified(tied, sets))
    known = cut(components(links))

    placed = filed.join(known, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("of"))
    mixed = placed.groupBy("band").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("band")
    placed = cut(placed.join(mixed, "band", "left_semi"))
    counted = _counted(placed.select("node").distinct(), sets)
    placed = cut(placed.join(counted, "node"))
    other = placed.select("band", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "of", "n_shared", "parts")])
    total = F.col("n") + F.col("n2")
    bound = F.aggregate(F.zip_with("parts", "parts2", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    may = (F.col("node") < F.col("node2")) & (F.col("of") != F.col("of2")) & _sizes_allow(F.col("n"), F.col("n2")) & _enough(F.least("n_shared", "n_shared2"), total)
    apart = placed.alias("p").join(other.alias("o"), (F.col("p.band") == F.col("o.band")) & may & _enough(bound, total))
    apart = apart.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(tied, ["a", "b"], "left_anti")
    # what these pairs join are components: few nodes, named by their smallest one
    part = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    more = _verified(apart, sets).join(part("a"), "a", "left").join(part("b"), "b", "left")
    joined = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    placed = nodes.select("node", "least").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    placed = placed.select("node", "least", F.coalesce("whole", "component").alias("component"))
    of = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    return keyed.select("id", "node").join(placed.join(of, "component").select("node", "component_id"), "node").select("id", "component_id")


def _sizes_allow(m, n):
    return F.least(m, n) * THRESHOLD[1] >= F.greatest(m, n) * THRESHOLD[0]


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the smallest doc_id (a null only where there is no other), then text checksum. Rows equal in both are one."""
    me = F.struct(docs["doc_id"].isNull().alias("unnamed"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"))
    found = near_duplicates(docs.select(me.alias("id"), docs["text"].alias("text")))
    kept = found.filter(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count("*").alias("rows"))
    both = docs.select(F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), me.alias("me")).join(kept, F.col("me").eqNullSafe(F.col("id")))
    many = both.filter("rows > 1").dropDuplicates(["me"])  # only these are dealt out again
    return both.filter("rows = 1").unionByName(many).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
