"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is a fixed number of equal cells. Every shard owns ``vnodes`` of them
as virtual nodes; a key belongs to the first virtual node at or after its cell.
A shard holds at most its share of the rows. Keys beyond that continue
clockwise to the next virtual node whose shard has room, so the row counts of
any two shards differ by one at most, and a changed shard count moves little
more than the share of the shards that came or went.

Only the number of keys per cell (a constant number of integers, whatever the
input) reaches the driver, which turns them into rank intervals per cell; the
rows themselves are ranked inside their cell, by parts of it, and joined to the
intervals. Equal texts are no group here: the law is on row counts, so where a
row goes is up to its key.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CELL_BITS = 14
CELLS = 1 << CELL_BITS
SPLITS = 1024


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Virtual nodes as sorted (cell, shard); a taken cell passes a node on to the next free one."""
    if n_shards * vnodes > CELLS // 2:
        raise ValueError(f"{n_shards} shards of {vnodes} virtual nodes need more than {CELLS} cells")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = xxhash.xxh64_intdigest(f"shard {shard} node {v}") >> (64 - CELL_BITS)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(total: int, n_shards: int) -> list[int]:
    """Row counts at most one apart that add up to ``total``."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def flow(counts: dict[int, int], n_shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Where each cell's keys go: (cell, from rank, to rank, shard, first slot).

    A shard first takes the keys of its own arcs, clockwise; what is left over
    continues clockwise in the order it overflowed.
    """
    nodes = ring(n_shards, vnodes)
    room = capacities(sum(counts.values()), n_shards)
    used = [0] * n_shards
    placed, left = [], [[] for _ in nodes]

    def take(shard: int, cell: int, lo: int, hi: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n > 0:
            placed.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return lo + max(n, 0)

    at = np.searchsorted([c for c, _ in nodes], np.arange(CELLS)) % len(nodes)
    for cell in sorted(counts):
        k = int(at[cell])
        lo = take(nodes[k][1], cell, 0, counts[cell])
        if lo < counts[cell]:
            left[k].append((cell, lo, counts[cell]))
    waiting: deque = deque()
    for turn in range(2 * len(nodes)):  # once around with all overflow seen, once more to place it
        k = turn % len(nodes)
        while waiting and used[nodes[k][1]] < room[nodes[k][1]]:
            cell, lo, hi = waiting.popleft()
            lo = take(nodes[k][1], cell, lo, hi)
            if lo < hi:
                waiting.appendleft((cell, lo, hi))
        if turn < len(nodes):
            waiting.extend(left[k])
    assert not waiting
    return placed


def shard(docs: DataFrame, n_shards: int = 24, vnodes: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to a shard and a gapless slot in it.

    Returns key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot,
    grown_shard. A null text has size 8 and the checksum of an empty one; null
    keys share one ring position; equal keys are told apart by checksum and
    size, and rows equal in all of these are interchangeable. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keys = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - CELL_BITS).cast("int").alias("_cell"),
    )
    keys = cut(keys)  # read three times below, always as it is here
    keys = keys.withColumn("_row", F.xxhash64("doc_id", "text_crc32", "size", F.lit(1))).withColumn("_part", F.spark_partition_id())
    counts = {r["_cell"]: r["n"] for r in keys.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    names = ["_cell", "_lo", "_hi", "shard", "_base"]
    intervals = spark.createDataFrame(
        pd.DataFrame(flow(counts, n_shards, vnodes), columns=names).astype("int64"), "_cell long, _lo long, _hi long, shard long, _base long"
    ).select(F.col("_cell").cast("int").alias("_c"), "_lo", "_hi", F.col("shard").cast("int").alias("shard"), "_base")
    ranked = _ranked(keys)
    found = (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(intervals), found).select(  # CELLS plus a few rows
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _ranked(keys: DataFrame) -> DataFrame:
    """Adds ``_rank``, from 0 in each cell, in the order of the rows' hashes.

    A cell may hold a third of all rows, if these have one key. So its rows
    are told apart by a hash of all they have, in SPLITS parts whose sizes are
    added up; only rows that are equal in all share a hash, and these are
    counted by the partition that they lie in and numbered there.
    """
    split = F.pmod("_row", F.lit(SPLITS))
    each = keys.groupBy("_cell", split.alias("_split"), "_row", "_part").agg(F.count("*").alias("_n"))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    within = each.withColumn("_within", ahead(Window.partitionBy("_cell", "_split").orderBy("_row", "_part"))).drop("_n")
    parts = each.groupBy("_cell", "_split").agg(F.sum("_n").alias("_n"))
    parts = parts.select("_cell", "_split", ahead(Window.partitionBy("_cell").orderBy("_split")).alias("_start"))  # SPLITS rows a cell
    first = within.join(parts, ["_cell", "_split"]).select("_cell", "_row", "_part", (F.col("_within") + F.col("_start")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_row", "_part", "_cell").orderBy("_row")).cast("long") - 1
    return keys.withColumn("_number", number).join(first, ["_row", "_part", "_cell"]).withColumn("_rank", F.col("_first") + F.col("_number"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
