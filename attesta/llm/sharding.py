"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; the bytes and rows of every slot are aggregated; a
versioned map says which shard owns which slot. Rebalancing edits the map: it moves as few slots
as needed to bring the shards' bytes together, and stores the result as the next version, so
older versions stay readable. Only the totals of the slots, of fixed number, reach the driver.

Within a shard, records are numbered without a gap: slots in order, records by id within a slot.

Defined results: a null text has no bytes and crc 0; a null id is placed by its text; rows of
equal id share a slot and so a shard; more shards than slots leave shards empty; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm.common import save

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16

MAP = T.StructType([T.StructField(n, T.LongType()) for n in ("version", "vslot", "shard", "bytes", "rows")])


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot; texts go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.crc32(text)))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64(key), F.lit(slots)).alias("vslot"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot."""
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        size[r["vslot"]], count[r["vslot"]] = r["bytes"], r["n"]
    return size, count


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots) % shards


def rebalance(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """An edited copy of the map with near equal bytes; slots that need not move stay."""
    owner = owner.copy()
    load = np.bincount(owner, weights=size, minlength=shards)
    mean = load.sum() / shards
    freed = []
    for shard in range(shards):  # give up the largest slots that still fit into the excess, then one more if any is left
        for slot in sorted(np.flatnonzero((owner == shard) & (size > 0)), key=lambda s: -size[s]):
            if load[shard] - size[slot] >= mean:
                load[shard] -= size[slot]
                freed.append(slot)
        rest = np.flatnonzero((owner == shard) & (size > 0) & ~np.isin(np.arange(len(owner)), freed))
        if load[shard] > mean and len(rest) > 1:
            slot = rest[np.argmin(size[rest])]
            load[shard] -= size[slot]
            freed.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(freed, key=lambda s: -size[s]):
        least, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (least + size[slot], shard))
    return exchange(owner, size, shards)


def exchange(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """Move or swap slots between the fullest and the emptiest shard while that brings them closer."""
    for _ in range(4 * len(owner)):
        load = np.bincount(owner, weights=size, minlength=shards)
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        give = np.flatnonzero((owner == full) & (size > 0))
        take = np.flatnonzero((owner == empty) & (size > 0))
        moved = size[give][:, None] - np.concatenate([[0], size[take]])[None, :]
        gain = np.where((moved > 0) & (moved < gap), np.minimum(moved, gap - moved), 0)
        if not gain.size or gain.max() <= 0:
            break
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        owner[give[i]] = empty
        if j:
            owner[take[j - 1]] = full
    return owner


def store_map(spark, versions: list[np.ndarray], size: np.ndarray, count: np.ndarray) -> DataFrame:
    """The versions of the map as a table: version, vslot, shard, bytes, rows."""
    rows = [(v + 1, i, int(owner[i]), int(size[i]), int(count[i])) for v, owner in enumerate(versions) for i in range(len(owner))]
    return save(spark.createDataFrame(rows, MAP).coalesce(1), "shard-map")


def place(rows: DataFrame, table: DataFrame, version: int) -> DataFrame:
    """``rows`` plus shard and slot (number within the shard, from 0) by one version of the map."""
    own = table.where(F.col("version") == version)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)  # over the map, of fixed size
    starts = own.select("vslot", F.col("shard").cast("int").alias("shard"), F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("start"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("nth", within).join(F.broadcast(starts), "vslot")
    return numbered.withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long")).drop("start", "nth")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version for every row."""
    rows = records(docs, slots)
    size, count = slot_totals(rows, slots)
    start = first_map(slots, shards)
    table = store_map(docs.sparkSession, [start, rebalance(start, size, shards)], size, count)
    placed = place(rows, table, version=2)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(2).alias("map_version"))
