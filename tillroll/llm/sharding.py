"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` slots, for ever.  Bytes and rows are
aggregated per slot, and a small versioned table maps slots to shards.  A new
map packs the slots, largest first, each into the shard with the fewest bytes.
When data or the number of shards change, the map is edited: slots move from the
fullest to the emptiest shard until sizes are near equal, all others stay, and
the result is stored as the next version.

A record's place in its shard is gapless from 0: the rows of the shard's lower
slots, counted from the slot sums, plus its rank inside its slot.  So no task
orders more than one slot, and the texts are not shuffled.

Null texts have no bytes; a null id hashes like a value.  Rows that repeat in
every hashed column share a slot.  An empty table gives a map and no rows.
"""

from __future__ import annotations

import heapq
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Staging
from tillroll.session import path_exists

SLOTS = 4096
TOLERANCE = 0.002  # of the mean size, the gap that rebalancing leaves at most if single slots allow


def slot_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def slot_sizes(sized: DataFrame) -> DataFrame:
    """``(vslot, bytes, rows)``; at most ``SLOTS`` rows, pre-aggregated in each task."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def pack(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """A first map of all slots: largest slot first, to the shard with the fewest bytes."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda x: (-sizes.get(x, 0), x)):
        load, held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), held + 1, shard))
    return out


def rebalance(mapping: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for new sizes or a new number of shards, with few slots moved."""
    out = dict(mapping)
    load = {s: 0 for s in range(shards)}
    held: dict[int, list[int]] = {s: [] for s in range(max(shards, max(out.values(), default=0) + 1))}
    for slot, shard in out.items():
        held[shard].append(slot)
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
    for shard in [s for s in held if s >= shards]:  # shards that are given up
        for slot in sorted(held[shard], key=lambda x: -sizes.get(x, 0)):
            to = min(load, key=lambda s: (load[s], s))
            out[slot] = to
            held[to].append(slot)
            load[to] += sizes.get(slot, 0)
    mean = sum(load.values()) / shards
    while True:
        full, empty = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        if gap <= TOLERANCE * mean:
            return out
        # the largest slot that narrows the gap most without turning it round
        fit = [x for x in held[full] if 0 < sizes.get(x, 0) < gap]
        if not fit:
            return out
        slot = min(fit, key=lambda x: (abs(gap / 2 - sizes[x]), x))
        held[full].remove(slot)
        held[empty].append(slot)
        out[slot] = empty
        load[full] -= sizes[slot]
        load[empty] += sizes[slot]


_MAP = "version int, vslot int, shard int, edit string"


def latest_map(spark: SparkSession, store: str) -> tuple[int, dict[int, int]]:
    """Version and slot map last written under ``store``; ``(0, {})`` when there is none.

    Of two maps that writers gave the same version, the one written first counts, whole, for every reader.
    """
    if not path_exists(spark, store):
        return 0, {}
    maps = spark.read.schema(_MAP).parquet(store)
    version = maps.agg(F.max("version")).first()[0] or 0
    edit = maps.where(F.col("version") == version).agg(F.min("edit")).first()[0]
    held = maps.where((F.col("version") == version) & (F.col("edit") == edit))
    return version, {r["vslot"]: r["shard"] for r in held.collect()}


def write_map(spark: SparkSession, store: str, version: int, mapping: dict[int, int]) -> None:
    """Adds a version as a folder of its own, so writers never touch each other's; earlier ones stay readable."""
    frame = spark.createDataFrame([(version, k, v) for k, v in sorted(mapping.items())], "version int, vslot int, shard int")
    frame.coalesce(1).write.parquet(f"{store}/edit={time.time_ns():020d}-{uuid.uuid4().hex}")


def assign(docs: DataFrame, shards: int, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record's shard and place: ``doc_id, size, text_crc32, vslot, shard, slot``.

    ``store`` is the folder of the versioned map; an existing map is edited,
    and written as a new version only if it changes.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "sharding")
    raw = F.encode(F.col(text_col), "UTF-8")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"), slot_of(F.col(id_col), F.col(text_col)).alias("vslot"))
    sized = staging.put(sized, "sized")
    sums = staging.put(slot_sizes(sized), "sums")
    sizes = {r["vslot"]: r["bytes"] for r in sums.collect()}  # at most SLOTS rows
    store = store or staging.path("slot-map")
    version, old = latest_map(spark, store)
    mapping = rebalance(old, sizes, shards) if old else pack(sizes, shards)
    if mapping != old:
        write_map(spark, store, version + 1, mapping)
        _, mapping = latest_map(spark, store)  # another writer's, if it came first
    where = spark.createDataFrame(sorted(mapping.items()), "vslot int, shard int")  # at most SLOTS rows
    w = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = staging.put(where.join(sums.select("vslot", "rows"), "vslot")
                         .withColumn("start", F.coalesce(F.sum("rows").over(w), F.lit(0))).select("vslot", "shard", "start"), "starts")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # the joined side has a fixed bound: SLOTS rows of three numbers
    return (sized.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), "vslot")
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("rank") - 1).alias("slot")))
