"""Sharding by fixed virtual slots (native: DataFrame functions only).

Every record hashes by its id into one of a few thousand fixed slots.  Bytes are aggregated per slot; a slot-to-shard
map, one small versioned table, says where slots live.  Rebalancing edits the map and never rehashes a record: the next
version moves only as many slots as the new balance needs.

Law: `bytes`.  The first map places slots, largest first, on the lightest shard, so shard sizes differ by less than the
largest slot.

Edge cases: a null text has no bytes (size 8, crc 0); an empty text likewise; a null id hashes to one fixed slot;
repeated rows are separate records that share a slot; an empty table gives an empty result; columns other than doc_id
and text are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only, read_table, shared_dir

SLOTS = 4096
SHARDS = 24
#: Rows that one task ranks at most, on average.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class ShardMap:
    """Version, shard count, and the shard of each slot."""

    version: int
    shards: int
    of: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, k, s) for k, s in enumerate(self.of)], "version int, virtual_slot int, shard int")


def build_map(slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> ShardMap:
    """Version 1: slots by falling size on the lightest shard so far; empty slots go round robin."""
    heap = [(0, s) for s in range(shards)]
    of = [k % shards for k in range(slots)]
    for size, k in sorted(((-slot_bytes.get(k, 0), k) for k in range(slots) if slot_bytes.get(k, 0))):
        load, s = heap[0]
        of[k] = s
        heapq.heapreplace(heap, (load - size, s))
    return ShardMap(1, shards, tuple(of))


def rebalance(m: ShardMap, slot_bytes: dict[int, int], shards: int | None = None) -> ShardMap:
    """The next version: moves slots off overfull shards, and only those; a new shard takes slots and gives none."""
    shards = m.shards if shards is None else shards
    if shards < m.shards:
        raise ValueError("shards can't be removed by rebalancing")
    of, load = list(m.of), [0] * shards
    mine: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for k, s in enumerate(of):
        load[s] += slot_bytes.get(k, 0)
        mine[s].append((slot_bytes.get(k, 0), k))
    goal = sum(load) / shards
    for s in sorted(range(m.shards), key=lambda x: -load[x]):
        for size, k in sorted(mine[s], reverse=True):
            to = min(range(m.shards, shards), key=lambda x: load[x], default=None) if shards > m.shards else min(range(shards), key=lambda x: load[x])
            if size and to is not None and load[s] - size >= goal * 0.999 and load[to] + size <= goal * 1.001:
                of[k] = to
                load[s] -= size
                load[to] += size
    return ShardMap(m.version + 1, shards, tuple(of))


def store_map(m: ShardMap, spark: SparkSession, path: str) -> None:
    """Adds this version, which must be new; earlier versions stay readable."""
    m.table(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> ShardMap:
    t = spark.read.parquet(path)
    version = version if version is not None else t.agg(F.max("version")).first()[0]
    rows = t.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # one row a slot
    if not rows or [r["virtual_slot"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"{path} holds no whole map of version {version}")
    of = tuple(r["shard"] for r in rows)
    return ShardMap(version, max(of) + 1, of)


def current_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> ShardMap:
    """The map stored at path, made or rebalanced for these sizes first; an edit is stored as the next version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        store_map(build_map(slot_bytes, shards, slots), spark, path)
    else:
        have = load_map(spark, path)
        new = rebalance(have, slot_bytes, max(shards, have.shards))
        if new.of != have.of:
            store_map(new, spark, path)
    return load_map(spark, path)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, and the hash bits that are left for finer buckets."""
    d = only(docs, doc_id="long", text="string")
    h = F.xxhash64("doc_id")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return d.select(
        "doc_id",
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(h, F.lit(slots)).cast("int").alias("virtual_slot"),
        # rows of one id, null included, spread over buckets too
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 16).alias("_h"),
    )


def slot_sizes(recs: DataFrame) -> dict[int, int]:
    """Bytes per slot: at most as many rows as there are slots, so they fit the driver."""
    return {r[0]: r[1] for r in recs.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def place(recs: DataFrame, m: ShardMap) -> DataFrame:
    """Adds shard and the gapless position in it.  One shuffle of narrow rows; positions come from counts per bucket."""
    spark = recs.sparkSession
    rows = recs.count()
    fine = max(1, -(-rows // (len(m.of) * BUCKET_ROWS)))
    d = recs.withColumn("_b", F.pmod("_h", F.lit(fine)).cast("int"))
    mapped = F.broadcast(m.table(spark).select("virtual_slot", "shard"))  # one row a slot
    counts = d.groupBy("virtual_slot", "_b").agg(F.count(F.lit(1)).alias("_n")).join(mapped, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("virtual_slot", "_b", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("virtual_slot", "_b").orderBy("doc_id", "size", "text_crc32")
    return (
        d.withColumn("_r", F.row_number().over(w) - 1)
        .join(base, ["virtual_slot", "_b"])
        .withColumn("slot", (F.col("_base") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_base", "_h")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """path: where the map lives from run to run; without one it is made anew, in the shared folder."""
    spark = docs.sparkSession
    recs = materialize(records(docs, slots), "shard-records")
    path = path or f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/shard-map-{uuid.uuid4().hex[:12]}"
    m = current_map(spark, path, slot_sizes(recs), shards, slots)
    placed = place(recs, m)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
