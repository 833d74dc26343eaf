"""Resharding by minimum-cost flow.

From the byte sizes of the old shards and the capacities of the new ones, a minimum-cost flow says how
many bytes go from which old shard to which new one (staying is free, moving costs its bytes). Documents
are pooled into blocks: a document above a small share of the capacity is a block, others are dealt to
blocks of about that size by a hash of their key. So there are at most some thousand blocks at any scale,
and they alone reach the driver, where they realise the flow. Shards that give or get blocks are
rewritten; others keep their files.

Definitions for odd input: a null text has no bytes; repeated rows are placed one by one; rows without
doc_id are placed by their text. An empty table gives no rows. Columns that clash with the
names of the results are replaced by them.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ferrule.llm.common import shared_dir, table

#: Blocks for each new shard, about.
BLOCKS = 200
OLD_SHARDS = 32
#: Bytes of a new shard that one task numbers and writes, about.
LANE_BYTES = 256 << 20


def min_cost_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (i, j) -> amount of least total cost from supplies into rooms, by successive shortest paths
    with potentials. cost(i, j) >= 0 for a unit. sum(room) >= sum(supply)."""
    n, m = len(supply), len(room)
    end = n + m
    left, free = list(supply), list(room)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (end + 1)
    for i in range(n):
        while left[i] > 0:
            far = [float("inf")] * (end + 1)
            far[i], came, heap = 0, {}, [(0, i)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                if u < n:
                    edges = ((n + j, cost(u, j)) for j in range(m))
                elif u < end:
                    edges = [(k, -cost(k, u - n)) for k in range(n) if flow.get((k, u - n), 0) > 0] + ([(end, 0)] if free[u - n] > 0 else [])
                else:
                    edges = ()
                for v, c in edges:
                    reduced = d + c + potential[u] - potential[v]
                    if reduced < far[v]:
                        far[v], came[v] = reduced, u
                        heapq.heappush(heap, (reduced, v))
            potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
            path = [end]
            while path[-1] != i:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(left[i], free[path[-2] - n], *(flow[(v, u - n)] for u, v in zip(path[1:], path[2:], strict=False) if v < n))
            for u, v in zip(path, path[1:], strict=False):
                if u < n:
                    flow[(u, v - n)] = flow.get((u, v - n), 0) + amount
                elif v < n:
                    flow[(v, u - n)] -= amount
            left[i] -= amount
            free[path[-2] - n] -= amount
    return {k: v for k, v in flow.items() if v}


def place_blocks(blocks: list[tuple[int, int]], shards: int) -> list[int]:
    """New shard of each block (old shard, bytes): the blocks realise the flow, largest first; then single
    blocks go from the fullest to the emptiest shard while that evens them out."""
    total = sum(b for _, b in blocks)
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    olds = sorted({o for o, _ in blocks})
    supply = [sum(b for o, b in blocks if o == x) for x in olds]
    flow = min_cost_flow(supply, room, lambda i, j: 0 if olds[i] == j else 1)
    need: dict[int, dict[int, int]] = {o: {} for o in olds}
    for (i, j), amount in flow.items():
        need[olds[i]][j] = amount
    at = [0] * len(blocks)
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][1], k)):
        o, b = blocks[k]
        at[k] = max(need[o], key=lambda j: (need[o][j], j == o, -j))
        need[o][at[k]] -= b
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for k, j in enumerate(at):
        load[j] += blocks[k][1]
        held[j].add(k)
    for _ in range(20 * shards):
        hi, lo = max(range(shards), key=lambda j: load[j]), min(range(shards), key=lambda j: load[j])
        gap = load[hi] - load[lo]
        fits = [k for k in held[hi] if blocks[k][1] < gap]
        if gap <= max(1, total // shards // 1000) or not fits:
            break
        k = min(fits, key=lambda k: (abs(blocks[k][1] - gap // 2), k))
        held[hi].remove(k)
        held[lo].add(k)
        load[hi], load[lo], at[k] = load[hi] - blocks[k][1], load[lo] + blocks[k][1], lo
    return at


def sized(docs: DataFrame, old: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__old": old.cast("int"), "__size": (F.octet_length(text) + 16).cast("long"), "__crc": F.crc32(text.cast("binary"))}).withColumn("__at", F.xxhash64("doc_id", "__crc", F.lit(3)))


def reshard(docs: DataFrame, shards: int, old: Column, path: str | None = None) -> DataFrame:
    """docs with old_shard, shard, slot, and size: rows of affected shards are written to ``path`` (a
    folder of its own in the shared folder by default), one partition folder a shard, and read back."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("old_shard", "shard", "slot", "size")]
    rows = sized(docs.select(*own), old)
    sizes = {r["__old"]: r["b"] for r in rows.groupBy("__old").agg(F.sum("__size").alias("b")).collect()}
    fine = max(17, sum(sizes.values()) // shards // BLOCKS)
    parts = F.create_map(*[F.lit(x) for o, b in sizes.items() for x in (o, -(-b // fine))])[F.col("__old")] if sizes else F.lit(1)
    rows = rows.withColumns({"__big": F.col("__size") >= fine, "__block": F.when(F.col("__size") >= fine, F.col("__at")).otherwise(F.pmod("__at", parts.cast("long")))})
    key = ["__old", "__big", "__block"]
    counted = rows.groupBy(*key).agg(F.sum("__size"), F.count("*"))
    blocks = [tuple(r) for r in counted.collect()]
    if any(b[1] and b[4] > 1 for b in blocks):  # repeated big rows (some thousand at most): one block each, by their number
        number = F.row_number().over(W.partitionBy(*key).orderBy("doc_id"))
        big = rows.where("__big").withColumn("__block", F.xxhash64("__block", number))
        rows = rows.where("not __big").unionByName(big)
        blocks = [tuple(r) for r in rows.groupBy(*key).agg(F.sum("__size"), F.count("*")).collect()]
    blocks.sort()
    at = place_blocks([(b[0], b[3]) for b in blocks], shards) if blocks else []
    filled, placed = [0] * shards, []
    for b, j in zip(blocks, at, strict=True):
        placed.append((*b[:3], j, filled[j]))
        filled[j] += b[4]
    touched = {x for (o, *_), j in zip(blocks, at, strict=True) if o != j for x in (o, j)}
    plan = spark.createDataFrame(placed, "__old int, __big boolean, __block long, shard int, __first long")
    # one shuffle of the texts: whole blocks go to the lanes of their shard, which clusters the window too
    lanes = max(1, -(-sum(sizes.values()) // shards // LANE_BYTES))
    order = W.partitionBy("shard", "__lane", *key).orderBy("doc_id", "__crc")
    dealt = rows.join(F.broadcast(plan), key).withColumn("__lane", F.pmod("__block", F.lit(lanes))).repartition(max(shards * lanes, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard", "__lane")
    whole = dealt.withColumn("slot", F.col("__first") + F.row_number().over(order) - 1).select(*own, F.col("__old").alias("old_shard"), "shard", "slot", F.col("__size").alias("size"))
    affected = F.col("shard").isin(sorted(touched)) if touched else F.lit(False)
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    whole.where(affected).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    types = T.StructType([f for f in whole.schema if f.name != "shard"] + [whole.schema["shard"]])
    kept = spark.read.schema(types).parquet(path)
    return kept if len(touched) >= shards else kept.unionByName(whole.where(~affected))


def old_by_hash(column: str = "doc_id") -> Column:
    """The layout before: hashed over OLD_SHARDS shards."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))


def digest(placed: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 hashed shards to 40 of equal bytes."""
    return digest(reshard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, old_by_hash()))
