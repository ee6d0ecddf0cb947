"""Resharding by minimum-cost flow.

Given rows in old shards and a new number of shards, every new shard shall hold the same number of rows
(at most one apart) while as few bytes as possible change their shard.  Rows of one old shard and one
size class (a power of two of bytes) form a block.  The flow network is

    source -> block (its rows) -> the shard of the same number (cost 0) or "elsewhere" (mean bytes a row)
    elsewhere -> every new shard (cost 0);  new shard -> sink (the floor of the mean, then one row more)

and has a node per block, so its size depends on the shard counts and not on the rows.  The solution is
a list of transfers (block, first row, rows, new shard, first slot); rows are numbered inside their
block and looked up in it, and only shards that give or receive rows are written anew.

A block is numbered in groups of bounded size (hash of the row), so neither a hot shard nor a hot size
meets in one task; the texts are shuffled once.

Defined results: null texts have no bytes and the crc of the empty text; a null old shard counts as
shard 0; repeated rows are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import read_table, scratch

ROW_BYTES = 16
GROUP_BYTES = 128 << 20  # bytes that one numbering group is aimed at, so also a written file
LEAST_GROUPS = 192
OLD_SHARDS, NEW_SHARDS = 32, 40


def min_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a maximum flow of least cost: shortest
    augmenting paths with potentials."""
    to, cap, cost, out = [], [], [], defaultdict(list)
    for a, b, c, w in edges:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    potential = [0] * nodes
    while True:
        dist, via, heap = {source: 0}, {}, [(0, source)]
        done = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                if cap[e] and to[e] not in done:
                    n = d + cost[e] + potential[x] - potential[to[e]]
                    if n < dist.get(to[e], math.inf):
                        dist[to[e]], via[to[e]] = n, e
                        heapq.heappush(heap, (n, to[e]))
        if sink not in done:
            return [cap[2 * k + 1] for k in range(len(edges))]
        far = max(dist[x] for x in done)
        for x in range(nodes):
            potential[x] += dist[x] if x in done else far
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        most = min(cap[e] for e in path)
        for e in path:
            cap[e] -= most
            cap[e ^ 1] += most


def plan_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """From (old shard, size class, rows, bytes): (old, class, first row, rows, new shard, first slot)."""
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    each, n = total // new_shards, len(blocks)
    elsewhere, sink = n + new_shards + 1, n + new_shards + 2
    shard = lambda j: 1 + n + j
    edges, extra = [], 1 + 1000 * sum(b[3] for b in blocks)
    for k, (old, _, rows, size) in enumerate(blocks):
        edges.append((0, 1 + k, rows, 0))
        edges.append((1 + k, shard(old), rows, 0) if old < new_shards else (1 + k, elsewhere, 0, 0))
        edges.append((1 + k, elsewhere, rows, 1000 * size // max(rows, 1)))
    for j in range(new_shards):
        edges += [(elsewhere, shard(j), total, 0), (shard(j), sink, each, 0), (shard(j), sink, 1, extra)]
    flow = min_cost_flow(edges, 0, sink, sink + 1)
    wanted = [[j, flow[3 * n + 3 * j]] for j in range(new_shards)]
    slot, out = [0] * new_shards, []

    def give(k, first, rows, j):
        out.append((*blocks[k][:2], first, rows, j, slot[j]))
        slot[j] += rows

    for k, (old, _, rows, _) in enumerate(blocks):
        stay, at = flow[3 * k + 1], 0
        if stay:
            give(k, 0, stay, old)
        at = stay
        while at < rows:
            while not wanted[0][1]:
                wanted.pop(0)
            take = min(rows - at, wanted[0][1])
            give(k, at, take, wanted[0][0])
            wanted[0][1] -= take
            at += take
    return out


def reshard(rows: DataFrame, old: str, new_shards: int, folder: str) -> DataFrame:
    """Rows with ``doc_id, text`` and their old shard, put into ``new_shards`` shards.  Shards that give
    or receive rows are written to ``folder/shard=N``; all rows come back with ``shard, slot``."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", "text", F.coalesce(F.col(old).cast("int"), F.lit(0)).alias("old"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    rows = rows.withColumn("klass", F.floor(F.log2(size)).cast("int"))
    blocks = [tuple(r) for r in rows.groupBy("old", "klass").agg(F.count("*"), F.sum(size)).collect()]
    transfers = plan_transfers(blocks, new_shards)
    total, n_rows = sum(b[3] for b in blocks), sum(b[2] for b in blocks)
    per_group = max(1, n_rows // max(LEAST_GROUPS, math.ceil(total / GROUP_BYTES)))

    # per block: number of groups and transfers; a row per old shard and power of two at most
    places = defaultdict(list)
    for o, k, first, n, j, slot in transfers:
        places[o, k].append((first, first + n, j, slot))
    plan = spark.createDataFrame(
        [(o, k, math.ceil(n / per_group), places[o, k]) for o, k, n, _ in blocks],
        "old int, klass int, groups int, places array<struct<first long, stop long, shard int, slot long>>")
    rows = rows.join(F.broadcast(plan.select("old", "klass", "groups")), ["old", "klass"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.col("groups")).cast("int")).drop("groups")

    key = ["old", "klass", "part"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("old", "klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text"))).join(firsts, key)
    numbered = numbered.withColumn("at", F.col("first") + F.col("k") - 1).join(F.broadcast(plan.drop("groups")), ["old", "klass"])
    place = F.filter("places", lambda p: (p["first"] <= F.col("at")) & (F.col("at") < p["stop"]))[0]
    placed = numbered.withColumn("p", place).select(
        "doc_id", "text", (F.col("p.slot") + F.col("at") - F.col("p.first")).alias("slot"), F.col("p.shard").alias("shard"))

    touched = {x for o, _, _, _, j, _ in transfers if o != j for x in (o, j)}
    still = [j for j in range(new_shards) if j not in touched]
    (placed.where(~F.col("shard").isin(still)) if still else placed).write.partitionBy("shard").parquet(folder)
    out = spark.read.schema(placed.schema).parquet(folder)
    return out.unionByName(placed.where(F.col("shard").isin(still))) if still else out


def op8_reshard(spark, sf_dir: str) -> DataFrame:
    """Documents from 32 shards by source, of very different sizes, into 40 of equal row counts."""
    docs = read_table(spark, sf_dir, "documents")
    old = docs.select("doc_id", "text", F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)).cast("int").alias("old"))
    out = reshard(old, "old", NEW_SHARDS, scratch(spark, "reshard"))
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
