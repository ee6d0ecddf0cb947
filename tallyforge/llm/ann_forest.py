"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives each vector a long string of random-hyperplane bits and keeps the strings as a sorted
array.  A query descends to its longest prefix match, which is a range of that array, and then ascends
in all trees at once, one bit a step, until the ranges hold enough candidates; those are scored exactly.

The distinct vectors are dealt to blocks by hash; a block's forest lives in one task and all queries
stream through it, so every row is indexed, memory is bounded by ``BLOCK_ROWS`` and the nearest of all
blocks are merged.  Equal vectors are one entry with their ``k + 1`` smallest ids (a query needs no
more), so a vector that very many rows share costs what one row costs; equal query vectors are searched
once.  ``SHARE`` of a block's vectors, ``LEAST`` at least, are asked for as candidates: with vectors
that have no near neighbours (cosines under 0.6 in 64 dimensions) that many are needed for a recall of
0.9; on clustered vectors a far smaller share does.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without an id or of another length than the most frequent one; repeated rows count once;
ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import read_table, ship, written

TREES, BITS = 64, 32
BLOCK_ROWS = 50_000
LEAST, SHARE = 1_000, 0.3
SEED = 20240607
QUERY_EVERY, NEAREST = 50, 5


class Forest:
    """Sorted hash strings of one block."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x = vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        rng = np.random.default_rng(SEED)
        self.planes = [rng.standard_normal((vectors.shape[1], bits)) for _ in range(trees)]
        self.bits = bits
        self.order, self.keys = [], []
        for p in self.planes:
            codes = self._codes(vectors, p)
            order = np.argsort(codes, kind="stable")
            self.order.append(order)
            self.keys.append(codes[order])

    def _codes(self, v: np.ndarray, planes: np.ndarray) -> np.ndarray:
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        return np.concatenate([(v[k : k + 8192] @ planes > 0) @ weights for k in range(0, len(v), 8192)])

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the entries of the deepest level at which all trees together hold enough."""
        codes = [self._codes(queries, p) for p in self.planes]
        ranges = np.zeros((len(queries), len(codes), 2), np.int64)
        open_ = np.arange(len(queries))
        for level in range(self.bits, -1, -1):  # descended to whole strings; now ascending together
            low = self.bits - level
            for t, (c, keys) in enumerate(zip(codes, self.keys)):
                prefix = c[open_] >> low
                ranges[open_, t, 0] = np.searchsorted(keys, prefix << low)
                ranges[open_, t, 1] = np.searchsorted(keys, (prefix + 1) << low)
            sizes = (ranges[open_, :, 1] - ranges[open_, :, 0]).sum(axis=1)
            # entries found by several trees count once: check those that may have enough
            still = []
            for q, size in zip(open_.tolist(), sizes.tolist()):
                if size >= wanted or level == 0:
                    mark = np.zeros(len(self.x), bool)
                    for t, (a, b) in enumerate(ranges[q].tolist()):
                        mark[self.order[t][a:b]] = True
                    found = np.flatnonzero(mark)
                    if len(found) >= wanted or level == 0:
                        yield q, found
                        continue
                still.append(q)
            open_ = np.array(still, np.int64)
            if not len(open_):
                return

    def search(self, queries: np.ndarray, ids: list[list[int]], k: int, share: float, least: int):
        """(query, [(score, vec_id)] of the k nearest rows, nearest first)."""
        wanted = min(len(self.x), max(least, math.ceil(share * len(self.x))))
        for q, found in self.candidates(queries, wanted):
            v = queries[q]
            scores = (self.x[found] @ v) / (self.norms[found] * np.linalg.norm(v))
            if len(found) > k:
                # everything tied with the k-th score stays
                top = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                found, scores = found[top], scores[top]
            rows = [(-s, i) for e, s in zip(found.tolist(), scores.tolist()) for i in ids[e]]
            yield q, [(-s, i) for s, i in sorted(rows)[:k]]


def clean_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v, gid`` of the rows that take part; ``gid`` names the distinct vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    gid = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    return rows.withColumn("gid", gid).dropDuplicates(["vec_id", "gid"])


def nearest(rows: DataFrame, vec_id: str, vector: str, is_query, k: int = NEAREST, share: float = SHARE, least: int = LEAST,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows found for every row that ``is_query``."""
    spark = rows.sparkSession
    ship(spark)
    rows = written(clean_vectors(rows, vec_id, vector), "vectors")
    first = Window.partitionBy("gid").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = few.groupBy("gid").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query("vec_id")).select(F.col("vec_id").alias("query_id"), "gid", "v")
    searched = asked.groupBy("gid").agg(F.any_value("v").alias("v"))
    blocks = max(1, math.ceil(rows.select(F.approx_count_distinct("gid", 0.02)).first()[0] / block_rows))

    block = F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int")
    index = entries.select(block.alias("block"), F.lit(0).alias("kind"), "gid", "v", "ids")
    queries = searched.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "gid", "v",
                              F.array().cast("array<bigint>").alias("ids"))

    def matrix(batch):
        col = batch.column("v")
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)

    def run(batches):
        at, forest, parts, ids = None, None, [], []
        for batch in batches:
            where, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if where[a] != at:
                    at, forest, parts, ids = where[a], None, [], []
                if kinds[a] == 0:
                    parts.append(matrix(part))
                    ids += part.column("ids").to_pylist()
                    continue
                if forest is None and parts:
                    forest, parts = Forest(np.concatenate(parts)), []
                if forest is None:
                    continue
                gids, vectors = part.column("gid").to_pylist(), matrix(part)
                for s in range(0, len(gids), 512):
                    out = [(gids[s + q], i, x) for q, got in forest.search(vectors[s : s + 512], ids, k + 1, share, least) for x, i in got]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["gid", "vec_id", "score"])

    dealt = index.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(run, "gid string, vec_id long, score double")
    best = Window.partitionBy("gid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = found.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    pairs = asked.select("query_id", "gid").join(lists, "gid")
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return pairs.select("query_id", F.posexplode(others).alias("pos", "c")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))


def op5_ann_forest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda c: F.pmod(F.col(c), F.lit(QUERY_EVERY)) == 0)
