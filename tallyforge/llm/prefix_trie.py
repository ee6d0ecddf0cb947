"""Conversation prefix trie by fixed-length block hashing.

A node of the trie is a distinct sequence of first turns; its members are the conversations that begin with
it.  Turns are compared by SHA-256 digests.  Every conversation is cut into blocks of ``BLOCK`` turns, and a block's
digest continues the digest of the block before it, so equal digests mean equal sequences from the start:

1. conversations are grouped by their successive block digests: one pre-aggregated group per distinct block,
   however many copies a conversation has;
2. where a block has no sibling (no other block follows the same sequence), the turns inside it are nodes with the
   block's members, and nothing more is grouped; only where siblings diverge are the turn boundaries inside
   them refined, by grouping the distinct blocks (not the conversations) on their inner prefixes.

Sums over subtrees need no walk through the tree.  A conversation owns the nodes whose smallest member it is; these
are a suffix of its path, so every node of a subtree is owned once.  With ``after(c, d)``, the code points of
c's turns from depth d on, and ``own(c)``, the first depth that c owns, the nodes below v of depth d hold

    sum over members c of v of  after(c, d) - after(c, max(d, own(c)))

which is each node's (members - 1) times its code points; leaves count their smallest member alike.  Both are one
more pre-aggregated group per distinct block.

Defined results: null roles and texts are empty; turns sort by ``turn`` (nulls first), equal turn numbers by the
digest of role and text; rows that repeat are turns that repeat; rows with a null conv_id are left out; an empty table
gives no rows; other columns are ignored.  Positions come from the library's ordered scan, so one conversation may hold
any share of the rows.  A conversation's digests, and the ids that end at one node, stream through a task in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import crc32_sql, read_table, written
from tallyforge.operators.sequencing import ordered_scan

BLOCK = 4
ROOT = hashlib.sha256(b"").digest()
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, chars``: every conversation's turns in order (depth from 1)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    light = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), F.length(text).cast("long").alias("chars"))
    placed = ordered_scan(light, ["conv_id"], ["turn", "digest"], index="_at")
    return placed.select("conv_id", (F.col("_at") + 1).alias("depth"), "digest", "chars")


SHARED = 6  # a conversation takes fewer first turns than this from the first one of its hundred


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn digests, conversations) after each conversation's first turns were replaced by those of the first
    one of its hundred."""
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = written(turns.select("conv_id").distinct().select("conv_id", held.alias("held"),
                                                              (F.col("conv_id") - F.col("conv_id") % 100).alias("base")), "convs")
    heads = turns.where(F.col("depth") < SHARED)
    given = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where("depth <= held")
    # conversations whose base has fewer turns than they take: their own turns move up
    counts = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    short = convs.join(counts, "conv_id", "left").select("conv_id", (F.col("held") - F.coalesce("n", F.lit(0))).alias("up")).where("up > 0")
    own = turns.where(F.col("depth") > held).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("depth") - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "chars")
    return given.select("conv_id", "depth", "digest", "chars").unionByName(own), convs.select("conv_id")


def block_rows(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: ``block`` (from 0), ``parent`` (digest up to the block), ``keys`` (digest
    up to each of its turns), ``chars``, ``before`` (code points before the block), ``last``."""
    stream = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    size, root = BLOCK, ROOT

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["conv_id", "block", "parent", "keys", "chars", "before", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        conv, block, parent, keys, chars, before, h = None, 0, root, [], [], 0, None

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

        for b in batches:
            out = []
            for c, digest, n in zip(*[b.column(x).to_pylist() for x in ("conv_id", "digest", "chars")]):
                if c != conv or len(keys) == size:
                    if keys:
                        out.append((conv, block, parent, keys, chars, before, c != conv))
                    if c == conv:
                        block, parent, before = block + 1, keys[-1], before + sum(chars)
                    else:
                        conv, block, parent, before = c, 0, root, 0
                    keys, chars, h = [], [], hashlib.sha256(parent)
                h.update(digest)
                keys.append(h.digest())
                chars.append(n)
            if out:
                yield flush(out)
        if keys:
            yield flush([(conv, block, parent, keys, chars, before, True)])

    return stream.mapInArrow(run, "conv_id long, block long, parent binary, keys array<binary>, chars array<long>, before long, last boolean")


def _node_rows(blocks: DataFrame, values: list) -> DataFrame:
    """A row per node of each distinct block (``key, parent_key, depth, chars`` and, of ``values``, those of the
    block or, for arrays, of the turn), before inner prefixes of siblings are brought together."""
    at = F.posexplode("keys").alias("_j", "key")
    flat = blocks.select("*", at)
    of_turn = lambda c: F.element_at(c, F.col("_j") + 1)
    shown = [of_turn(F.col(v[1:])).alias(v[1:]) if v.startswith("@") else F.col(v) for v in values]
    return flat.select("key", F.when(F.col("_j") == 0, F.col("parent")).otherwise(F.element_at("keys", F.greatest("_j", F.lit(1)))).alias("parent_key"),
                       (F.col("block") * BLOCK + F.col("_j") + 1).alias("depth"), of_turn(F.col("chars")).alias("chars"), "forked", *shown)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, depth, digest, chars) of all ``convs`` (conv_id)."""
    spark = turns.sparkSession
    rows = written(block_rows(turns), "blocks").withColumn("own", F.element_at("keys", -1))

    # 1. distinct blocks, with their members
    groups = rows.groupBy("own").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("block").alias("block"),
        F.first("parent").alias("parent"), F.first("keys").alias("keys"), F.first("chars").alias("chars"))
    groups = written(groups, "block-groups")
    forks = groups.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent", F.lit(True).alias("forked"))
    groups = groups.join(forks, "parent", "left").withColumn("forked", F.coalesce("forked", F.lit(False)))

    # 2. nodes: as they are where a block has no sibling, else by inner prefix
    flat = _node_rows(groups, ["n_convs", "conv_id"])
    cols = ["key", "parent_key", "depth", "chars", "n_convs", "conv_id"]
    refined = flat.where("forked").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        F.lit(bytearray(ROOT)).alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    nodes = written(flat.where("not forked").select(*cols).unionByName(refined.select(*cols)).unionByName(root), "nodes")

    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # 3. what each conversation owns, and its length
    owners = nodes.groupBy("conv_id").agg(F.min(F.when(F.col("depth") > 0, F.col("depth"))).alias("first_owned"),
                                          F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = rows.where("last").select("conv_id", "own", (F.col("before") + F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    ends = written(convs.join(whole, "conv_id", "left").join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("own", F.lit(bytearray(ROOT))).alias("key"), F.coalesce("total", F.lit(0)).alias("total"),
        "first_owned", F.coalesce("leaf", F.lit(0)).alias("leaf")), "ends")

    # 4. sums over subtrees: per distinct block and turn, then as in 2
    met = rows.join(ends.drop("key"), "conv_id")
    step = F.transform(F.sequence(F.lit(1), F.size("chars")), lambda j: F.struct(
        (F.col("block") * BLOCK + j).alias("depth"),
        (F.col("before") + F.aggregate(F.slice("chars", F.lit(1), j - 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ahead")))
    met = met.withColumn("step", step)
    # code points before the first owned depth, where that lies in this block
    inside = F.filter("step", lambda s: s["depth"] == F.col("first_owned"))
    met = met.withColumn("owned_from", F.when(F.size(inside) > 0, inside[0]["ahead"]))
    start = met.where("owned_from is not null").select("conv_id", F.col("owned_from").alias("ahead_of_own"))
    met = met.drop("owned_from").join(start, "conv_id", "left")
    after_own = F.coalesce(F.col("total") - F.col("ahead_of_own"), F.lit(0))
    shared = F.transform("step", lambda s: F.col("total") - s["ahead"] - F.least(F.col("total") - s["ahead"], after_own))
    sums = [F.sum(F.element_at(shared, F.lit(j + 1)) if j == 0 else F.when(F.size("chars") > j, F.get(shared, F.lit(j)))).alias(f"s{j}")
            for j in range(BLOCK)]
    totals = met.groupBy("own").agg(F.sum("leaf").alias("leaves"), *sums)
    totals = groups.join(totals, "own").withColumn("saved", F.array(*[f"s{j}" for j in range(BLOCK)]))
    below = _node_rows(totals, ["leaves", "@saved"])
    kept = ["key", "leaves", "saved"]
    below = below.where("not forked").select(*kept).unionByName(
        below.where("forked").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(*kept))
    firsts = met.where("block = 0").select("conv_id", F.element_at(shared, 1).alias("saved"))
    top = ends.join(firsts, "conv_id", "left").agg(F.sum("leaf").alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    below = below.unionByName(top.select(F.lit(bytearray(ROOT)).alias("key"), "leaves", "saved"))

    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, "key").join(_end_digests(ends.select("key", "conv_id")), "key", "left").join(parents, "parent_key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"), "key", "parent_key")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes at which conversations end; ids stream in order."""
    stream = ends.repartition("key").sortWithinPartitions("key", "conv_id")

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, h = None, None
        for b in batches:
            done = []
            for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(str(conv).encode())
                else:
                    h.update(f",{conv}".encode())
            if done:
                keys, digests = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return stream.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie over conversations as they are."""
    turns = turn_digests(conversations)
    return trie(turns, turns.select("conv_id").distinct())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie over all conversations, rebuilt to share first turns."""
    return trie(*rebuilt(turn_digests(read_table(spark, sf_dir, "conversations")))).select(*NODE)


ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("cast(conv_id AS varchar)")} % 6 AS h, conv_id - conv_id % 100 AS base
      FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM parts),
walk AS (
  SELECT conv_id, cast(0 AS bigint) AS d, '' AS key, cast(NULL AS varchar) AS parent, cast(0 AS bigint) AS chars FROM c
  UNION ALL SELECT w.conv_id, w.d + 1, sha256(w.key || sha256(len(r.role) || ':' || r.role || r.text)), w.key, cast(len(r.text) AS bigint)
  FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.d = w.d + 1),
nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars
  FROM walk GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
ends AS (
  SELECT key, string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(key, d) AS key FROM walk GROUP BY conv_id) GROUP BY key),
up AS (
  SELECT n.key AS top, n.key, n.parent, (n.n_convs - 1) * n.chars AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids k USING (key)
  UNION ALL SELECT p.key, u.key, p.parent, u.saved, u.leaf FROM up u JOIN nodes p ON p.key = u.parent),
sums AS (SELECT top AS key, cast(sum(saved) AS bigint) AS saved, cast(sum(leaf) AS bigint) AS leaves FROM up GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN kids k ON k.key = n.key LEFT JOIN ends e ON e.key = n.key
JOIN sums s ON s.key = n.key
"""
