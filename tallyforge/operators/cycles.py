"""H3: the nodes of a parent-child table that lie on a cycle, with rows linear in the edges in every round.

1. Almost every node of a category tree has one parent, so parents are a function there.  Pointer doubling follows
   it 1, 2, 4, ... steps at a time: what it maps onto shrinks to exactly the nodes on rings, after as many rounds as the
   logarithm of the longest path.  A node whose pointer ends at a node without parent, or at a ring it is not on, has
   only resolved ancestors and lies on no cycle.
2. What remains hangs below nodes with several parents.  Its strongly connected components are found by
   trimming (nodes that nothing enters or leaves go) and colouring: every node takes the greatest name that
   reaches it; the nodes of one colour that reach the node of that name are one component.  Only here rounds
   grow with the length of paths, among nodes whose ancestors include one with several parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def single_parent_pointers(edges: DataFrame) -> DataFrame:
    """``node, to``: every node with one parent, and where its pointer leads after enough doublings: a node on a
    ring of such nodes, or the first ancestor without exactly one parent.  ``edges``: distinct (a, b)."""
    up = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("to")).where("n = 1")
    now = materialize(up.select(F.col("b").alias("node"), "to"), "pointers")
    size = None
    while True:
        image = now.select(F.col("to").alias("node")).distinct().join(now, "node", "left_semi").count()
        if image in (0, size):  # images are nested: one that keeps its size keeps its nodes
            return now
        size = image
        onward = now.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        now = materialize(now.join(onward, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), "pointers")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that something enters and something leaves."""
    now, n = edges, edges.count()
    while n:
        kept = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        kept = materialize(kept.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "trimmed")
        m = kept.count()
        if m == n:
            break
        now, n = kept, m
    return now


def _coloured(edges: DataFrame) -> DataFrame:
    """``node, colour``: the greatest name among a node and all that reach it."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = materialize(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        sent = edges.join(now.select(F.col("node").alias("a"), "colour"), "a").select(F.col("b").alias("node"), "colour")
        new = materialize(now.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
        if new.join(now, ["node", "colour"], "left_anti").isEmpty():
            return new
        now = new


def _components(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """``node, colour`` of the nodes that reach the node their colour is named after: one component per colour."""
    c = colour.select(F.col("node").alias("a"), "colour")
    within = materialize(edges.join(c, "a").join(colour.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select("a", "b", "colour"), "within")
    found = materialize(colour.where("node = colour"), "reached")
    front = found
    while not front.isEmpty():
        back = within.join(front.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
        front = materialize(back.join(found, "node", "left_anti"), "reached")
        found = materialize(found.unionByName(front), "reached")
    return found


def nodes_on_cycles(edges: DataFrame) -> DataFrame:
    """``node`` of every node on a cycle of ``edges`` (parent, child); a node that is its own child is one."""
    every = materialize(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).where("a is not null and b is not null").distinct(), "edges")
    out = every.where("a = b").select(F.col("a").alias("node"))
    e = every.where("a <> b")
    pointers = single_parent_pointers(e)
    ring = materialize(pointers.select(F.col("to").alias("node")).distinct().join(pointers, "node", "left_semi").select("node"), "ring")
    out = out.unionByName(ring)
    # open: nodes with several parents and what hangs below them alone
    several = e.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("b").alias("node"))
    below = pointers.join(several.select(F.col("node").alias("to")), "to", "left_semi").select("node")
    open_nodes = materialize(several.unionByName(below), "open")
    rest = e.join(open_nodes.select(F.col("node").alias("a")), "a", "left_semi").join(open_nodes.select(F.col("node").alias("b")), "b", "left_semi")
    rest = _trimmed(materialize(rest.select("a", "b"), "rest"))
    while not rest.isEmpty():
        found = _components(rest, _coloured(rest))
        large = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        out = out.unionByName(found.join(large, "colour", "left_semi").select("node"))
        gone = found.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        rest = _trimmed(materialize(rest.select("a", "b"), "rest"))
    return out.distinct()
