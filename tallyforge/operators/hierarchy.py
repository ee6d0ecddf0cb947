"""Category tree as an edge table: H1-H9.

The reference keeps the tree as a parent -> ordered-children map and walks it in memory.  Here
the tree is ``edges(parent, child, ord)``.  Heights, frontier, switches and sums over subtrees come from
interval labels (``operators.intervals``), which need a valid tree.  Reports on broken trees and pairs of
ancestor and descendant come from the closure ``(ancestor, node, depth)``, which is built by joins that
double the distance they reach, so trees of any depth and of millions of leaves stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import intervals
from .cycles import nodes_on_cycles

EDGE_SCHEMA = T.StructType([
    T.StructField("parent", T.StringType(), False),
    T.StructField("child", T.StringType(), False),
    T.StructField("ord", T.LongType(), False),
])


def edges_from_dict(spark: SparkSession, tree: dict[str, list[str]]) -> DataFrame:
    """D12 from a driver-side configuration map (small)."""
    rows = [(p, c, i) for p, children in tree.items() for i, c in enumerate(children)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def edges_from_map(df: DataFrame, map_col: str) -> DataFrame:
    """``MAP<STRING, ARRAY<STRING>>`` column -> edges, keeping the children's order."""
    e = df.select(F.explode(F.map_entries(F.col(map_col))).alias("e"))
    return e.select(F.col("e.key").alias("parent"), F.posexplode("e.value").alias("ord", "child")) \
        .select("parent", "child", F.col("ord").cast("bigint").alias("ord"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """Children that have no children of their own."""
    return (edges.select(F.col("child").alias("node")).distinct()
            .join(edges.select(F.col("parent").alias("node")), "node", "left_anti"))


def interior(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct()


def duplicate_children(edges: DataFrame) -> DataFrame:
    """H1: nodes listed as a child more than once (two parents, or twice under one)."""
    return edges.groupBy("child").agg(F.count(F.lit(1)).alias("n_parents")).where("n_parents > 1")


def isolated_nodes(edges: DataFrame, root: str) -> DataFrame:
    """H2: parents, other than the root, that are nobody's child."""
    parents = edges.select(F.col("parent").alias("node")).distinct()
    children = edges.select(F.col("child").alias("node"))
    return parents.join(children, "node", "left_anti").where(F.col("node") != F.lit(root))


def closure(edges: DataFrame, roots: DataFrame | None = None, include_self: bool = True) -> DataFrame:
    """H7 building block: ``(ancestor, node, depth)`` for every node below each start node.

    Start nodes are ``roots`` (column ``node``) or all nodes.  Round i joins what lies nearer than
    2^i with the jumps of exactly 2^i steps, so a tree of depth d takes log2(d) rounds.  A node that
    is reached on several ways counts once, at its least depth; rounds end when they reach nothing
    new, so a cycle ends them too.  ``include_self`` False leaves out a start node at depth 0; a node
    on a cycle is then its own descendant at the cycle's length."""
    e = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct()
    start = nodes(edges) if roots is None else roots.select("node").distinct()
    least = F.min("depth").alias("depth")
    first = start.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("bigint").alias("depth"))
    if not include_self:
        # from here on pairs are at least one step apart, so a node may meet itself
        first = start.join(e, F.col("node") == F.col("a")).select(
            F.col("a").alias("ancestor"), F.col("b").alias("node"), F.lit(1).cast("bigint").alias("depth"))
    if roots is not None and not include_self:
        raise ValueError("start nodes are left out only when all nodes start")
    reached, jumps, step, n = first, e, 1, first.count()
    while True:
        far = reached.join(jumps, reached.node == jumps.a).select(
            "ancestor", F.col("b").alias("node"), (F.col("depth") + F.lit(step)).alias("depth"))
        reached = materialize(reached.unionByName(far).groupBy("ancestor", "node").agg(least), "closure")
        seen, n = n, reached.count()
        if n == seen:
            return reached.select("ancestor", "node", F.col("depth").cast("int").alias("depth"))
        left, right = jumps.alias("l"), jumps.alias("r")
        jumps = materialize(left.join(right, F.col("l.b") == F.col("r.a")).select("l.a", "r.b").distinct(), "jumps")
        step *= 2


def cycle_nodes(edges: DataFrame, root: str) -> DataFrame:
    """H3: nodes on a cycle (``operators.cycles``); a root that is itself a child counts as one."""
    root_is_child = edges.where(F.col("child") == F.lit(root)).select(F.lit(root).alias("node"))
    return nodes_on_cycles(edges).unionByName(root_is_child).distinct()


def heights(edges: DataFrame) -> DataFrame:
    """H6: height = longest distance to a leaf (leaves 0); ordering by it is children-first."""
    return intervals.label(edges).select("node", F.col("height").cast("int").alias("height"))


def subtree_leaves(edges: DataFrame, clo: DataFrame | None = None) -> DataFrame:
    """H7: (grp, leaf) for every node: the leaves in its subtree (a leaf's subtree is itself)."""
    clo = clo if clo is not None else closure(edges)
    return clo.join(leaves(edges), "node", "left_semi").select(
        F.col("ancestor").alias("grp"), F.col("node").alias("leaf"))


def invalid_leaves(edges: DataFrame, kinds: DataFrame, root: str) -> DataFrame:
    """H4: leaves under the root that are not exactly one existing account (J10 ``created``)."""
    below = closure(edges, edges.sparkSession.createDataFrame([(root,)], "node string"))
    lv = subtree_leaves(edges, below).select(F.col("leaf").alias("name"))
    ok = kinds.where("created").select("name")
    return lv.join(ok, "name", "left_anti")


def coverage(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """H5 / V4 / V5: source accounts found in the tree, derived accounts missing from it."""
    tree_nodes = nodes(edges).withColumnRenamed("node", "name")
    src_in = (registry.where(F.col("kind") == "source").select("name")
              .join(tree_nodes, "name", "left_semi").select("name", F.lit("source account in tree").alias("problem")))
    der_out = (registry.where(F.col("kind") == "derived").select("name")
               .join(tree_nodes, "name", "left_anti").select("name", F.lit("derived account not in tree").alias("problem")))
    return src_in.unionByName(der_out)


def frontier(edges: DataFrame, root: str, open_nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """H8: visible nodes (every proper ancestor open; the root is the always-open display root)
    that are closed or leaves.  ``open_nodes`` has a ``node`` column."""
    return intervals.frontier(labels if labels is not None else intervals.label(edges), root, open_nodes)


def selection(edges: DataFrame, switches: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """H9: switching a node sets its whole subtree; a node's state is the latest switch on it or
    an ancestor, on by default.  ``switches(switch_no, node, active)``."""
    return intervals.selection(labels if labels is not None else intervals.label(edges), switches)


def selected_groups(edges: DataFrame, root: str, open_nodes: DataFrame, switches: DataFrame,
                    labels: DataFrame | None = None) -> DataFrame:
    """L13 groups: switched-on frontier nodes."""
    labels = labels if labels is not None else intervals.label(edges)
    f = frontier(edges, root, open_nodes, labels)
    sel = selection(edges, switches, labels).where("active")
    return f.join(sel.select("node"), "node", "inner").withColumnRenamed("node", "grp")
