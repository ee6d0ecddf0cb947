"""Interval labels of a category tree (H6-H9, A10): every node has a place ``enter`` in depth-first order, and its
subtree is the nodes that enter from there up to, not with, ``leave``.

The labels need no table of ancestors.  Nodes with one child and what follows them are a line; pointer doubling down the lines
(narrow rows of 64-bit keys) tells each node its line and its place there.  What lies above a line's top and below its lowest
node is the same for all of it, so the tree of lines is labelled and the nodes take their labels from their line.  Pointer doubling
over the lines' parents gives depth, size and height: after round k a line knows what lies less than 2^k lines below it and points
2^k lines up.  The sizes of earlier siblings (one ordered scan) are a line's offset in its parent, and the sum of offsets on the path
to the root, doubled up again, is its place.

On labelled trees questions are scans in order of places: what a subtree holds is the difference of two running sums, how many
closed nodes lie above a node is the running sum of those begun less those ended.

The table must be a tree or several: every node has one parent at most and none is above itself (H1-H3 report what is not); else
``label`` raises ``ValueError``.  Roots follow one another by name, children by ``ord``, then name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sequencing import ordered_scan


def fold_up(tree: DataFrame, value: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """``node, value`` with ``value`` merged over the path from each node up to its root.  ``tree(node, parent,
    value)``; ``merge(own side, upper side)`` is associative."""
    now = tree.select("node", F.col("parent").alias("jump"), value)
    while True:
        above = now.select(F.col("node").alias("jump"), F.col("jump").alias("beyond"), F.col(value).alias("upper"))
        # roots and nodes that have arrived are not joined
        moved = now.where("jump is not null").join(above, "jump").select(
            "node", F.col("beyond").alias("jump"), merge(F.col(value), F.col("upper")).alias(value))
        now = materialize(now.where("jump is null").unionByName(moved), "fold")
        if now.where("jump is not null").isEmpty():
            return now.select("node", value)


def _key(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def _nodes(edges: DataFrame) -> DataFrame:
    """``id, node, parent, up, ord, down`` of every node, one row each: 64-bit keys of the node, its parent and, if it has
    exactly one, its child.  Keys that two names share are found, and others are taken."""
    if not edges.where("parent is null or child is null").isEmpty():
        raise ValueError("a node has no name")
    for seed in range(64):
        child = edges.select(_key(F.col("child"), seed).alias("id"), F.col("child").alias("node"), "parent", _key(F.col("parent"), seed).alias("up"), "ord")
        kids = child.groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.max("id").alias("down"), F.min("parent").alias("name"), F.max("parent").alias("other"))
        tree = child.join(kids.withColumnRenamed("up", "id"), "id", "full").select(
            "id", F.coalesce("node", "name").alias("node"), "parent", "up", F.coalesce("ord", F.lit(0)).cast("bigint").alias("ord"),
            F.when(F.col("kids") == 1, F.col("down")).alias("down"), F.coalesce(F.expr("name <> other or node <> name"), F.lit(False)).alias("clash"))
        tree = materialize(tree, "tree")
        twice = tree.groupBy("id").count().where("count > 1")
        if not twice.isEmpty():
            names = tree.join(twice.select("id"), "id", "left_semi").groupBy("node").count().where("count > 1")
            if not names.isEmpty():
                raise ValueError("a node is listed as a child more than once")
        elif tree.where("clash").isEmpty():
            return tree.drop("clash")
    raise RuntimeError("names without distinct keys")


def _lines(tree: DataFrame, rounds: int) -> DataFrame:
    """``id, line, below``: nodes with one child and what follows them are a line; ``line`` is the key of its lowest node,
    that has several children or none, ``below`` the steps to it."""
    now = tree.select("id", F.coalesce("down", "id").alias("line"), F.col("down").isNotNull().cast("bigint").alias("below"),
                      F.col("down").isNotNull().alias("open"))
    arrived = now.where("not open")
    now = now.where("open")
    while not now.isEmpty():
        if rounds < 0:
            raise ValueError("a node lies above itself")
        to = now.unionByName(arrived).select(F.col("id").alias("line"), F.col("line").alias("_line"), F.col("below").alias("_below"), F.col("open").alias("_open"))
        moved = now.select("id", "line", "below").join(to, "line").select(
            "id", F.col("_line").alias("line"), (F.col("below") + F.col("_below")).alias("below"), F.col("_open").alias("open"))
        moved = materialize(moved, "lines")
        arrived = arrived.unionByName(moved.where("not open"))
        now = moved.where("open")
        rounds -= 1
    return arrived.select("id", "line", "below")


def _below(lines: DataFrame, rounds: int) -> DataFrame:
    """``node, depth, size, height`` of every line of ``lines(node, parent, len)``: nodes from the root down to its lowest one
    with both, nodes from its top down, steps from its lowest node to the lowest leaf."""
    now = lines.select("node", F.col("parent").alias("jump"), F.col("len").alias("depth"), F.col("len").alias("size"), F.lit(0).cast("bigint").alias("height"))
    while True:
        above = now.select(F.col("node").alias("jump"), F.col("jump").alias("beyond"), F.col("depth").alias("more"))
        open_ = now.where("jump is not null")
        moved = open_.join(above, "jump").select(
            "node", F.col("beyond").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), "size", "height")
        # until it arrives, depth is the way to where a line points
        far = open_.groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("far_size"), F.max(F.col("height") + F.col("depth")).alias("far_height"))
        now = now.where("jump is null").unionByName(moved).join(far, "node", "left").select(
            "node", "jump", "depth", (F.col("size") + F.coalesce("far_size", F.lit(0))).alias("size"),
            F.greatest("height", "far_height").alias("height"))
        now = materialize(now, "below")
        if now.where("jump is not null").isEmpty():
            return now.drop("jump")
        rounds -= 1
        if rounds < 0:  # no path is as long as the nodes are many
            raise ValueError("a node lies above itself")


def label(edges: DataFrame) -> DataFrame:
    """``node, parent, depth, size, height, enter, leave`` of every node of ``edges(parent, child, ord)``.
    ``size`` counts the node itself; an empty table has no nodes."""
    tree = _nodes(edges)
    rounds = math.ceil(math.log2(tree.count() + 1)) + 1
    member = _lines(tree, rounds)
    # the parent of a line's top has several children, so it is the lowest node of its own line
    tops = tree.join(tree.select(F.col("down").alias("id")).where("id is not null"), "id", "left_anti").select("id", "node", "up", "ord")
    lines = member.join(tops, "id").select(F.col("line").alias("node"), F.col("up").alias("parent"), (F.col("below") + 1).alias("len"), "ord", F.col("node").alias("name"))
    lines = materialize(lines, "tops")
    below = materialize(lines.join(_below(lines, rounds), "node"), "line-sizes")
    run = ordered_scan(below, ["parent"], ["ord", "name"], sums=["size"], index="_i")
    offset = F.col("_run_size") - F.col("size") + F.col("parent").isNotNull().cast("bigint") + F.col("len") - 1
    run = materialize(run.withColumn("enter", offset), "offsets")
    place = fold_up(run, "enter", lambda own, upper: own + upper)
    ends = run.select("node", "len", "depth", "size", "height").join(place, "node").withColumnRenamed("node", "line")
    out = member.join(ends, "line").join(tree.select("id", "node", "parent"), "id").select(
        "node", "parent", (F.col("depth") - 1 - F.col("below")).alias("depth"), (F.col("size") - F.col("len") + 1 + F.col("below")).alias("size"),
        (F.col("height") + F.col("below")).alias("height"), (F.col("enter") - F.col("below")).alias("enter"))
    return materialize(out.withColumn("leave", F.col("enter") + F.col("size")), "labels")


def subtree_sums(labels: DataFrame, values: DataFrame, sums: list[str]) -> DataFrame:
    """A10: ``node`` with the sum of each BIGINT column of ``values(node, ...)`` over its subtree, 0 where that holds
    none: the running sum at its end less that at its beginning.  Values of other nodes count nowhere."""
    values = values.groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])
    nothing = [F.lit(0).cast("bigint").alias(c) for c in sums]
    held = labels.select("node", "enter").join(values, "node").select(F.col("enter").alias("at"), F.lit(1).alias("kind"), "node", F.lit(0).alias("sign"), *sums)
    ask = labels.select("node", F.explode(F.array(F.struct(F.col("enter").alias("at"), F.lit(-1).alias("sign")),
                                                  F.struct(F.col("leave").alias("at"), F.lit(1).alias("sign")))).alias("e"))
    ask = ask.select("e.at", F.lit(0).alias("kind"), "node", "e.sign", *nothing)
    run = ordered_scan(held.unionByName(ask), [], ["at", "kind", "node", "sign"], sums=sums, index="_i").where("kind = 0")
    return run.groupBy("node").agg(*[F.sum(F.col("sign") * F.col("_run_" + c)).alias(c) for c in sums])


def covering(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, leaf``: the leaves of disjoint subtrees.  ``groups(grp)`` holds no node that lies below another one (a
    frontier does not), else a leaf counts for the nearest."""
    tops = labels.join(groups.select(F.col("grp").alias("node")).distinct(), "node", "left_semi")
    tops = tops.select(F.col("enter").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("leaf"),
                       F.col("node").alias("grp"), F.col("leave").alias("until"))
    leaf = labels.where("height = 0").select(F.col("enter").alias("at"), F.lit(1).alias("kind"), F.col("node").alias("leaf"),
                                             F.lit(None).cast("string").alias("grp"), F.lit(None).cast("bigint").alias("until"))
    run = ordered_scan(tops.unionByName(leaf), [], ["at", "kind"], lasts=["grp", "until"], index="_i")
    return run.where("kind = 1 and at < _last_until").select(F.col("_last_grp").alias("grp"), "leaf")


def frontier(labels: DataFrame, root: str, open_nodes: DataFrame) -> DataFrame:
    """H8: nodes below ``root`` of which every proper ancestor is open (the root always is) and that are themselves
    closed or leaves."""
    top = labels.where(F.col("node") == F.lit(root)).select("enter", "leave").first()
    if top is None:
        return labels.select("node").limit(0)
    is_open = open_nodes.select("node").distinct().withColumn("opened", F.lit(True))
    under = labels.where((F.col("enter") > top["enter"]) & (F.col("enter") < top["leave"])).join(is_open, "node", "left")
    under = under.withColumn("opened", F.coalesce("opened", F.lit(False)))
    # a closed node begins after its own place is asked and ends before that of the next node
    ask = under.select(F.col("enter").alias("at"), F.lit(1).alias("kind"), "node", (F.col("height") == 0).alias("leaf"), "opened", F.lit(0).cast("bigint").alias("shut"))
    shut = under.where("not opened and height > 0").select("node", F.explode(F.array(
        F.struct(F.col("enter").alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("shut")),
        F.struct(F.col("leave").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("shut")))).alias("e"))
    shut = shut.select("e.at", "e.kind", "node", F.lit(None).cast("boolean").alias("leaf"), F.lit(None).cast("boolean").alias("opened"),
                       F.col("e.shut").cast("bigint").alias("shut"))
    run = ordered_scan(ask.unionByName(shut), [], ["at", "kind", "node"], sums=["shut"], index="_i")
    return run.where("kind = 1 and _run_shut = 0 and (leaf or not opened)").select("node")


def selection(labels: DataFrame, switches: DataFrame) -> DataFrame:
    """H9: ``node, active``: a node's state is the latest switch on it or above it, on by default.
    ``switches(switch_no, node, active)``."""
    last = switches.groupBy("node").agg(F.max(F.struct("switch_no", "active")).alias("switch"))
    # greatest() passes over nulls
    state = fold_up(labels.select("node", "parent").join(last, "node", "left"), "switch", lambda own, upper: F.greatest(own, upper))
    return state.select("node", F.coalesce("switch.active", F.lit(True)).alias("active"))


__all__ = ["covering", "fold_up", "frontier", "label", "selection", "subtree_sums"]
