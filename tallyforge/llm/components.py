"""Connected components of an edge table, without collecting nodes or edges.

Alternating large-star and small-star steps: each moves edges to the smallest neighbour, so components
become stars in a number of rounds that grows with the logarithm of their size.  Every round is written
to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """The edges after a step; the large one's may come twice."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    ends = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node is both an upper and a lower end, and every upper end has one lower end."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))).alias("e"))
    ends = ends.groupBy("e.u").agg(F.min("e.v").alias("x"), F.max("e.v").alias("y"), F.count("*").alias("k"), F.count("e.v").alias("up"))
    return ends.where("x <> y or up between 1 and k - 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (comp: the smallest node) of every node that has an edge (columns ``a, b``; written before)."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while not _stars(now):
        now = written(_star(_star(now, large=True), large=False), "stars")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
