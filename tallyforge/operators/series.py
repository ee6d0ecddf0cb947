"""Balance series rolled up over the category tree: L11-L15, J7, A2-A5, W2, F4.

For a group of leaf accounts the series is a step function: it starts at minus the sum of the
leaves' start values, with a first point at epoch 0 (as the reference plots it), and at every
distinct timestamp adds minus the net amount of the leaves (decision Q4: start once, cumulate
once).  Many groups are computed in one job: transactions join the (group, leaf) table,
aggregate per (group, timestamp) with map-side partial sums, and cumulate per group with the
ordered scan (one group may cover every account).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import subtree_sums
from .sequencing import ordered_scan


def group_start(group_leaves: DataFrame, accounts: DataFrame) -> DataFrame:
    """A3: per group, minus the sum of its leaves' start values."""
    a = accounts.select(F.col("name").alias("leaf"), "start_value")
    return (group_leaves.join(a, "leaf", "inner").groupBy("grp")
            .agg((-F.sum("start_value")).alias("start")))


def subtree_starts(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """A3 for every node of a labelled tree at once: minus the sum of the start values of the accounts among its
    leaves; a node that has none is left out."""
    leaf = labels.where("height = 0").select("node")
    own = accounts.select(F.col("name").alias("node"), "start_value", F.lit(1).cast("bigint").alias("n")).join(leaf, "node", "left_semi")
    return subtree_sums(labels, own, ["start_value", "n"]).where("n > 0").select(F.col("node").alias("grp"), (-F.col("start_value")).alias("start"))


def net_changes(group_leaves: DataFrame, txn: DataFrame, account_col: str = "account") -> DataFrame:
    """A2: per (group, timestamp), minus the sum of the leaves' amounts."""
    t = txn.select(F.col(account_col).alias("leaf"), "epoch", "amount")
    return (t.join(group_leaves, "leaf", "inner").groupBy("grp", "epoch")
            .agg((-F.sum("amount")).alias("net")))


def rolled_net_changes(edges: DataFrame, txn: DataFrame, groups: DataFrame | None = None,
                       account_col: str = "account", depth: int | None = None) -> DataFrame:
    """A2 + A10 level by level: net change per (leaf, timestamp) first, then each tree level sums
    its children's (node, timestamp) rows.  The transactions are shuffled once, as partial sums;
    every further level reads the previous level's much smaller aggregate instead of fanning each
    transaction out to all its ancestors.  ``groups`` (column ``grp``) keeps only those nodes.
    ``depth`` (the tree height, when known) fixes the number of levels, else they end with an empty one
    (the tree must have no cycle, see ``hierarchy.cycle_nodes``)."""
    from ..session import materialize
    from .hierarchy import leaves
    lv = leaves(edges).withColumnRenamed("node", "leaf")
    t = txn.select(F.col(account_col).alias("leaf"), "epoch", "amount").join(lv, "leaf", "left_semi")
    cur = materialize(t.groupBy(F.col("leaf").alias("grp"), "epoch").agg((-F.sum("amount")).alias("net")),
                      "rollup")
    up = edges.select(F.col("child").alias("grp"), F.col("parent").alias("up"))
    parts = [cur]
    while depth is None or len(parts) <= depth:
        nxt = materialize(cur.join(up, "grp", "inner").groupBy(F.col("up").alias("grp"), "epoch")
                          .agg(F.sum("net").alias("net")), "rollup")
        if depth is None and nxt.isEmpty():
            break
        parts.append(nxt)
        cur = nxt
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if groups is None else out.join(groups.select("grp"), "grp", "left_semi")


def full_series(group_leaves: DataFrame, txn: DataFrame, accounts: DataFrame,
                account_col: str = "account", net: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(grp, epoch, balance) including the first point (0, start).  ``net`` and ``starts`` may be
    given (e.g. from ``rolled_net_changes`` and ``subtree_starts``); else they are computed from ``group_leaves``.  The start is
    the first element of a group's scan.  A group none of whose leaves is an account has no series."""
    starts = starts if starts is not None else group_start(group_leaves, accounts)
    if net is None:
        net = net_changes(group_leaves, txn, account_col)
    first = starts.select("grp", F.lit(0).cast("bigint").alias("epoch"), F.col("start").alias("net"), F.lit(1).alias("_first"))
    rows = net.select("grp", "epoch", "net", F.lit(0).alias("_first")).unionByName(first)
    run = ordered_scan(rows, ["grp"], [F.col("_first").desc(), "epoch"], sums=["net", "_first"], index="_i")
    return run.where("_run__first = 1").select("grp", "epoch", F.col("_run_net").alias("balance"))


def asof(series: DataFrame, t: int, starts: DataFrame) -> DataFrame:
    """Per group, the balance of the last point strictly before ``t`` (else the start)."""
    before = series.where(F.col("epoch") < F.lit(t)).groupBy("grp").agg(
        F.max_by("balance", "epoch").alias("_b"))
    return starts.join(before, "grp", "left").select(
        "grp", F.coalesce("_b", F.col("start")).alias("balance"))


def asof_many(series: DataFrame, probes: DataFrame, starts: DataFrame) -> DataFrame:
    """J7 / W6 for many times at once: every row of ``probes`` (grp, epoch) with the balance of its group's last
    point strictly before its time, else the group's start value; a probe of a group without a start has none.
    Points and probes are merged in one ordered scan that carries the last balance over the ranges."""
    point = series.select("grp", "epoch", F.lit(2).alias("_kind"), "balance")
    ask = probes.select("grp", "epoch", F.lit(1).alias("_kind"))
    first = starts.select("grp", F.lit(0).alias("_kind"), F.col("start").alias("balance"))
    rows = ask.unionByName(point, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    run = ordered_scan(rows, ["grp"], [(F.col("_kind") == 0).desc(), "epoch", "_kind"], lasts=["balance"], index="_i")
    return run.where("_kind = 1").select("grp", "epoch", F.col("_last_balance").alias("balance"))


def clip_series(series: DataFrame, starts: DataFrame, t_start: int, t_end: int) -> DataFrame:
    """Points with t_start <= epoch <= t_end, plus carried points at both bounds
    when no point lies exactly there (the end point only when it differs from the start).  The
    carried balance is that of the last point strictly before the bound, else the start value.
    Both bounds come from ONE conditional aggregate per group over the series."""
    s, e = F.lit(t_start), F.lit(t_end)
    ep, bal = F.col("epoch"), F.col("balance")
    inside = series.where(ep.between(s, e)).select("grp", "epoch", "balance")
    g = series.groupBy("grp").agg(
        F.max((ep == s).cast("int")).alias("_has_s"),
        F.max((ep == e).cast("int")).alias("_has_e"),
        F.max_by(F.when(ep < s, bal), F.when(ep < s, ep)).alias("_b_s"),
        F.max_by(F.when(ep < e, bal), F.when(ep < e, ep)).alias("_b_e"),
    )
    g = starts.join(g, "grp", "left")
    carry_s = g.where(F.coalesce("_has_s", F.lit(0)) == 0).select(
        "grp", s.cast("bigint").alias("epoch"), F.coalesce("_b_s", "start").alias("balance"))
    out = inside.unionByName(carry_s)
    if t_end != t_start:
        carry_e = g.where(F.coalesce("_has_e", F.lit(0)) == 0).select(
            "grp", e.cast("bigint").alias("epoch"), F.coalesce("_b_e", "start").alias("balance"))
        out = out.unionByName(carry_e)
    return out


def series_totals(clipped: DataFrame) -> DataFrame:
    """L15 / A4 (+ Q9): per group the sum of balance points (as the reference's "total"), the
    balance at both ends and the net change between them, and A5's per-group range."""
    return clipped.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum("balance").alias("balance_point_sum"),
        F.min_by("balance", "epoch").alias("first_balance"),
        F.max_by("balance", "epoch").alias("last_balance"),
        (F.max_by("balance", "epoch") - F.min_by("balance", "epoch")).alias("net_change"),
        F.min("balance").alias("min_balance"),
        F.max("balance").alias("max_balance"),
    )


def series_range(clipped: DataFrame) -> DataFrame:
    """Value range over all groups, and the range of the per-group totals."""
    totals = series_totals(clipped)
    return totals.agg(
        F.min("min_balance").alias("min_balance"), F.max("max_balance").alias("max_balance"),
        F.min("balance_point_sum").alias("min_total"), F.max("balance_point_sum").alias("max_total"),
        F.count(F.lit(1)).alias("n_groups"))
